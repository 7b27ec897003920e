from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import request_log
from fleetlens.plans.registry import _ROCKS, _STORE
from fleetlens.streaming import event_time, metrics_stream

SCHEMA = "ts timestamp, request_id long, cache_key string, path string, latency_ms double"
START = datetime(2024, 5, 1, 10)


def at(minutes, request_id, key="k", path="fallback"):
    return START + timedelta(minutes=minutes), request_id, key, path, 1.0


@pytest.fixture
def rocks(spark):
    spark.conf.set(_STORE, _ROCKS)
    yield
    spark.conf.unset(_STORE)


def drained(spark, folder, batches, build):
    """The rows that a stream writes over files which arrive one by one."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = build(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"))
        (stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
         .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def test_rows_are_settled_in_order_and_late_ones_kept(spark, rocks, tmp_path):
    batches = [
        [at(20, 3), at(4, 2), at(0, 1), at(7, 9, "other")],
        [at(6, 5), at(30, 6), at(3, 4)],             # in time, but behind rows that came before
        [at(300, 7)],                                # moves the horizon past all of them
        [at(1, 8), at(299.5, 10), at(2, 11, "new")],  # 8 and 11 are late, 10 isn't
        [at(10_000, 12, "beat")],
    ]
    out = drained(spark, tmp_path, batches, lambda s: event_time.stream_ttl(s, lateness="1 hour")).collect()
    got = {r.request_id: r.outcome for r in out}
    assert len(out) == len(got) == 11  # every row once; the last one waits
    assert {i for i, o in got.items() if o == "late"} == {8, 11}
    in_time = [r for b in batches for r in b if r[1] not in (8, 11, 12)]
    batch = request_log.ttl_outcomes(spark.createDataFrame(in_time, SCHEMA)).collect()
    assert {r.request_id: r.outcome for r in batch} == {i: o for i, o in got.items() if o != "late"}
    assert all(r.anchor_id is not None for r in out if r.outcome != "late")


def test_streaks_of_a_key_in_order(spark, rocks, tmp_path):
    rows = [at(i, i, "a", "llm" if i == 5 else "error" if i == 7 else "fallback") for i in range(20)] + [at(i, 100 + i, "b") for i in range(3)]
    batches = [rows[1::2], rows[::2], [at(10_000, 999, "beat")]]
    out = drained(spark, tmp_path, batches, lambda s: event_time.stream_alerts(s, "cache_key", lateness="2 days")).collect()
    assert sorted((r.request_id, r.streak) for r in out) == [(i, i - 6) for i in range(16, 20)]


def test_upserts_replace_rows_and_survive_a_second_run(spark, tmp_path):
    folder, keys = str(tmp_path), ["cache_key", "window_start", "window_end"]
    batches = [[at(1, 1), at(90, 2)], [at(2, 3, path="llm"), at(3, 4)], [at(91, 5)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        updates = metrics_stream.windowed_metrics(spark.readStream.schema(SCHEMA).parquet(f"{folder}/in"), "cache_key", lateness="10 days")
        metrics_stream.start_upsert(updates, f"{folder}/rows", f"{folder}/state", availableNow=True).awaitTermination()
    schema = updates.schema
    expected = request_log.request_metrics(
        spark.createDataFrame([r for b in batches for r in b], SCHEMA).withColumn("window", F.window("ts", "1 hour")), "window", "cache_key")
    wanted = sorted((r.window.start, r.total, r.n_llm, r.fallback_rate) for r in expected.collect())

    def table(path):
        return sorted((r.window_start, r.total, r.n_llm, r.fallback_rate) for r in metrics_stream.current(spark, path, schema, keys).collect())

    assert table(f"{folder}/rows") == wanted and len(wanted) == 2
    # The last batch is run again, as after a failure.
    numbers = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "rows").iterdir())
    again = spark.createDataFrame(spark.read.parquet(f"{folder}/rows/_batch={numbers[-1]}").collect(), schema)
    again.write.mode("overwrite").parquet(f"{folder}/rows/_batch={numbers[-1]}")
    assert table(f"{folder}/rows") == wanted
    metrics_stream.compact(spark, f"{folder}/rows", f"{folder}/small", schema, keys, numbers[-1])
    assert table(f"{folder}/small") == wanted
    assert metrics_stream.paging_windows(metrics_stream.current(spark, f"{folder}/small", schema, keys), rate=0.6, min_requests=1).count() == 2
