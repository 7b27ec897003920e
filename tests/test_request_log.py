import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import request_log as log
from fleetlens.streaming import request_stream as stream

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "ts timestamp, request_id long, cache_key string, path string, latency_ms double, scope string"


def requests(spark, rows):
    """From (seconds, key, path) tuples, in arrival order of equal times."""
    return spark.createDataFrame(
        [(START + timedelta(seconds=s), i, k, p, 1.0 + i, "s") for i, (s, k, p) in enumerate(rows)], SCHEMA)


def brute_outcomes(rows, ttl=300):
    anchor, out = {}, {}
    for s, i, k in sorted((s, i, k) for i, (s, k, _) in enumerate(rows)):
        if k not in anchor or s > anchor[k] + ttl:
            anchor[k] = s
            out[i] = ("miss", s, i)
            last = (s, i)
            anchor[k, "id"] = last
        else:
            out[i] = ("hit", *anchor[k, "id"])
    return out


def brute_served(rows, cap, ttl=300):
    expiry, spent, out = {}, 0, {}
    for s, i, k in sorted((s, i, k) for i, (s, k, _) in enumerate(rows)):
        if k in expiry and s <= expiry[k]:
            out[i] = "cache_hit"
        elif cap <= 0 or spent < cap:
            spent, expiry[k], out[i] = spent + 1, s + ttl, "llm"
        else:
            out[i] = "fallback"
    return out


def brute_streaks(rows):
    streak, out = 0, {}
    for s, i, p in sorted((s, i, p) for i, (s, _, p) in enumerate(rows)):
        streak = 0 if p in ("llm", "cache_hit") else streak + (p == "fallback")
        out[i] = streak
    return out


def generated(seed, n, span, keys):
    rnd = random.Random(seed)
    weights = [0.6] + [0.4 / max(len(keys) - 1, 1)] * (len(keys) - 1)
    paths = ["fallback"] * 8 + ["llm", "cache_hit", "error"]
    return [(rnd.randrange(span) + rnd.choice([0, 0, 0.5]), rnd.choices(keys, weights)[0], rnd.choice(paths))
            for _ in range(n)]


LOGS = {
    "dense": generated(1, 1500, 3000, ["a"]),
    "days": generated(2, 1500, 4 * 86400, ["a", "b", "c"]),
    "mixed": generated(3, 1500, 30000, ["a", "b"]),
    "boundary": [(s, "a", "llm") for s in (0, 300, 300.5, 600.5, 601, 3599, 3600, 3899, 3900, 86399, 86400, 86699, 86700)],
}


@pytest.mark.parametrize("name", LOGS)
def test_ttl_outcomes(spark, name):
    rows = LOGS[name]
    got = {r.request_id: r.outcome for r in log.ttl_outcomes(requests(spark, rows)).collect()}
    assert got == {i: v[0] for i, v in brute_outcomes(rows).items()}


@pytest.mark.parametrize("block, span", [(300, 600), (600, 3600), (7200, 7200)])
def test_ttl_does_not_depend_on_blocks(spark, block, span):
    rows = LOGS["mixed"]
    got = {r.request_id for r in log.ttl_misses(
        requests(spark, rows), block_seconds=block, span_seconds=span).collect()}
    assert got == {i for i, v in brute_outcomes(rows).items() if v[0] == "miss"}


@pytest.mark.parametrize("cap", [0, 1, 40, 10 ** 6])
def test_admit(spark, cap):
    rows = LOGS["mixed"]
    got = {r.request_id: r.served for r in log.admit(requests(spark, rows), cap).collect()}
    assert got == brute_served(rows, cap)


@pytest.mark.parametrize("name", LOGS)
def test_streaks(spark, name):
    rows = LOGS[name]
    got = {r.request_id: r.streak for r in log.fallback_streaks(requests(spark, rows), "scope").collect()}
    assert got == brute_streaks(rows)
    alerts = {r.request_id for r in log.fallback_alerts(requests(spark, rows)).collect()}
    assert alerts == {i for i, s in brute_streaks(rows).items() if s >= 10}


def test_streak_rules(spark):
    paths = ["fallback"] * 9 + ["error", "fallback", "error", "cache_hit", "fallback", "llm", "error"]
    rows = [(i, "k", p) for i, p in enumerate(paths)]
    got = [r.streak for r in log.fallback_streaks(requests(spark, rows)).orderBy("request_id").collect()]
    assert got == [1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 10, 10, 0, 1, 0, 0]


def test_metrics(spark):
    rows = [(i, "k", p) for i, p in enumerate(["llm", "fallback", "fallback", "error"])]
    m = log.request_metrics(requests(spark, rows)).first()
    assert (m.total, m.n_llm, m.n_fallback, m.n_error, m.n_cache_hit) == (4, 1, 2, 1, 0)
    assert (m.fallback_rate, m.avg_latency_ms) == (0.5, 2.5)
    empty = log.request_metrics(requests(spark, rows).limit(0)).first()
    assert (empty.total, empty.fallback_rate, empty.avg_latency_ms) == (0, 0.0, 0.0)


def test_paging(spark):
    def pages(n_fallback, n_other):
        rows = [(i, "k", "fallback") for i in range(n_fallback)] + [(0, "k", "llm")] * n_other
        return log.paging(log.request_metrics(requests(spark, rows))).count()

    assert [pages(11, 0), pages(10, 0), pages(19, 1), pages(39, 1)] == [1, 0, 0, 1]


def drain(stream_df, folder):
    (stream_df.writeStream.format("parquet").option("path", f"{folder}/rows")
     .option("checkpointLocation", f"{folder}/state").outputMode("append")
     .trigger(availableNow=True).start().awaitTermination())
    return stream_df.sparkSession.read.schema(stream_df.schema).parquet(f"{folder}/rows")


def as_stream(spark, df, folder, parts=3):
    """The log as a stream of ``parts`` files in time order, one per micro-batch."""
    rows = df.orderBy("ts", "request_id").collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        piece = spark.createDataFrame(rows[i * size:(i + 1) * size], df.schema).coalesce(1)
        piece.write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_stream_matches_batch(spark, tmp_path):
    rows = LOGS["mixed"]
    source = requests(spark, rows)
    settled = drain(stream.stream_ttl(as_stream(spark, source, tmp_path / "t")), tmp_path / "o")
    got = {r.request_id: (r.outcome, r.anchor_us, r.anchor_id) for r in settled.collect()}
    base = int(START.timestamp() * 1_000_000)
    assert got == {i: (o, base + int(s * 1_000_000), a) for i, (o, s, a) in brute_outcomes(rows).items()}
    budget = drain(stream.stream_budget(as_stream(spark, settled, tmp_path / "b"), 40, "scope"), tmp_path / "s")
    assert {r.request_id: r.served for r in budget.collect()} == brute_served(rows, 40)


def test_stream_alerts_match_batch(spark, tmp_path):
    source = requests(spark, LOGS["dense"])
    alerts = drain(stream.stream_alerts(as_stream(spark, source, tmp_path / "t"), "scope"), tmp_path / "o")
    batch = log.fallback_alerts(source, "scope")
    assert {(r.request_id, r.streak) for r in alerts.collect()} == {
        (r.request_id, r.streak) for r in batch.collect()}


def test_stream_streaks_by_hours(spark, tmp_path):
    """Hours without an answer hand their streak on, also from batch to batch; few rows go on to the scope's one task."""
    rng = random.Random(3)
    paths = ["fallback"] * 5 + ["error", "llm", "cache_hit"]
    rows = [(rng.randrange(-50, 200) * 600, "k", "fallback" if 30 < i % 90 < 60 else rng.choice(paths)) for i in range(700)]
    rows += [(36_000 * 20 + i * 1_800, "k", "fallback") for i in range(12)] + [(36_000 * 30, "k", None)]
    source = requests(spark, rows).withColumn("scope", F.when(F.col("request_id") % 3 > 0, F.concat(F.lit("s"), F.col("request_id") % 3)))
    source = source.withColumn("ts", F.when(F.col("request_id") % 100 != 7, F.col("ts")))
    got = drain(stream.stream_streaks(as_stream(spark, source.where("ts is not null"), tmp_path / "t"), "scope"), tmp_path / "o")
    whole = drain(stream.stream_streaks(as_stream(spark, source, tmp_path / "w", 1), "scope"), tmp_path / "p")
    for log_rows, found in ((source.where("ts is not null"), got), (source, whole)):
        streak, wanted = {}, {}
        late = datetime.max.replace(tzinfo=timezone.utc)
        key = lambda r: (r.ts.timestamp() if r.ts else late.timestamp(), r.request_id)
        for r in sorted(log_rows.collect(), key=key):
            streak[r.scope] = 0 if r.path in ("llm", "cache_hit") else streak.get(r.scope, 0) + (r.path == "fallback")
            wanted[r.request_id] = streak[r.scope]
        assert found.columns == [*source.columns, "streak"] and found.count() == len(wanted)
        assert {r.request_id: r.streak for r in found.collect()} == wanted
    dense = requests(spark, [(i / 10, "k", rng.choice(paths)) for i in range(5_000)])
    blocked = stream._blocked(dense, "scope")
    assert blocked.where("_kind = 0").count() > 4_900 and blocked.where("_kind > 0").count() < 100


def test_stream_metrics(spark, tmp_path):
    source = requests(spark, LOGS["mixed"])
    windows = stream.stream_metrics(as_stream(spark, source, tmp_path / "t", 4), "1 hour", "1 second")
    got = {(r.window.start, r.total, r.n_fallback) for r in drain(windows, tmp_path / "o").collect()}
    batch = log.request_metrics(source.withColumn("window", F.window("ts", "1 hour")), "window")
    expected = {(r.window.start, r.total, r.n_fallback) for r in batch.collect()}
    # The last windows stay open until the watermark passes them.
    assert got and got <= expected and len(expected) - len(got) <= 2


def test_unprocessed(spark):
    keyed = spark.createDataFrame([("a", 1), ("b", 2)], "cache_key string, v int")
    done = spark.createDataFrame([("a",), ("a",)], "cache_key string")
    assert [r.cache_key for r in log.unprocessed(keyed, done).collect()] == ["b"]


def test_dense_hours_are_cut_by_rows(spark):
    """All of one key and one hour: no task gets more than a block, and the tree has several levels."""
    rows = [(s, "hot", "llm") for s, *_ in generated(7, 3000, 3500, ["hot"])] + generated(8, 300, 86400 * 3, ["a", "hot"])
    expected = {i for i, v in brute_outcomes(rows).items() if v[0] == "miss"}
    blocks = log._time_blocks(requests(spark, rows).select(
        F.col("cache_key").alias("key"), F.unix_micros("ts").alias("us"), "request_id"), 3600, 50, 1_000_000)
    sizes = [r["count"] for r in blocks.groupBy("key", "block").count().collect()]
    assert max(sizes) <= 60 and len(sizes) > 50
    for fan in (2, 5):
        got = {r.request_id for r in log.ttl_misses(requests(spark, rows), block_rows=50, span_seconds=fan * 3600, tick_micros=1_000_000).collect()}
        assert got == expected
