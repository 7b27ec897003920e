"""Windowed request metrics of a stream, kept as a table that later updates replace row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens.operators.request_log import paging, request_metrics

BATCH = "_batch"


def windowed_metrics(requests: DataFrame, *by: str, window: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Request metrics per tumbling window and ``by``; for the update mode, so that each batch sends only what it changed."""
    rows = requests.withWatermark("ts", lateness).withColumn("window", F.window("ts", window))
    return request_metrics(rows, "window", *by).withColumns(
        {"window_start": F.col("window.start"), "window_end": F.col("window.end")}).drop("window")


def start_upsert(updates: DataFrame, path: str, checkpoint: str, **trigger):
    """Start writing the updates of a stream below ``path``.

    A batch owns the folder of its number and replaces it, so that a batch which is run again after a failure changes
    nothing. :func:`current` reads the last row of every key.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={number}")

    return (updates.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start())


def _last(rows: DataFrame, keys: list[str]) -> DataFrame:
    values = [c for c in rows.columns if c not in (*keys, BATCH)]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(BATCH)).alias("last")).select(*keys, "last.*")


def _batches(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema.add(BATCH, "long") if BATCH not in schema.fieldNames() else schema).parquet(path)


def current(spark: SparkSession, path: str, schema, keys: list[str]) -> DataFrame:
    """The table that the updates below ``path`` leave: of every key the row of its last batch."""
    return _last(_batches(spark, path, schema), keys)


def compact(spark: SparkSession, path: str, target: str, schema, keys: list[str], upto: int) -> None:
    """Write the current table of the batches up to ``upto`` as the one batch ``upto`` of ``target``."""
    rows = _batches(spark, path, schema).where(F.col(BATCH) <= upto)
    _last(rows, keys).write.mode("overwrite").parquet(f"{target}/{BATCH}={upto}")


def paging_windows(metrics: DataFrame, **bar) -> DataFrame:
    """The windows that should page someone."""
    return paging(metrics, **bar)
