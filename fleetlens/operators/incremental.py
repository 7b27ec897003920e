"""Incremental runs: what has a result is known by the content key of its record, in a bucketed table.

The results are bucketed and sorted by ``cache_key``, so looking up a run's records moves the records only: the table,
which grows with every run, is read bucket by bucket where it lies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetlens.functions.text import content_key
from fleetlens.operators import guide
from fleetlens.operators.prompts import build_prompts

BUCKETS = 64


def keyed(records: DataFrame) -> DataFrame:
    """Records with ``cache_key``, the hash of the record as received."""
    return records.withColumn("cache_key", content_key(*guide.RECORD_FIELDS))


def save_results(results: DataFrame, table: str, buckets: int = BUCKETS) -> None:
    """Append results, which hold ``cache_key``, to the table of all results."""
    results.write.bucketBy(buckets, "cache_key").sortBy("cache_key").mode("append").saveAsTable(table)


def pending(spark: SparkSession, records: DataFrame, table: str) -> DataFrame:
    """The records, with ``cache_key``, that have no result in the table; all of them where there is no table yet.

    Records of equal content share a key; each comes out as long as the key has no result.
    """
    rows = keyed(records)
    if not spark.catalog.tableExists(table):
        return rows
    return rows.join(spark.table(table).select("cache_key"), "cache_key", "left_anti")


def pending_prompts(spark: SparkSession, records: DataFrame, table: str) -> DataFrame:
    """The prompts of the records that have no result yet."""
    return build_prompts(pending(spark, records, table).drop("cache_key"))
