"""Session settings that the operators rely on."""

from pyspark.sql import DataFrame, SparkSession

from fleetlens.functions.text import sql_literal

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Partition counts and skewed join sides are settled at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Recording the call site of every expression makes large plans slow to build.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # A file path is short and a file content long: let splits follow the bytes read.
    "spark.sql.files.maxPartitionBytes": "128m",
}


def build_session(master: str | None = None, app: str = "fleetlens", **extra) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def dimension(spark: SparkSession, rows, columns: str) -> DataFrame:
    """A constant table as an inline relation, so its size is known to the optimizer."""
    names = [c.strip() for c in columns.split(",")]

    values = ", ".join("(" + ", ".join(sql_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")
