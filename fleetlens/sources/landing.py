"""Tables that end a lineage: written once below the shared folder, read by every later step."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, prefix: str) -> str:
    """A new path below the shared checkpoint folder; a local one only where a session names none, as in tests."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{prefix}-{uuid.uuid4().hex}"
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return os.path.join(tempfile.mkdtemp(prefix="run-"), prefix)


def land(df: DataFrame) -> DataFrame:
    """``df`` as a written table: a lost executor costs the reading of it, not its making."""
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete paths of :func:`scratch` that nothing reads any more."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
