"""JSON records in, guides out."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetlens.functions.text import computed, strip
from fleetlens.operators.analysis import parse_analyses

#: Files that may hold one record over several lines; every other file holds one record a line.
WHOLE_FILES = "*.json"


def read_analyses(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(records, bad)`` from files with one JSON record per line.

    ``bad`` keeps the text of every malformed or invalid line with the reason.
    """
    lines = spark.read.text(path).withColumnRenamed("value", "source_text")
    records, bad = parse_analyses(lines, "source_text")
    return records.drop("source_text"), bad


def _is_object(text: Column) -> Column:
    return F.from_json(text, "map<string,string>", {"allowSingleQuotes": "false"}).isNotNull()


def read_record_files(spark: SparkSession, path: str, whole: str = WHOLE_FILES) -> tuple[DataFrame, DataFrame]:
    """``(records, bad)`` from a folder of any mix of files, at any depth, both with ``source_file``.

    Files whose name fits ``whole`` are read as one row each and hold one record, however it is laid out, or, where already
    their first line is a record, one a line. All other files are split by the reader and read line by line, at any size. A file
    that is no record is one row of ``bad`` with its whole text. Blank lines and files are nothing.
    """
    name = F.col("_metadata.file_path")
    fits = F.col("_metadata.file_name").rlike("^" + whole.replace(".", r"\.").replace("*", ".*") + "$")
    reader = spark.read.option("recursiveFileLookup", True)
    lines = reader.text(path).where(~fits).select(name.alias("source_file"), F.col("value").alias("source_text"))
    files = reader.option("pathGlobFilter", whole).text(path, wholetext=True).select(
        name.alias("source_file"), F.col("value").alias("text"))
    # A single-line file is a whole record either way.
    first = F.regexp_extract("text", r"(?s)^\s*([^\n]*)", 1)
    # A text that ends early may pass as an object.
    by_line = F.contains("text", F.lit("\n")) & first.rlike(r"\}\s*$") & _is_object(first)
    files = computed(files, _by_line=by_line)
    texts = files.select("source_file", F.explode(F.when(F.col("_by_line"), F.split("text", "\n")).otherwise(F.array("text"))).alias("source_text"))
    records, bad = parse_analyses(texts.unionByName(lines).where(strip("source_text") != ""), "source_text")
    return records.drop("source_text"), bad


def write_knowledge(guides: DataFrame, path: str, mode: str = "errorifexists", by: list[str] | None = None) -> None:
    """Write one JSON guide per line, NULL fields included.

    With ``by`` the guides are partitioned by those columns, and only partitions that occur among ``guides`` are replaced, whatever
    ``mode`` says: writing them again, after a failure or with new results, leaves all others as they are.
    """
    writer = guides.write.option("ignoreNullFields", "false")
    if by:
        writer.mode("overwrite").partitionBy(*by).option("partitionOverwriteMode", "dynamic").json(path)
    else:
        writer.mode(mode).json(path)


def read_knowledge(spark: SparkSession, path: str, schema) -> DataFrame:
    """Guides that :func:`write_knowledge` wrote, partition columns included."""
    return spark.read.schema(schema).json(path)
