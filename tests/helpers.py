import json

from pyspark.sql import functions as F

from fleetlens.operators import analysis


def evaluate(spark, fn, *values):
    """``fn(column)`` for every value, in order."""
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r.out for r in df.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]


def files(spark, *rows):
    """``files`` from (repo_id, path[, content]) tuples."""
    return spark.createDataFrame(
        [(r[0], r[1], r[2] if len(r) > 2 else "x", 1) for r in rows],
        "repo_id string, path string, content string, size long")


def records(spark, *docs):
    """Parsed records with an ``id``, one per dict."""
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "id int, j string")
    parsed, bad = analysis.parse_analyses(df, "j")
    return parsed.drop("j"), bad


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
