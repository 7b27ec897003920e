"""Repository-URL requests."""

from pyspark.sql import DataFrame, functions as F

from fleetlens import catalogs
from fleetlens.functions.names import is_repo_url, normalise_url
from fleetlens.functions.text import col, py_repr, strip


def validate_urls(df: DataFrame, column: str) -> DataFrame:
    """Add ``is_valid``, ``clone_url`` (valid rows) and ``reason`` (rejected rows)."""
    url = col(column)
    blank = url.isNull() | (strip(url) == "")
    valid = ~blank & is_repo_url(url)
    return df.select(
        "*",
        valid.alias("is_valid"),
        F.when(valid, normalise_url(url)).alias("clone_url"),
        F.when(blank, F.lit(catalogs.URL_BLANK))
        .when(~valid, F.concat(F.lit(catalogs.URL_UNSUPPORTED), py_repr(url))).alias("reason"),
    )
