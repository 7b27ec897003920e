"""Declared dependencies of every manifest."""

from functools import cache

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens import catalogs
from fleetlens.functions import manifests
from fleetlens.functions.names import normalise_dep, purpose_by_convention
from fleetlens.functions.text import no_strings, strings, strip
from fleetlens.session import dimension
from fleetlens.sources.files import with_file_class


def _only(kind: str) -> Column:
    return F.when(F.col("kind") == kind, F.col("content"))


@cache
def _native_parsers() -> tuple[Column, ...]:
    """Parsers that run in the JVM; the expressions hold no data and are built once."""
    return (
        F.array_position(strings(catalogs.MANIFESTS), F.col("kind")).cast("int").alias("kind_rank"),
        manifests.requirements_packages(_only("requirements.txt")).alias("pip"),
        F.when(F.col("kind") == "package.json", manifests.package_json("content")).alias("npm"),
        manifests.go_mod_packages(_only("go.mod")).alias("go"),
        manifests.cargo_packages(_only("cargo.toml")).alias("cargo"))


def parse_manifests(files: DataFrame) -> DataFrame:
    """``(repo_id, source, kind, kind_rank, packages, main, root_error, error)`` per manifest.

    One pass over the manifests; a manifest without packages keeps its row.
    """
    rows = (with_file_class(files).where(F.col("file_class") == "manifest")
            .select("repo_id", F.col("path").alias("source"), F.col("name").alias("kind"), "content"))
    parsed = rows.select("repo_id", "source", "kind", *_native_parsers(),
                         manifests.pyproject_packages(_only("pyproject.toml")).alias("toml"))
    return parsed.select(
        "repo_id", "source", "kind", "kind_rank",
        F.coalesce("pip", "npm.packages", "toml.packages", "go", "cargo", no_strings())
        .alias("packages"),
        strip(F.col("npm.main")).alias("main"),
        F.col("npm.root_error").alias("root_error"),
        F.coalesce("npm.section_error", "toml.error").alias("error"),
    )


def extract_dependencies(files: DataFrame) -> DataFrame:
    """``(repo_id, source, kind, pos, package)``; ``pos`` and ``package`` are NULL when empty."""
    return parse_manifests(files).select(
        "repo_id", "source", "kind", F.posexplode_outer("packages").alias("pos", "package"))


def dependency_purposes(deps: DataFrame, column: str = "package") -> DataFrame:
    """Add ``purpose``: by exact normalised name, by naming convention, or the sentinel."""
    purposes = dimension(deps.sparkSession, catalogs.PURPOSES.items(), "dep_key, known_purpose")
    return (deps.withColumn("dep_key", normalise_dep(column))
            .join(F.broadcast(purposes), "dep_key", "left")
            .withColumn("purpose", F.coalesce("known_purpose", purpose_by_convention("dep_key")))
            .drop("dep_key", "known_purpose"))
