"""Grounding audit of guides against the records they were written from."""

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.functions import paths
from fleetlens.functions.text import concat_all, no_strings, py_repr


def known_names(record=F.col) -> Column:
    """Lower-cased names a guide may mention: languages, frameworks, dependencies, paths and
    their components, and the project name."""
    files = F.transform(record("important_files"), lambda f: F.lower(f["path"]))
    parts = F.flatten(F.transform(files, lambda p: F.split(paths.posix(p), "/")))
    name = F.when(record("project_name") != "", F.array(F.lower(record("project_name"))))
    return F.array_distinct(concat_all(
        F.transform(record("languages"), F.lower), F.transform(record("frameworks"), F.lower),
        F.transform(record("dependencies"), lambda d: F.lower(d["name"])),
        files, parts, F.coalesce(name, no_strings())))


def with_audit(guides: DataFrame, analyses: DataFrame, key: str, named_in=F.col) -> DataFrame:
    """Guides with ``failures ARRAY<STRING>``.

    Both sides hold one bounded row per record, so a single join on the key is all that moves;
    the name checks run inside the row.  ``named_in`` gives the column of a field of the guide.
    """
    facts = analyses.select(key, known_names().alias("_known"))

    def unknown(column, field, label, ok):
        bad = F.filter(F.coalesce(named_in(column), F.array()), lambda e: ~ok(F.lower(e[field])))
        return F.transform(bad, lambda e: F.concat(F.lit(f"{label} not in input: "), py_repr(e[field])))

    def named(n):
        return F.array_contains("_known", n)

    def path_named(p):
        return named(p) | F.arrays_overlap("_known", F.split(paths.posix(p), "/"))

    failures = concat_all(
        unknown("tech_stack", "name", "tech_stack name", named),
        unknown("important_files", "path", "important_files path", path_named),
        unknown("dependencies", "name", "dependency name", named))
    return guides.join(facts, key).withColumn("failures", failures).drop("_known")


def grounding_failures(guides: DataFrame, analyses: DataFrame, key: str) -> DataFrame:
    """``(key, pos, failure)``: every name in a guide that its record does not contain."""
    return (with_audit(guides, analyses, key)
            .select(key, F.posexplode("failures").alias("pos", "failure")))


def audit_summary(sanitized: DataFrame, audited: DataFrame, key: str) -> DataFrame:
    """Redaction and audit-failure counts per record."""
    return (sanitized.select(key, F.size("redactions").alias("n_redactions"))
            .join(audited.select(key, F.size("failures").alias("n_failures")), key))
