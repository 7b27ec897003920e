"""Where each guide section comes from, and summary counts."""

from pyspark.sql import DataFrame, functions as F

from fleetlens import catalogs
from fleetlens.functions.text import no_strings


def section_provenance(guides: DataFrame, key: str) -> DataFrame:
    """``(key, section, badge, reasons)`` for the nine guide sections.

    The sections are a constant array inside the row; exploding it needs no join.
    """
    sections = F.array(*[F.struct(F.lit(s).alias("section"), F.lit(l).alias("title"))
                         for s, l in catalogs.SECTION_LABELS.items()])
    rows = guides.select(key, "used_llm", F.explode(sections).alias("s"), F.coalesce(
        "data_completeness_notes", no_strings()).alias("notes"))
    section, title = F.col("s.section"), F.col("s.title")
    rows = rows.select(key, "used_llm", section.alias("section"), title.alias("title"), F.filter(
        "notes", lambda n: F.startswith(n, F.concat(section, F.lit(":")))).alias("own"))
    noted, diagram = F.size("own") > 0, F.col("section") == "architecture_diagram"
    badge = (
        F.when(noted, "No data detected")
        .when(diagram, "Pattern-matched")
        .when(F.col("section") == "important_files", "Repository-derived")
        .when(F.col("used_llm"), "AI-generated")
        .otherwise("Rule-based"))
    first = (
        F.when(diagram & noted, catalogs.REASON_DIAGRAM_EMPTY)
        .when(diagram, catalogs.REASON_DIAGRAM)
        .when(F.col("used_llm"), F.concat("title", F.lit(catalogs.REASON_MODEL)))
        .otherwise(F.concat("title", F.lit(catalogs.REASON_RULES))))
    own = F.transform("own", lambda n: F.regexp_replace(n, r"(?s)^[^:]+:\s*", ""))
    return rows.select(key, "section", badge.alias("badge"),
                       F.concat(F.array(first), own).alias("reasons"))


def evidence_files(guides: DataFrame, key: str, shown: int | None = None) -> DataFrame:
    """``(key, files, n_more)``: the detected files, or the first ``shown`` and how many more there are."""
    files = F.filter(F.transform("important_files", lambda f: f["path"]), lambda p: p != "")
    if shown is None:
        return guides.select(key, files.alias("files"), F.lit(0).alias("n_more"))
    return guides.select(key, F.slice(files, 1, shown).alias("files"),
                         F.greatest(F.size(files) - shown, F.lit(0)).alias("n_more"))


def summary_counts(guides: DataFrame, key: str) -> DataFrame:
    return guides.select(
        key, F.size("tech_stack").alias("n_technologies"),
        F.size("important_files").alias("n_key_files"),
        F.size("dependencies").alias("n_dependencies"))
