"""Architecture signals and the diagram drawn from them."""

import re

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens import catalogs
from fleetlens.functions.text import col, literal_map, sql_literal, strings

TIERS = {
    "frontend": catalogs.FRONTEND_SIGNALS,
    "backend": catalogs.BACKEND_SIGNALS,
    "database": catalogs.DATABASE_SIGNALS,
}


def _node_id(signal: str) -> str:
    return "Ext_" + re.sub(r"[. \-]", "_", signal).replace("@", "").title()


def signal_names(frameworks, dependencies) -> Column:
    """Lower-cased names in which signals are looked for."""
    return F.transform(F.concat(col(frameworks), col(dependencies)), F.lower)


def tier_present(names: Column, tier: str, exact: bool = False) -> Column:
    """Whether any signal of the tier is part of any name (or is the name, when exact)."""
    signals = TIERS[tier]
    if exact:
        return F.arrays_overlap(names, strings(signals))
    pattern = "|".join(re.escape(s) for s in signals)
    return F.exists(names, lambda n: n.rlike(pattern))


def services(names: Column, exact: bool = False) -> Column:
    """Sorted external services found in the names."""
    known = strings(sorted(catalogs.SERVICE_SIGNALS))
    if exact:
        return F.array_sort(F.array_intersect(known, names))
    return F.filter(known, lambda s: F.exists(names, lambda n: F.contains(n, s)))


def architecture_signals(names: DataFrame, column: str = "name", exact: bool = False) -> DataFrame:
    """``(…, tier, signal)`` for every signal found in ``column``.

    The signals are inlined, so matching is a projection: no join and no shuffle.
    """
    name = F.lower(col(column))
    every = [(t, s) for t, signals in {**TIERS, "external": catalogs.SERVICE_SIGNALS}.items()
             for s in signals]
    table = F.expr("array({})".format(", ".join(
        f"named_struct('tier', {sql_literal(t)}, 'signal', {sql_literal(s)})" for t, s in every)))
    found = F.filter(table, lambda e: (name == e["signal"]) if exact
                     else F.contains(name, e["signal"]))
    return (names.withColumn("_hit", F.explode(found))
            .select(*names.columns, "_hit.tier", "_hit.signal"))


def signals_by_dictionary(names: DataFrame, column: str = "name") -> DataFrame:
    """The rows of :func:`architecture_signals`, each distinct name searched once, whatever the number of rows that use it.

    Names repeat across a fleet far more often than signals match: the dictionary of distinct names that match any
    signal is small beside the rows, and it is joined back by name.
    """
    low = F.lower(col(column))
    known = architecture_signals(names.select(low.alias("_name")).distinct(), "_name")
    return names.withColumn("_name", low).join(known, "_name").select(*names.columns, "tier", "signal")


def architecture_summary(names: DataFrame, column: str = "name") -> DataFrame:
    """Tier flags and the sorted services per repository."""
    hits = architecture_signals(names.select("repo_id", col(column).alias("name")))
    # collect_set holds at most one entry per known service.
    return hits.groupBy("repo_id").agg(
        *[F.bool_or(F.col("tier") == t).alias(f"has_{t}") for t in TIERS],
        F.array_sort(F.collect_set(F.when(F.col("tier") == "external", F.col("signal"))))
        .alias("services"))


def architecture_edges(summary: DataFrame) -> DataFrame:
    """``edges(repo_id, ord, src, dst)``."""
    both = [("Frontend", "Backend", F.col("has_frontend") & F.col("has_backend")),
            ("Backend", "Database", F.col("has_backend") & F.col("has_database"))]
    fixed = F.array(*[F.when(c, F.struct(F.lit(s).alias("src"), F.lit(d).alias("dst")))
                      for s, d, c in both])
    fixed = F.filter(fixed, lambda e: e.isNotNull())
    outer = F.transform(F.filter(F.col("services"), lambda s: F.col("has_backend")),
                        lambda s: F.struct(F.lit("Backend").alias("src"), service_node(s).alias("dst")))
    return (summary.select("repo_id", F.posexplode(F.concat(fixed, outer)).alias("ord", "edge"))
            .select("repo_id", "ord", "edge.src", "edge.dst"))


def service_node(signal: Column) -> Column:
    return F.element_at(literal_map({s: _node_id(s) for s in catalogs.SERVICE_SIGNALS}), signal)


def service_label(signal: Column) -> Column:
    return F.element_at(literal_map({s: s.title() for s in catalogs.SERVICE_SIGNALS}), signal)


def diagram(has_frontend, has_backend, has_database, found) -> Column:
    """Mermaid text of the detected nodes and the edges between them."""
    found = col(found)

    def line(condition, text):
        return F.when(condition, F.lit(text))

    nodes = F.transform(found, lambda s: F.concat(
        F.lit("    "), service_node(s), F.lit('["'), service_label(s), F.lit('"]')))
    edges = F.transform(F.filter(found, lambda s: has_backend),
                        lambda s: F.concat(F.lit("    Backend --> "), service_node(s)))
    nothing = ~(has_frontend | has_backend | has_database) & (F.size(found) == 0)
    # concat_ws drops the NULL lines.
    return F.concat_ws(
        "\n",
        F.lit("graph TD"),
        line(has_frontend, '    Frontend["Frontend"]'),
        line(has_backend, '    Backend["Backend / API"]'),
        line(has_database, '    Database[("Database")]'),
        nodes,
        line(has_frontend & has_backend, "    Frontend --> Backend"),
        line(has_backend & has_database, "    Backend --> Database"),
        edges,
        line(nothing, f'    Unknown["{catalogs.DIAGRAM_UNKNOWN}"]'),
    )
