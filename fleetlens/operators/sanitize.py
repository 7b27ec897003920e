"""Redaction of secrets in records, and secret scans of whole columns."""

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens import catalogs
from fleetlens.functions.secrets import secret_file_pattern, secret_value_pattern
from fleetlens.functions.text import computed, concat_all, no_strings, safe_preview


def scan_secrets(df: DataFrame, column: str) -> DataFrame:
    """Rows whose value holds a secret, with ``pattern`` and a harmless ``preview``."""
    return (df.withColumn("pattern", secret_value_pattern(column))
            .where(F.col("pattern").isNotNull())
            .withColumn("preview", safe_preview(column)).drop(column))


def scan_secret_files(files: DataFrame) -> DataFrame:
    """Files whose name alone marks them as holding a secret."""
    return (files.select("repo_id", "path", secret_file_pattern("path").alias("pattern"))
            .where(F.col("pattern").isNotNull()))


def _found(column: str) -> Column:
    """``ARRAY<STRUCT<value, pattern>>`` of a list of strings."""
    return F.transform(column, lambda v: F.struct(
        v.alias("value"), secret_value_pattern(v).alias("pattern")))


def _found_files() -> Column:
    return F.transform("important_files", lambda f: F.struct(
        f.alias("entry"), secret_file_pattern(f["path"]).alias("by_name"),
        secret_value_pattern(f["path"]).alias("by_value"),
        secret_value_pattern(f["description"]).alias("described")))


def _found_dependencies() -> Column:
    return F.transform("dependencies", lambda d: F.struct(
        d.alias("entry"), secret_value_pattern(d["name"]).alias("name"),
        secret_value_pattern(d["version"]).alias("version")))


def _event(where, pattern) -> Column:
    """Notice of a redaction, NULL when ``pattern`` is."""
    return F.concat(where, F.lit(" matched "), pattern)


def _at(field: str, i: Column, tail: str = "") -> Column:
    return F.concat(F.lit(f"{field}["), i.cast("string"), F.lit(f"]{tail}"))


def _file_events(f: Column, i: Column) -> Column:
    named, field = f["by_name"].isNotNull(), "important_files"
    path = F.when(f["entry"]["is_entry"], _at(field, i, ".path")) \
        .when(named, _at(field, i, " path")).otherwise(_at(field, i))
    return F.array(
        _event(path, F.coalesce(f["by_name"], f["by_value"])),
        F.when(~named, _event(_at(field, i, ".description"), f["described"])))


def _dependency_events(d: Column, i: Column) -> Column:
    name = F.when(d["entry"]["is_entry"], _at("dependencies", i, ".name")) \
        .otherwise(_at("dependencies", i))
    return F.array(_event(name, d["name"]), _event(_at("dependencies", i, ".version"), d["version"]))


def _hidden(value, condition) -> Column:
    return F.when(condition, F.lit(catalogs.REDACTED)).otherwise(value)


def _clean_file(f: Column) -> Column:
    entry, named = f["entry"], f["by_name"].isNotNull()
    return F.struct(
        _hidden(entry["path"], named | f["by_value"].isNotNull()).alias("path"),
        _hidden(entry["description"], (named & entry["is_entry"]) | f["described"].isNotNull())
        .alias("description"),
        entry["is_entry"].alias("is_entry"))


def _clean_dependency(d: Column) -> Column:
    entry = d["entry"]
    return F.struct(_hidden(entry["name"], d["name"].isNotNull()).alias("name"),
                    _hidden(entry["version"], d["version"].isNotNull()).alias("version"),
                    entry["type"].alias("type"), entry["is_entry"].alias("is_entry"))


# A JSON string literal, with the mark that follows it: a key is followed by a colon.
_JSON_STRING = r'"((?:[^"\\]|\\.)*+)"(\s*:)?'


def _found_leaves(c: str) -> Column:
    """``ARRAY<STRUCT<raw, event>>``: every string of a JSON text in document order.

    A value is searched as text first, then as a file name; keys are left alone.
    """
    def leaf(raw):
        is_key = F.endswith(raw, F.lit(":"))
        text = F.get(F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>"), F.lit(0))
        event = F.coalesce(_event(F.lit("project_structure leaf"), secret_value_pattern(text)),
                           _event(F.lit("project_structure filename"), secret_file_pattern(text)))
        return F.struct(raw.alias("raw"), F.when(~is_key, event).alias("event"))

    return F.transform(F.regexp_extract_all(F.col(c), F.lit(_JSON_STRING), F.lit(0)), leaf)


def _clean_structure(c: str) -> Column:
    """The JSON text with every secret value replaced; keys stay."""
    shown = F.transform("_leaves", lambda l: F.when(
        l["event"].isNotNull(), F.lit(f'"{catalogs.REDACTED}"')).otherwise(l["raw"]))
    woven = F.transform(F.arrays_zip(F.split(c, _JSON_STRING).alias("gap"), shown.alias("leaf")),
                        lambda z: F.concat(z["gap"], F.coalesce(z["leaf"], F.lit(""))))
    secret = F.exists("_leaves", lambda l: l["event"].isNotNull())
    return F.when(secret, F.array_join(woven, "")).otherwise(F.col(c))


def sanitize(analyses: DataFrame) -> DataFrame:
    """Records with secrets replaced, plus ``redactions ARRAY<STRING>`` in field order.

    Every list is searched once and rewritten in place: no shuffle.
    """
    rows = computed(
        analyses, _name=secret_value_pattern("project_name"), _langs=_found("languages"),
        _fws=_found("frameworks"), _files=_found_files(), _deps=_found_dependencies(),
        _leaves=_found_leaves("project_structure"))

    def string_events(found, field):
        return F.transform(found, lambda v, i: _event(_at(field, i), v["pattern"]))

    def clean_strings(found):
        return F.transform(found, lambda v: _hidden(v["value"], v["pattern"].isNotNull()))

    events = concat_all(
        F.array(_event(F.lit("project_name"), F.col("_name"))),
        string_events("_langs", "languages"), string_events("_fws", "frameworks"),
        F.flatten(F.transform("_files", _file_events)),
        F.flatten(F.transform("_deps", _dependency_events)),
        F.coalesce(F.transform("_leaves", lambda l: l["event"]), no_strings()))
    others = [c for c in analyses.columns if c not in _CLEANED]
    return rows.select(
        *others, _hidden(F.col("project_name"), F.col("_name").isNotNull()).alias("project_name"),
        clean_strings("_langs").alias("languages"), clean_strings("_fws").alias("frameworks"),
        F.transform("_files", _clean_file).alias("important_files"),
        F.transform("_deps", _clean_dependency).alias("dependencies"),
        _clean_structure("project_structure").alias("project_structure"),
        F.filter(events, lambda e: e.isNotNull()).alias("redactions"))


_CLEANED = {"project_name", "languages", "frameworks", "important_files", "dependencies",
            "project_structure"}


def redactions(sanitized: DataFrame) -> DataFrame:
    """``(…, pos, field_path, pattern)``, one row per redaction."""
    others = [c for c in sanitized.columns if c not in _CLEANED | {"redactions", "schema_version"}]
    event = r"(?s)^(.*) matched (\w+)$"
    return (sanitized.select(*others, F.posexplode("redactions").alias("pos", "event"))
            .select(*others, "pos", F.regexp_extract("event", event, 1).alias("field_path"),
                    F.regexp_extract("event", event, 2).alias("pattern")))
