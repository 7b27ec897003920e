"""Repository records: assembling them from facts, reading them from JSON, checking limits."""

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens import catalogs, schemas
from fleetlens.functions import paths
from fleetlens.functions.text import computed, head, literal_map, no_strings
from fleetlens.operators import inventory
from fleetlens.operators.dependencies import parse_manifests
from fleetlens.operators.guide import RECORD_FIELDS
from fleetlens.session import dimension
from fleetlens.sources.files import dirs_of, is_file, with_file_class

# How the messages of the limits name the lists.
_LISTS = {"languages": "languages list", "frameworks": "frameworks list",
          "important_files": "important_files", "dependencies": "dependencies"}
LIST_LIMITS = {
    "languages": catalogs.MAX_LANG_OR_FW,
    "frameworks": catalogs.MAX_LANG_OR_FW,
    "important_files": catalogs.MAX_IMPORTANT_FILES,
    "dependencies": catalogs.MAX_DEPENDENCIES,
}


# ---------------------------------------------------------------- records from file facts

_ENTRY_RANK = {name: i for i, name in enumerate(catalogs.ENTRY_POINTS)}
_LABELLED = tuple(catalogs.IMPORTANT_FILES)


def path_items(files: DataFrame) -> DataFrame:
    """``(repo_id, section, key, n)``: every fact the paths hold, from a single scan.

    One file yields a few small rows that are counted before the shuffle, so the exchange
    carries one row per distinct fact and task whatever the size of a repository.
    """
    path, name = F.col("path"), F.col("name")
    top = F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1)).otherwise("")
    known = dimension(files.sparkSession, catalogs.LANGUAGES.items(), "extension, language")
    facts = [
        # A repository without a visible file is known by the directories where the walk stopped.
        ("files", F.lit(True), F.when(is_file(), "file").otherwise("directory")),
        ("languages", F.col("language").isNotNull(), F.col("language")),
        ("important_files", name.isin(*_LABELLED), path),
        ("top_level_dirs", top != "", top),
        ("entry_points", name.isin(*catalogs.ENTRY_POINTS), path),
        ("names", name.isin(*inventory.MARKER_NAMES), name),
        ("tests", inventory.looks_tested(path, name), F.lit("")),
    ]
    rows = F.array(*[F.when(ok, F.struct(F.lit(section).alias("section"), key.alias("key")))
                     for section, ok, key in facts])
    return (
        with_file_class(files).where(F.col("repo_id").isNotNull())
        .select("repo_id", "path", "name", "file_class", paths.extension("name").alias("extension"))
        .join(F.broadcast(known), "extension", "left")
        .select("repo_id", F.explode(rows).alias("r")).where(F.col("r").isNotNull())
        .groupBy("repo_id", "r.section", "r.key").agg(F.count(F.lit(1)).alias("n")))


def _content_items(files: DataFrame) -> DataFrame:
    """``(repo_id, section, rank, key, values)`` from manifests and READMEs."""
    parsed = parse_manifests(files)
    main = paths.join_path(paths.dir_of("source"), F.col("main"))
    failure = F.coalesce("root_error", "error")
    # A package.json that is not an object is met before any other problem.
    failure_rank = F.when(F.col("root_error").isNotNull(), 0).otherwise(F.col("kind_rank"))

    def item(section, rank, values):
        return F.struct(F.lit(section).alias("section"), rank.cast("int").alias("rank"),
                        F.col("source").alias("key"), values.alias("values"))

    rows = F.array(
        item("dependencies", F.col("kind_rank"), F.col("packages")),
        F.when(F.col("main") != "", item("mains", F.col("kind_rank"), F.array(main))),
        F.when(failure.isNotNull(), item("errors", failure_rank, F.array(failure))))
    manifests = (parsed.where(F.col("repo_id").isNotNull())
                 .select("repo_id", F.explode(rows).alias("r")).where(F.col("r").isNotNull())
                 .select("repo_id", "r.*"))
    titles = inventory.pick_readme(files).where(F.col("repo_id").isNotNull()).select(
        "repo_id", F.lit("title").alias("section"), F.lit(0).alias("rank"),
        F.col("path").alias("key"), F.array(inventory.readme.readme_title("raw")).alias("values"))
    return manifests.unionByName(titles)


def _items(files: DataFrame) -> DataFrame:
    """All facts of all repositories as one long table."""
    from_paths = path_items(files).select(
        "repo_id", "section", F.lit(0).alias("rank"), "key",
        F.array("key").alias("values"), "n")
    from_content = _content_items(files).select(
        "repo_id", "section", "rank", "key", "values", F.lit(1).cast("long").alias("n"))
    return from_paths.unionByName(from_content)


def _count(section: str, amount=None) -> Column:
    amount = F.lit(1) if amount is None else amount
    return F.coalesce(F.sum(F.when(F.col("section") == section, amount)), F.lit(0)).cast("long")


def _fact_columns() -> list[Column]:
    """Scalar facts and entry counts, for an aggregate of items by repository."""
    def has(*names):
        return F.bool_or((F.col("section") == "names") & F.col("key").isin(*names))

    return [
        _count("files", F.when(F.col("key") == "file", F.col("n"))).alias("total_files"),
        inventory.project_type(has).alias("type"),
        F.bool_or(F.col("section") == "tests").alias("has_tests"),
        has(*catalogs.CI_MARKERS).alias("has_ci"),
        has(*catalogs.DOCKER_MARKERS).alias("has_docker"),
        _count("errors").alias("n_errors")]


def _facts(items: DataFrame, *more: Column) -> DataFrame:
    """Scalar facts and entry counts per repository; partial sums before the shuffle."""
    return items.groupBy("repo_id").agg(*_fact_columns(), *more)


def _first_error() -> Column:
    """The first problem that makes the whole analysis an error, for an aggregate of items by repository."""
    problem = F.when(F.col("section") == "errors", F.struct("rank", "key", head(F.col("values")).alias("text")))
    return F.concat(F.lit("Unexpected error during analysis: "), F.min(problem)["text"]).alias("error")


def _errors(files: DataFrame) -> DataFrame:
    """The first problem of each repository that makes its whole analysis an error."""
    return _content_items(files).where(F.col("section") == "errors").groupBy("repo_id").agg(_first_error())


def repo_facts(files: DataFrame) -> DataFrame:
    """Scalar facts of every repository; ``status`` is ``error`` where a manifest breaks it."""
    dirs = dirs_of(files).groupBy("repo_id").agg(F.count(F.lit(1)).alias("total_dirs"))
    # The error comes from the same items: joined on, every manifest would be parsed a second time.
    return (_facts(_items(files), _first_error()).join(dirs, "repo_id", "left")
            .select("repo_id",
                    F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"), "error",
                    "total_files", F.coalesce("total_dirs", F.lit(0)).alias("total_dirs"),
                    "type", "has_tests", "has_ci", "has_docker"))


def record_items(files: DataFrame) -> DataFrame:
    """``(repo_id, section, pos, text)``: the entries of every record as rows, however many there are.

    Records hold the same as arrays; a repository too large for one row is read here.
    """
    order = F.struct("rank", F.when(F.col("section") == "languages", -F.col("n")).otherwise(F.lit(0).cast("long")).alias("o"),
                     F.when(F.col("section") == "entry_points", _entry_rank("key")).otherwise(0).alias("e"), "key")
    listed = _items(files).where(F.col("section").isin(
        "languages", "important_files", "dependencies", "top_level_dirs", "entry_points", "mains"))
    return listed.select("repo_id", "section", order.alias("pos"), F.posexplode("values").alias("i", "text")).select(
        "repo_id", "section", F.struct("pos.*", "i").alias("pos"), "text")


def assemble_analyses(files: DataFrame) -> DataFrame:
    """Records of scanned files: one for every repository that :func:`rejected_repositories` doesn't name.

    Nothing is cut; which limits a record breaks is told by :func:`validate_limits`.
    """
    return _records(_items(files))


def rejected_repositories(files: DataFrame) -> DataFrame:
    """``(repo_id, reason)`` of every repository that has no record: a manifest breaks its analysis."""
    return _errors(files).withColumnRenamed("error", "reason")


_SCALARS = ("type", "has_tests", "has_ci", "has_docker")


def _entry_rank(path) -> Column:
    return F.element_at(literal_map(_ENTRY_RANK), F.lower(paths.basename(path)))


def _records(items: DataFrame) -> DataFrame:
    def listed(section, *order):
        return F.sort_array(F.collect_list(F.when(
            F.col("section") == section, F.struct(*order, F.col("values"))))).alias(section)

    # The scalars come from the same aggregate: joined on, all items would be made twice.
    lists = _facts(
        items,
        listed("languages", (-F.col("n")).alias("o"), "key"),
        listed("important_files", "key"),
        listed("dependencies", "rank", "key"),
        listed("top_level_dirs", "key"),
        listed("entry_points", _entry_rank("key").alias("o"), "key"),
        listed("mains", "key"),
        F.max(F.when(F.col("section") == "title", head(F.col("values")))).alias("project_name")).where(F.col("n_errors") == 0)

    def flat(section):
        return F.flatten(F.transform(section, lambda r: r["values"]))

    files = F.transform(flat("important_files"), lambda p: F.struct(
        p.alias("path"),
        F.element_at(literal_map(catalogs.IMPORTANT_FILES), F.lower(paths.basename(p)))
        .alias("description"), F.lit(True).alias("is_entry")))
    nothing = F.lit(None).cast("string")
    dependencies = F.transform(flat("dependencies"), lambda n: F.struct(
        n.alias("name"), nothing.alias("version"), nothing.alias("type"),
        F.lit(False).alias("is_entry")))
    entries = F.array_distinct(F.concat(flat("entry_points"), flat("mains")))
    structure = F.to_json(F.struct(
        *_SCALARS, flat("top_level_dirs").alias("top_level_dirs"),
        entries.alias("entry_points")))
    return lists.select(
        "repo_id", F.lit(1).alias("schema_version"), "project_name",
        flat("languages").alias("languages"), no_strings().alias("frameworks"),
        files.alias("important_files"), dependencies.alias("dependencies"),
        structure.alias("project_structure"))


def _too_many(section, n, limit) -> Column:
    return F.when(n > limit, F.format_string(
        f"{_LISTS[section]} exceeds limit of {limit} items (got %d)", n.cast("long")))


_STRUCTURE_TOO_BIG = (f"project_structure exceeds size limit of "
                      f"{catalogs.MAX_STRUCTURE_BYTES // 1024} KiB when serialised")


# ---------------------------------------------------------------- records from JSON

def _kind(v) -> Column:
    """JSON kind of a VARIANT: STRING, BIGINT, ARRAY…, OBJECT…, VOID; NULL when absent."""
    return F.schema_of_variant(v)


def _get(v, path, to) -> Column:
    return F.try_variant_get(v, path, to)


def parse_analyses(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """``(records, bad)`` from JSON text; ``bad`` keeps the row with a ``reason``.

    Entries given as bare strings become structs with NULL extras and ``is_entry = false``.
    """
    text = F.col(column)
    fields = F.from_json(text, schemas.ANALYSIS_INPUT, {"allowSingleQuotes": "false"})
    raw = F.from_json(text, "map<string,string>", {"allowSingleQuotes": "false"})
    rows = computed(df, _f=fields, _raw=raw)

    def variant(name):
        return F.col(f"_f.{name}")

    def is_null(name):
        return variant(name).isNull() | F.is_variant_null(variant(name))

    def is_array(v):
        return F.startswith(_kind(v), F.lit("ARRAY"))

    def is_object(v):
        return F.startswith(_kind(v), F.lit("OBJECT"))

    def is_text(v):
        return _kind(v) == "STRING"

    def members(name):
        return F.coalesce(_get(variant(name), "$", "array<variant>"),
                          F.array().cast("array<variant>"))

    def optional_text(v, path):
        inner = _get(v, path, "variant")
        return inner.isNull() | F.is_variant_null(inner) | is_text(inner)

    def file_ok(v):
        return is_text(v) | (is_object(v) & is_text(_get(v, "$.path", "variant"))
                             & optional_text(v, "$.description"))

    def dependency_ok(v):
        kind = _get(v, "$.type", "variant")
        return is_text(v) | (
            is_object(v) & is_text(_get(v, "$.name", "variant")) & optional_text(v, "$.version")
            & (kind.isNull() | F.is_variant_null(kind)
               | F.coalesce(_get(v, "$.type", "string").isin(*catalogs.DEPENDENCY_TYPES), F.lit(False))))

    def list_problem(name, ok):
        present = variant(name).isNotNull()
        return F.when(present & ~is_array(variant(name)), f"{name}: not a list").when(
            F.exists(members(name), lambda v: ~F.coalesce(ok(v), F.lit(False))),
            f"{name}: invalid entry")

    reason = F.when(F.col("_f").isNull() | F.col("_raw").isNull(), "not a JSON object").otherwise(
        F.coalesce(
            F.when(~is_null("project_name") & ~is_text(variant("project_name")),
                   "project_name: not a string"),
            # A whole number may be written 1.0; 1.5 and true are no versions.
            F.when(variant("schema_version").isNotNull() & ~F.coalesce(
                _kind(variant("schema_version")).rlike("^(BIGINT|DECIMAL|DOUBLE)")
                & (_get(variant("schema_version"), "$", "double")
                   == F.floor(_get(variant("schema_version"), "$", "double"))), F.lit(False)),
                   "schema_version: not an integer"),
            list_problem("languages", is_text), list_problem("frameworks", is_text),
            list_problem("important_files", file_ok), list_problem("dependencies", dependency_ok),
            F.when(~is_null("project_structure") & ~is_object(variant("project_structure"))
                   & ~is_array(variant("project_structure")), "project_structure: invalid"),
            F.when(is_array(variant("project_structure"))
                   & F.exists(members("project_structure"), lambda v: ~is_text(v)),
                   "project_structure: invalid"),
        ))
    rows = computed(rows, reason=reason)

    def texts(name):
        return F.transform(members(name), lambda v: v.cast("string"))

    def field(v, name):
        return F.when(is_object(v), _get(v, f"$.{name}", "string"))

    records = rows.where(F.col("reason").isNull()).select(
        *df.columns,
        F.coalesce(_get(variant("schema_version"), "$", "int"), F.lit(1)).alias("schema_version"),
        _get(variant("project_name"), "$", "string").alias("project_name"),
        texts("languages").alias("languages"), texts("frameworks").alias("frameworks"),
        F.transform(members("important_files"), lambda v: F.struct(
            F.when(is_text(v), v.cast("string")).otherwise(field(v, "path")).alias("path"),
            field(v, "description").alias("description"), is_object(v).alias("is_entry")))
        .alias("important_files"),
        F.transform(members("dependencies"), lambda v: F.struct(
            F.when(is_text(v), v.cast("string")).otherwise(field(v, "name")).alias("name"),
            field(v, "version").alias("version"), field(v, "type").alias("type"),
            is_object(v).alias("is_entry"))).alias("dependencies"),
        # The raw text keeps the key order of the structure.
        F.element_at("_raw", "project_structure").alias("project_structure"))
    bad = rows.where(F.col("reason").isNotNull()).select(*df.columns, "reason")
    return records, bad


def limit_violations(analyses: DataFrame) -> DataFrame:
    """``(…, violations ARRAY<STRING>)``: every limit a record breaks."""
    def longer(c):
        return F.length(c) > catalogs.MAX_STRING

    def text_limit(name):
        return F.lit(f"{name} exceeds {catalogs.MAX_STRING} characters")

    files, deps = F.col("important_files"), F.col("dependencies")
    checks = [
        F.when(longer("project_name"), text_limit("project_name")),
        *[_too_many(s, F.size(s), limit) for s, limit in LIST_LIMITS.items()],
        F.when(F.exists("languages", longer), text_limit("language name")),
        F.when(F.exists("frameworks", longer), text_limit("framework name")),
        F.when(F.exists(files, lambda f: longer(f["path"])), text_limit("important_files path string")),
        F.when(F.exists(files, lambda f: longer(f["description"])),
               text_limit("important_files description")),
        F.when(F.exists(deps, lambda d: longer(d["name"])), text_limit("dependency name string")),
        F.when(F.exists(deps, lambda d: longer(d["version"])), text_limit("dependency version")),
        F.when(structure_bytes("project_structure") > catalogs.MAX_STRUCTURE_BYTES,
               F.lit(_STRUCTURE_TOO_BIG)),
    ]
    return computed(analyses, violations=F.filter(F.array(*checks), lambda v: v.isNotNull()))


def structure_bytes(c) -> Column:
    """UTF-8 bytes of a compact JSON text written with one space after ``,`` and ``:``."""
    outside = F.regexp_replace(F.col(c) if isinstance(c, str) else c, r'"(?:[^"\\]|\\.)*+"', "")
    return F.octet_length(c) + F.length(F.regexp_replace(outside, "[^,:]", ""))


def validate_limits(analyses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(ok, violations)``; the second has one row per broken limit."""
    checked = limit_violations(analyses)
    ok = checked.where(F.size("violations") == 0).drop("violations")
    keys = [c for c in analyses.columns if c not in RECORD_FIELDS]
    broken = checked.select(*keys, F.explode("violations").alias("violation"))
    return ok, broken
