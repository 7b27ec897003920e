"""Records, audits, redactions and guide steps as rows, for repositories that fit no single row.

The array forms gather a repository into one record. Here an entry stays a row from the scan to the
result: names are looked up by (repository, name), lock files by (repository, directory), so the
largest repository is spread by its own names and directories. What a repository's steps depend on as a
whole is its digest: of every kind of file the first path, and of the dependencies those that
rules name. The digest has a bounded size, and the rules that write texts are the guide's own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens import catalogs, schemas
from fleetlens.functions import names, paths
from fleetlens.functions.secrets import secret_file_pattern, secret_value_pattern
from fleetlens.functions.text import head, literal_map, no_strings, one_of, py_repr
from fleetlens.operators import analysis, guide
from fleetlens.sources.landing import land

#: Dependencies that a rule of the steps names; any other only counts as one.
DECIDING = (*catalogs.ASGI_SERVERS, *catalogs.ASGI_FRAMEWORKS, "flask", *catalogs.TEST_DIR_SIGNALS)

#: The order of the steps' parts.
SETUP_PARTS = ("python", "node", "go", "rust", "template", "config", "start", "front", "docker", "nothing")
WORKFLOW_PARTS = ("start_found", "front", "python", "node", "go", "rust", "template", "config", "docker", "test", "ci", "runner",
                  "start_gap", "front_gap", "lock_gap", "template_gap", "nothing")


def accepted_items(files: DataFrame) -> DataFrame:
    """``(repo_id, section, rank, key, values, n)`` of all repositories that have a record."""
    items = analysis._items(files)
    # From the manifests alone: out of the items, every path would be read again to find none.
    broken = analysis.rejected_repositories(files).select("repo_id")
    return items.join(broken, "repo_id", "left_anti")


def entries(items: DataFrame) -> DataFrame:
    """``(repo_id, section, key, i, name)``: one row for every entry of a record."""
    listed = items.where(F.col("section").isin("languages", "important_files", "dependencies", "title"))
    return listed.select("repo_id", "section", "key", F.posexplode("values").alias("i", "name")).where(F.col("name").isNotNull())


#: Parts of whole repositories that only a workflow with any setup step has.
WORKFLOW_ONLY = ("start_found", "start_gap", "test", "ci")


# ---------------------------------------------------------------- audit

def known_names(rows: DataFrame) -> DataFrame:
    """``(repo_id, name)``, distinct: the lower-cased names that a text about a repository may mention."""
    low = F.lower("name")
    is_file, is_title = F.col("section") == "important_files", F.col("section") == "title"
    names_of = F.when(is_file, F.concat(F.array(low), F.split(paths.posix(low), "/"))).when(
        is_title & (F.col("name") == ""), no_strings()).otherwise(F.array(low))
    return rows.select("repo_id", F.explode(names_of).alias("name")).distinct()


_LABELS = {"tech_stack": "tech_stack name", "important_files": "important_files path", "dependencies": "dependency name"}


def grounding_failures(mentions: DataFrame, known: DataFrame) -> DataFrame:
    """``(repo_id, section, pos, failure)`` of the mentions ``(repo_id, section, pos, name)`` that no record entry backs.

    A path is backed by itself or by any of its components. Both joins are on (repository, name): known
    names are distinct, so nothing multiplies, and a repository's mentions spread over the tasks.
    """
    low = F.lower("name")
    single = mentions.where(F.col("section") != "important_files").withColumn("_name", low)
    of_files = mentions.where(F.col("section") == "important_files")
    tried = of_files.select("repo_id", "pos", F.explode(F.array_distinct(F.concat(
        F.array(low), F.split(paths.posix(low), "/")))).alias("_name"))
    lookup = known.select("repo_id", F.col("name").alias("_name"))
    backed = tried.join(lookup, ["repo_id", "_name"], "left_semi").select("repo_id", "pos").distinct()
    missing = single.join(lookup, ["repo_id", "_name"], "left_anti").drop("_name").unionByName(
        of_files.join(backed, ["repo_id", "pos"], "left_anti"))
    label = F.element_at(literal_map(_LABELS), F.col("section"))
    return missing.select("repo_id", "section", "pos", F.concat(label, F.lit(" not in input: "), py_repr("name")).alias("failure"))


def guide_mentions(guides: DataFrame, key: str) -> DataFrame:
    """The mentions of guides that are held as arrays."""
    fields = {"tech_stack": "name", "important_files": "path", "dependencies": "name"}

    def mentioned(column, field):
        return F.transform(F.coalesce(F.col(column), F.array().cast(guides.schema[column].dataType)), lambda e, i: F.struct(
            F.lit(column).alias("section"), i.alias("pos"), e[field].alias("name")))

    each = F.concat(*[mentioned(c, f) for c, f in fields.items()])
    return guides.select(F.col(key).alias("repo_id"), F.explode(each).alias("m")).select("repo_id", "m.*")


# ---------------------------------------------------------------- redaction

def redacted_entries(rows: DataFrame) -> DataFrame:
    """Entries with their secrets replaced and the ``pattern`` that matched (NULL for a clean entry); a projection."""
    pattern = F.when(F.col("section") == "important_files", F.coalesce(secret_file_pattern("name"), secret_value_pattern("name"))) \
        .otherwise(secret_value_pattern("name"))
    return rows.withColumn("pattern", pattern).withColumn(
        "name", F.when(F.col("pattern").isNotNull(), F.lit(catalogs.REDACTED)).otherwise(F.col("name")))


# ---------------------------------------------------------------- steps

def _kinds(f) -> Column:
    """The kinds of a file that decide steps."""
    kinds = [
        (guide._requirements(f), F.lit("requirements")),
        (one_of(f["name"], (*catalogs.MANIFESTS, "setup.py")), f["name"]),
        (one_of(f["name"], catalogs.WELL_KNOWN_ENTRIES), F.lit("entry")),
        (one_of(f["name"], catalogs.CONTAINER_FILES), F.lit("container")),
        (one_of(f["name"], catalogs.ENV_TEMPLATES), F.lit("template")),
        (one_of(f["name"], catalogs.CONFIG_FILES), F.lit("config")),
        (guide.looks_like_test(f), F.lit("test")),
    ]
    return F.filter(F.array(*[F.when(ok, kind) for ok, kind in kinds]), lambda k: k.isNotNull())


def _files(items: DataFrame) -> DataFrame:
    """``(repo_id, f)`` of the detected files, once each."""
    rows = items.where(F.col("section") == "important_files").select("repo_id", paths.rel_path("key").alias("path"))
    return rows.where(F.col("path") != "").distinct().select("repo_id", guide.shown_file(F.col("path")).alias("f"))


def digests(items: DataFrame) -> DataFrame:
    """One small record per repository that has the same repository-wide steps as the whole.

    Everything is counted or reduced per (repository, kind) before it meets, so no task sees a repository's rows.
    """
    firsts = _files(items).select("repo_id", F.explode(_kinds(F.col("f"))).alias("kind"), F.col("f.path").alias("path")) \
        .groupBy("repo_id", "kind").agg(F.min("path").alias("path"))
    files = firsts.select("repo_id", F.lit("important_files").alias("section"), "path", F.lit(0).alias("rank"))
    key = names.normalise_dep("name")
    deps = entries(items.where(F.col("section") == "dependencies")).select("repo_id", F.when(one_of(key, DECIDING), key).otherwise("other").alias("path")) \
        .distinct().select("repo_id", F.lit("dependencies").alias("section"), "path", F.lit(0).alias("rank"))
    languages = items.where(F.col("section") == "languages").select("repo_id", "section", F.col("key").alias("path"), F.lit(0).alias("rank"))
    order = F.struct(F.when(F.col("section") == "mains", 1).otherwise(0).alias("late"), F.coalesce(
        F.when(F.col("section") == "entry_points", analysis._entry_rank("key")), F.lit(0)).alias("rank"), F.col("key").alias("key"))
    entry = items.where(F.col("section").isin("entry_points", "mains")).groupBy("repo_id").agg(
        F.min_by(head(F.col("values")), order).alias("path")).select(
        "repo_id", F.lit("entry_points").alias("section"), "path", F.lit(0).alias("rank"))
    small = reduce(DataFrame.unionByName, [files, deps, languages, entry])

    def listed(section):
        return F.array_sort(F.collect_list(F.when(F.col("section") == section, F.col("path")))).alias(section)

    gathered = small.groupBy("repo_id").agg(*[listed(s) for s in ("important_files", "dependencies", "languages", "entry_points")])
    facts = analysis._facts(items).select("repo_id", "has_tests", "has_ci")
    titles = items.where(F.col("section") == "title").groupBy("repo_id").agg(F.max(head(F.col("values"))).alias("project_name"))
    whole = facts.join(gathered, "repo_id", "left").join(titles, "repo_id", "left")

    def some_of(section):
        return F.coalesce(section, no_strings())

    nothing = F.lit(None).cast("string")
    return whole.select(
        "repo_id", F.lit(1).alias("schema_version"), "project_name", some_of("languages").alias("languages"),
        no_strings().alias("frameworks"),
        F.transform(some_of("important_files"), lambda p: F.struct(p.alias("path"), nothing.alias("description"), F.lit(True).alias("is_entry")))
        .cast(f"array<{schemas.IMPORTANT_FILE}>").alias("important_files"),
        F.transform(some_of("dependencies"), lambda n: F.struct(
            n.alias("name"), nothing.alias("version"), nothing.alias("type"), F.lit(False).alias("is_entry")))
        .cast(f"array<{schemas.DEPENDENCY}>").alias("dependencies"),
        F.to_json(F.struct("has_tests", "has_ci", some_of("entry_points").alias("entry_points"))).alias("project_structure"))


def _rows(df: DataFrame, parts: dict[str, Column], path: Column) -> DataFrame:
    """``(repo_id, part, path, i, step)`` of the arrays ``parts``."""
    def numbered(part, texts):
        return F.transform(texts, lambda s, i: F.struct(F.lit(part).alias("part"), i.alias("i"), s.alias("step")))

    each = F.concat(*[numbered(n, a) for n, a in parts.items()])
    return df.select("repo_id", path.alias("path"), F.explode(each).alias("s")).select("repo_id", "s.part", "path", "s.i", "s.step")


def _whole_steps(digest: DataFrame) -> DataFrame:
    """The steps of each digest, every one computed once."""
    python, test = guide.python_install(), F.col("test")
    made = dict(
        python=F.when(python.isNotNull(), F.array(python)).otherwise(no_strings()), go=guide.go_install(), rust=guide.rust_install(),
        start=F.col("start_shown"), start_found=F.col("start_step"), docker=F.col("docker"), start_gap=_gap_texts(F.col("start_gap")),
        test=F.when(test.isNotNull(), F.array(test)).otherwise(no_strings()), ci=guide.ci_steps(),
        nothing=F.size("setup_found") == 0, home=F.col("entry_dir"))
    row = F.struct(*[value.alias(name) for name, value in made.items()])
    return digest.select("repo_id", F.inline(F.array(row)))


def steps(items: DataFrame) -> DataFrame:
    """``(repo_id, part, path, i, step)``: the steps and gaps of the setup guide and the workflow.

    Their order is that of the part (``SETUP_PARTS``, ``WORKFLOW_PARTS``), then of path and ``i``.
    """
    digest = land(_whole_steps(guide.with_steps(guide.with_signals(digests(items)))))
    parts = ("python", "go", "rust", "start", "start_found", "docker", "start_gap", "test", "ci")
    whole = _rows(digest, {**{p: F.when(F.col("nothing") & F.lit(p in WORKFLOW_ONLY), no_strings()).otherwise(F.col(p)) for p in parts},
                           "nothing": F.when(F.col("nothing"), F.array(F.lit(catalogs.NOT_DETECTED))).otherwise(no_strings())}, F.lit(""))
    files = _files(items)
    single = files.select("repo_id", F.col("f.path").alias("path"), F.array("f").alias("files"))
    of_files = _rows(single, {
        "template": guide.template_steps(), "config": guide.config_steps(), "runner": guide.runner_steps(),
        "template_gap": _gap_texts(guide.env_gaps())}, F.col("path"))
    # The package manager of a manifest is pinned by the first lock file of its own directory.
    rank = F.col("f.path")
    locks = files.where(one_of("f.name", tuple(catalogs.LOCKFILES))).groupBy("repo_id", F.col("f.dir").alias("dir")).agg(
        F.min_by(F.col("f.name"), rank).alias("lock"))
    packages = files.where(F.col("f.name") == "package.json").select("repo_id", F.col("f.dir").alias("dir"), F.col("f.path").alias("path")) \
        .join(locks, ["repo_id", "dir"], "left").select(
        "repo_id", "dir", "path", F.array(F.struct("path", "dir", F.element_at(literal_map(catalogs.LOCKFILES), F.col("lock")).alias("pm"))).alias("node"))
    home = digest.select("repo_id", F.col("home").alias("dir"))
    of_packages = _rows(packages, {"node": guide.node_install(), "lock_gap": _gap_texts(guide.lock_gaps("node"))}, F.col("path"))
    fronts = _rows(packages.join(home, ["repo_id", "dir"], "left_anti"), {
        "front": guide.dev_steps("node"), "front_gap": _gap_texts(guide.dev_gaps("node"))}, F.col("path"))
    found = reduce(DataFrame.unionByName, [whole, of_files, of_packages, fronts])
    # A repository without any setup step has no workflow either; only its runners could be such rows.
    runners = found.where(F.col("part") == "runner").join(
        digest.where("nothing").select("repo_id"), "repo_id", "left_anti").select(*found.columns)
    return found.where(F.col("part") != "runner").unionByName(runners)


def _gap_texts(gaps) -> Column:
    return F.transform(gaps, lambda g: F.concat(F.lit("Not detected: "), g, F.lit(".")))


def _ordered(rows: DataFrame, parts: tuple[str, ...]) -> DataFrame:
    rank = F.element_at(literal_map({p: i for i, p in enumerate(parts)}), F.col("part"))
    return rows.where(F.col("part").isin(*parts)).withColumn("rank", rank)


def setup_steps(found: DataFrame) -> DataFrame:
    """The setup guide as rows, ordered by ``rank``, ``path`` and ``i``."""
    return _ordered(found, SETUP_PARTS)


def workflow_steps(found: DataFrame) -> DataFrame:
    """The development workflow as rows, ordered by ``rank``, ``path`` and ``i``."""
    return _ordered(found, WORKFLOW_PARTS)
