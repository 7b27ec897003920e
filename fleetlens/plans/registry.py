"""Every operator as a named query over the test tables, with its DuckDB statement where one
can express it on the whole tables."""

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fleetlens import catalogs as c
from fleetlens.functions import paths
from fleetlens.functions.text import content_key, safe_preview
from fleetlens.operators import (analysis, audit, dependencies, guide, incremental, inventory, long_records, prompts,
                                 provenance, request_log, sanitize, signals)
from fleetlens.plans import fleet, oracle as o
from fleetlens.sources import derived as d, records as records_source
from fleetlens.sources.files import dirs_of, prune_ignored
from fleetlens.sources.landing import land, scratch
from fleetlens.sources.requests import validate_urls
from fleetlens.streaming import event_time, metrics_stream, request_stream

QUERIES = {}
ORACLES = {}


def query(sql=None, name=None):
    def register(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn
    return register


# ---------------------------------------------------------------- inputs

def scanned(spark, sf):
    return inventory.scan(d.files_from_lineitem(spark, sf))


def fleet_records(spark, sf):
    return analysis.assemble_analyses(scanned(spark, sf)).withColumnRenamed("repo_id", "id")


def part_records(spark, sf):
    records, _ = analysis.parse_analyses(d.record_texts(spark, sf), "source_text")
    return records.drop("source_text").withColumnRenamed("part_id", "id")


def lines(column):
    return F.array_join(column, "\n")


def long(column):
    return F.col(column).cast("long").alias(column)


# ---------------------------------------------------------------- file inventory

@query(o.with_(*o.BASE, "SELECT repo_id, path FROM scanned"))
def pruned_files(spark, sf):
    return prune_ignored(d.files_from_lineitem(spark, sf)).select("repo_id", "path")


@query(o.with_(*o.BASE, o.DIRS, "SELECT * FROM dirs"))
def directories(spark, sf):
    return dirs_of(scanned(spark, sf))


@query(o.with_(*o.BASE, o.DIRS, """SELECT f.repo_id, total_files, coalesce(total_dirs, 0) AS total_dirs
  FROM (SELECT repo_id, count(s.path) AS total_files FROM files LEFT JOIN scanned s USING (repo_id, path) GROUP BY 1) f
  LEFT JOIN (SELECT repo_id, count(*) AS total_dirs FROM dirs GROUP BY 1) g USING (repo_id)"""))
def repo_totals(spark, sf):
    return inventory.repo_totals(scanned(spark, sf))


@query(o.with_(*o.BASE, o.LANGUAGES, o.LANG_FILES, "SELECT * FROM lang_files"))
def files_with_language(spark, sf):
    return inventory.with_language(scanned(spark, sf)).select("repo_id", "path", "extension", "language")


@query(o.with_(*o.BASE, o.LANGUAGES, o.LANG_FILES,
               "SELECT repo_id, language, count(*) AS n_files FROM lang_files GROUP BY 1, 2"))
def language_counts(spark, sf):
    return inventory.language_counts(scanned(spark, sf))


@query(o.with_(*o.BASE, o.LABELS, "SELECT repo_id, path, label FROM scanned JOIN label_of USING (name)"))
def important_files(spark, sf):
    return inventory.important_files(scanned(spark, sf))


@query(o.with_(*o.BASE, o.DIRS, o.FLAGS, "SELECT * FROM flags"))
def structure_flags(spark, sf):
    return inventory.structure_flags(scanned(spark, sf))


@query(o.with_(*o.BASE, o.DIRS, "SELECT repo_id, path AS dir FROM dirs WHERE NOT contains(path, '/')"))
def top_level_dirs(spark, sf):
    return inventory.top_level_dirs(scanned(spark, sf))


@query(o.with_(*o.ENTRY_BASE, """SELECT e.repo_id, e.path, CAST(coalesce(r.rank, 13) AS BIGINT) AS rank,
  CASE WHEN r.rank IS NULL THEN m.manifest ELSE '' END AS manifest FROM entries e
  LEFT JOIN (SELECT repo_id, path, rank FROM scanned JOIN entry_rank USING (name)) r ON r.repo_id = e.repo_id AND r.path = e.path
  LEFT JOIN (SELECT repo_id, path, min(manifest) AS manifest FROM mains GROUP BY 1, 2) m ON m.repo_id = e.repo_id AND m.path = e.path"""))
def entry_points(spark, sf):
    return inventory.entry_points(scanned(spark, sf)).select("repo_id", "path", long("rank"), "manifest")


@query(o.with_(d.FILES_SQL, f"""SELECT repo_id, path, {o.secret_case(o.base('path'), c.SECRET_FILES)} AS pattern
  FROM files WHERE {o.secret_case(o.base('path'), c.SECRET_FILES)} IS NOT NULL"""))
def secret_files(spark, sf):
    return sanitize.scan_secret_files(d.files_from_lineitem(spark, sf))


@query(o.with_(d.FILES_SQL, f"""SELECT repo_id, path, {o.base('path')} AS name, {o.dirname('path')} AS dir,
  {o.run_in(o.dirname('path'), "'make'")} AS command, regexp_replace('./' || path, '^\\./', '') AS rel,
  CASE WHEN path LIKE '%.py' THEN replace(path[:-4], '/', '.') END AS module,
  CASE WHEN length(path) > 4 THEN path[:4] || '…' ELSE '****' END AS preview FROM files"""))
def path_functions(spark, sf):
    return d.files_from_lineitem(spark, sf).select(
        "repo_id", "path", paths.basename("path").alias("name"), paths.dir_of("path").alias("dir"),
        paths.run_in(paths.dir_of("path"), "make").alias("command"),
        paths.rel_path(F.concat(F.lit(" .\\"), "path")).alias("rel"),
        F.when(F.endswith("path", F.lit(".py")), paths.module_of("path")).alias("module"),
        safe_preview("path").alias("preview"))


@query(o.with_(d.URLS_SQL, f"""SELECT page_id, valid AS is_valid, CASE WHEN valid THEN regexp_replace(trim(url), '/+$', '') END AS clone_url,
  CASE WHEN trim(url) = '' THEN {o.q(c.URL_BLANK)} WHEN NOT valid THEN {o.q(c.URL_UNSUPPORTED)} || {o.repr_('url')} END AS reason
  FROM (SELECT *, regexp_matches(trim(url), {o.q(c.REPO_URL_PATTERN)}) AS valid FROM urls)"""))
def repo_urls(spark, sf):
    return validate_urls(d.urls_from_pages(spark, sf), "url").drop("url")


# ---------------------------------------------------------------- dependencies

@query(o.with_(*o.DEP_BASE, """SELECT repo_id, source, kind, CASE WHEN package IS NULL THEN NULL ELSE rn END AS pos, package FROM deps"""))
def declared_dependencies(spark, sf):
    return dependencies.extract_dependencies(scanned(spark, sf)).select(
        "repo_id", "source", "kind", long("pos"), "package")


@query(o.with_(*o.DEP_BASE, o.PURPOSES, f"""SELECT repo_id, source, rn AS pos, package,
  coalesce(purpose, CASE WHEN starts_with(k, '@types/') AND length(k) > 7 THEN 'TypeScript type declarations for ' || k[8:] || '.'
    WHEN starts_with(k, 'eslint-plugin-') AND length(k) > 14 THEN 'ESLint rule set for ' || k[15:] || '.' ELSE {o.q(c.PURPOSE_UNKNOWN)} END) AS purpose
  FROM (SELECT *, {o.dep_key('package')} AS k FROM deps WHERE package IS NOT NULL) LEFT JOIN purpose_of ON k = dep_key"""))
def dependency_purposes(spark, sf):
    deps = dependencies.extract_dependencies(scanned(spark, sf)).where(F.col("package").isNotNull())
    return dependencies.dependency_purposes(deps).select("repo_id", "source", long("pos"), "package", "purpose")


@query(o.with_(*o.DEP_BASE, o.DIRS, o.FLAGS, o.ERRORS, """SELECT f.repo_id, CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END AS status, error,
  total_files, coalesce(n, 0) AS total_dirs, type, has_tests, has_ci, has_docker
  FROM flags f LEFT JOIN errors USING (repo_id) LEFT JOIN (SELECT repo_id, count(*) AS n FROM dirs GROUP BY 1) USING (repo_id)"""))
def repo_facts(spark, sf):
    return analysis.repo_facts(scanned(spark, sf))


# ---------------------------------------------------------------- READMEs

@query(o.with_(o.README_RAW, o.README_KINDS, o.README_FACTS_SQL))
def readme_facts(spark, sf):
    return inventory.readme_facts(d.readmes_from_documents(spark, sf)).drop("sections")


@query(o.with_(o.README_RAW, o.README_SECTIONS, o.README_SECTIONS_SQL))
def readme_sections(spark, sf):
    return inventory.readme_sections(d.readmes_from_documents(spark, sf)).select(
        "repo_id", long("pos"), "heading", "body")


@query(o.with_(*o.BASE, """SELECT repo_id, arg_min(path, (contains(path, '/'), path)) AS path FROM scanned
  WHERE starts_with(name, 'readme') GROUP BY 1"""))
def picked_readmes(spark, sf):
    return inventory.pick_readme(scanned(spark, sf)).select("repo_id", "path")


# ---------------------------------------------------------------- architecture

def _dependency_names(spark, sf):
    return (dependencies.extract_dependencies(scanned(spark, sf)).where(F.col("package").isNotNull())
            .select("repo_id", F.col("package").alias("name")))


_DEP_NAMES = "dep_names AS (SELECT repo_id, package AS name FROM deps WHERE package IS NOT NULL)"
_DEP_HITS = "hits AS (SELECT repo_id, name, tier, signal FROM dep_names JOIN signal_of ON contains(lower(name), signal))"
_DEP_SUMMARY = """tier_summary AS (SELECT repo_id, bool_or(tier = 'frontend') AS has_frontend, bool_or(tier = 'backend') AS has_backend,
  bool_or(tier = 'database') AS has_database, coalesce(list(DISTINCT signal ORDER BY signal) FILTER (tier = 'external'), []) AS services FROM hits GROUP BY 1)"""
_SIGNAL_BASE = (*o.DEP_BASE, o.SIGNALS, _DEP_NAMES, _DEP_HITS)


@query(o.with_(*_SIGNAL_BASE, "SELECT * FROM hits"))
def architecture_signals(spark, sf):
    return signals.architecture_signals(_dependency_names(spark, sf))


@query(o.with_(*_SIGNAL_BASE, "SELECT * FROM hits"))
def architecture_signals_by_dictionary(spark, sf):
    return signals.signals_by_dictionary(_dependency_names(spark, sf))


@query(o.with_(*o.DEP_BASE, o.SIGNALS, _DEP_NAMES,
               "SELECT repo_id, name, tier, signal FROM dep_names JOIN signal_of ON lower(name) = signal"))
def architecture_signals_exact(spark, sf):
    return signals.architecture_signals(_dependency_names(spark, sf), exact=True)


@query(o.with_(*_SIGNAL_BASE, _DEP_SUMMARY, """SELECT repo_id, has_frontend, has_backend, has_database,
  array_to_string(services, ',') AS services FROM tier_summary"""))
def architecture_summary(spark, sf):
    return signals.architecture_summary(_dependency_names(spark, sf)).withColumn(
        "services", F.array_join("services", ","))


@query(o.with_(*_SIGNAL_BASE, o.NODES, _DEP_SUMMARY, """SELECT repo_id, src, dst, row_number() OVER (PARTITION BY repo_id ORDER BY o, s) - 1 AS ord FROM (
  SELECT repo_id, 'Frontend' AS src, 'Backend' AS dst, 0 AS o, '' AS s FROM tier_summary WHERE has_frontend AND has_backend
  UNION ALL SELECT repo_id, 'Backend', 'Database', 1, '' FROM tier_summary WHERE has_backend AND has_database
  UNION ALL SELECT repo_id, 'Backend', node, 2, signal FROM (SELECT repo_id, unnest(services) AS signal FROM tier_summary WHERE has_backend) JOIN node_of USING (signal))"""))
def architecture_edges(spark, sf):
    summary = signals.architecture_summary(_dependency_names(spark, sf))
    return signals.architecture_edges(summary).select("repo_id", "src", "dst", long("ord"))


# ---------------------------------------------------------------- records

@query(o.with_(*o.FLEET, f"""SELECT id AS repo_id, project_name, array_to_string(languages, ',') AS languages,
  array_to_string(list_transform(files, lambda f: f.path || '=' || f.description), chr(10)) AS important_files,
  array_to_string(deps, chr(10)) AS dependencies, CAST(structure AS VARCHAR) AS project_structure FROM rec"""))
def assembled_records(spark, sf):
    return analysis.assemble_analyses(scanned(spark, sf)).select(
        "repo_id", "project_name", F.array_join("languages", ",").alias("languages"),
        lines(F.transform("important_files", lambda f: F.concat(f["path"], F.lit("="), f["description"])))
        .alias("important_files"),
        lines(F.transform("dependencies", lambda x: x["name"])).alias("dependencies"), "project_structure")


@query(o.with_(*o.FLEET, "SELECT * FROM rejects"))
def rejected_repositories(spark, sf):
    return analysis.rejected_repositories(scanned(spark, sf))


@query(o.with_(*o.FLEET, "SELECT * FROM broken"))
def fleet_limit_violations(spark, sf):
    return analysis.validate_limits(analysis.assemble_analyses(scanned(spark, sf)))[1]


@query(o.with_(*o.PARTS, """SELECT id, project_name, array_to_string(languages, ',') AS languages,
  array_to_string(frameworks, ',') AS frameworks,
  array_to_string(list_transform(files, lambda f: f.path || '=' || coalesce(f.description, '-')), chr(10)) AS important_files,
  array_to_string(deps, chr(10)) AS dependencies, CAST(structure IS NOT NULL AS BOOLEAN) AS has_structure FROM rec"""))
def json_records(spark, sf):
    return part_records(spark, sf).select(
        "id", "project_name", F.array_join("languages", ",").alias("languages"),
        F.array_join("frameworks", ",").alias("frameworks"),
        lines(F.transform("important_files", lambda f: F.concat(
            f["path"], F.lit("="), F.coalesce(f["description"], F.lit("-"))))).alias("important_files"),
        lines(F.transform("dependencies", lambda x: x["name"])).alias("dependencies"),
        F.col("project_structure").isNotNull().alias("has_structure"))


@query(o.with_(*o.PARTS, """SELECT project_name, array_to_string(languages, ',') AS languages, array_to_string(deps, chr(10)) AS dependencies,
    CAST(NULL AS VARCHAR) AS reason FROM rec
  UNION ALL SELECT NULL, NULL, NULL, reason FROM judged WHERE reason IS NOT NULL"""))
def records_from_files(spark, sf):
    """Records read back from a folder of mixed files: every fiftieth part is a file of its own, over several lines."""
    folder = scratch(spark, "records")
    texts = d.record_texts(spark, sf).withColumn("own", F.col("part_id") % 50 == 0)
    laid_out = F.regexp_replace(F.regexp_replace("source_text", r"^\{", "{\n  "), ", ", ",\n  ")
    texts.where("own").select("part_id", laid_out.alias("text")).repartition("part_id").write.partitionBy("part_id").text(f"{folder}/single")
    texts.where(~F.col("own")).select("source_text").write.option("compression", "gzip").text(f"{folder}/lines")
    records, bad = records_source.read_record_files(spark, folder, whole="*.txt")
    return records.select(
        "project_name", F.array_join("languages", ",").alias("languages"), lines(F.transform("dependencies", lambda x: x["name"])).alias("dependencies"),
        F.lit(None).cast("string").alias("reason")).unionByName(bad.select("reason"), allowMissingColumns=True)


@query(o.with_(*o.PARTS, "SELECT part_id, reason FROM judged WHERE reason IS NOT NULL"))
def malformed_records(spark, sf):
    return analysis.parse_analyses(d.record_texts(spark, sf), "source_text")[1].select("part_id", "reason")


@query(o.with_(*o.PARTS, "SELECT part_id, violation FROM broken"))
def limit_violations(spark, sf):
    records, _ = analysis.parse_analyses(d.record_texts(spark, sf), "source_text")
    return analysis.validate_limits(records.drop("source_text"))[1]


@query(o.with_(d.RECORDS_SQL, """SELECT part_id, sha256('{"part_id":' || part_id || ',"absent":null,"source_text":' || to_json(source_text) || '}') AS cache_key FROM record_texts"""))
def content_keys(spark, sf):
    return d.record_texts(spark, sf).withColumn("absent", F.lit(None).cast("string")).select(
        "part_id", content_key("part_id", "absent", "source_text").alias("cache_key"))


# ---------------------------------------------------------------- guides

def _guide_queries(prefix, records, base):
    def register(name, sql, build):
        query(o.with_(*base, *sql), f"{prefix}_{name}")(
            lambda spark, sf: build(guide.generate_onboarding(records(spark, sf))))

    register("overview", (*o.GUIDE, o.OVERVIEW, o.OVERVIEW_SQL),
             lambda g: g.select("id", "project_overview"))
    register("setup_guide", (*o.GUIDE, o.SETUP_SQL),
             lambda g: g.select("id", lines("setup_guide").alias("setup_guide")))
    register("development_workflow", (*o.GUIDE, o.WORKFLOW_SQL),
             lambda g: g.select("id", lines("development_workflow").alias("development_workflow")))
    register("starter_tasks", (*o.GUIDE, o.TASKS_SQL),
             lambda g: g.select("id", *[F.col("starter_tasks")[i].alias(f"task_{i + 1}") for i in range(5)]))
    register("completeness_notes", (*o.GUIDE, o.NOTES, o.NOTES_SQL),
             lambda g: g.select("id", lines("data_completeness_notes").alias("notes")))
    register("architecture_diagram", (*o.DIAGRAM_BASE, "SELECT id, diagram FROM drawn"),
             lambda g: g.select("id", F.col("architecture_diagram").alias("diagram")))
    register("tech_stack", (f"""SELECT id, array_to_string(list_concat(list_transform(languages, lambda n: n || '|language|{c.ROLE}'),
        list_transform(frameworks, lambda n: n || '|framework|{c.ROLE}')), chr(10)) AS tech_stack FROM rec""",),
             lambda g: g.select("id", lines(F.transform("tech_stack", lambda t: F.concat_ws(
                 "|", t["name"], t["category"], t["role"]))).alias("tech_stack")))
    register("file_explanations", (f"""SELECT id, array_to_string(list_transform(files, lambda f: f.path || '|' ||
        CASE WHEN coalesce(f.description, '') = '' THEN {o.q(c.PURPOSE_UNKNOWN)} ELSE f.description END), chr(10)) AS important_files FROM rec""",),
             lambda g: g.select("id", lines(F.transform("important_files", lambda f: F.concat_ws(
                 "|", f["path"], f["purpose"]))).alias("important_files")))
    register("detected_files", (o.DETECTED, "SELECT id, array_to_string(det_paths, chr(10)) AS detected FROM d3"), None)
    QUERIES[f"{prefix}_detected_files"] = lambda spark, sf: guide.detected_files(
        guide.with_structure(records(spark, sf))).select("id", lines("detected").alias("detected"))
    register("package_managers", (*o.GUIDE, """SELECT id, unnest(node).path AS manifest, coalesce(unnest(node).pm, 'none') AS package_manager FROM s3"""), None)
    QUERIES[f"{prefix}_package_managers"] = lambda spark, sf: guide.with_signals(records(spark, sf)).select(
        "id", F.explode("node").alias("m")).select(
        "id", F.col("m.path").alias("manifest"), F.coalesce("m.pm", F.lit("none")).alias("package_manager"))
    register("run_entry_point", (*o.GUIDE, """SELECT id, entry, command, CASE WHEN entry IS NOT NULL THEN caveat END AS caveat FROM s3"""), None)
    QUERIES[f"{prefix}_run_entry_point"] = lambda spark, sf: guide.with_steps(
        guide.with_signals(records(spark, sf))).select(
        "id", "entry", F.col("start.command").alias("command"), F.col("start.caveat").alias("caveat"))


    purpose = f"""coalesce(purpose, CASE WHEN starts_with(k, '@types/') AND length(k) > 7 THEN 'TypeScript type declarations for ' || k[8:] || '.'
        WHEN starts_with(k, 'eslint-plugin-') AND length(k) > 14 THEN 'ESLint rule set for ' || k[15:] || '.' ELSE {o.q(c.PURPOSE_UNKNOWN)} END)"""
    register("dependency_explanations", (o.PURPOSES, f"""SELECT id, pos, name, {purpose} AS purpose, {o.q(c.ARCHITECTURE_PROSE)} AS architecture
      FROM (SELECT id, i - 1 AS pos, deps[i] AS name, {o.dep_key('deps[i]')} AS k FROM (SELECT id, deps, unnest(range(1, len(deps) + 1)) AS i FROM rec))
      LEFT JOIN purpose_of ON k = dep_key"""), lambda g: g.select("id", "architecture", F.posexplode("dependencies").alias("pos", "d")).select(
          "id", long("pos"), "d.name", "d.purpose", "architecture"))


_guide_queries("fleet", fleet_records, o.FLEET)
_guide_queries("record", part_records, o.PARTS)


@query(o.with_(*o.PARTS, """SELECT id, len(languages) + len(frameworks) AS n_technologies, len(files) AS n_key_files, len(deps) AS n_dependencies FROM rec"""))
def summary_counts(spark, sf):
    counts = provenance.summary_counts(guide.generate_onboarding(part_records(spark, sf)), "id")
    return counts.select("id", long("n_technologies"), long("n_key_files"), long("n_dependencies"))


@query(o.with_(*o.FLEET, """SELECT id, array_to_string(list_transform(files, lambda f: f.path), chr(10)) AS files, 0 AS n_more FROM rec"""))
def evidence_files(spark, sf):
    evidence = provenance.evidence_files(guide.generate_onboarding(fleet_records(spark, sf)), "id")
    return evidence.select("id", lines("files").alias("files"), long("n_more"))


@query(o.with_(*o.FLEET, """SELECT id, array_to_string(list_transform(files[:3], lambda f: f.path), chr(10)) AS files, greatest(len(files) - 3, 0) AS n_more FROM rec"""))
def evidence_files_shown(spark, sf):
    evidence = provenance.evidence_files(guide.generate_onboarding(fleet_records(spark, sf)), "id", shown=3)
    return evidence.select("id", lines("files").alias("files"), long("n_more"))


@query(o.with_(*o.PARTS, *o.GUIDE, o.OVERVIEW, f"""SELECT id, CAST(id % 3 AS INT) AS day, project_overview || CASE WHEN id % 3 = 1 THEN ' (again)' ELSE '' END AS project_overview,
    CAST(false AS BOOLEAN) AS used_llm FROM ({o.OVERVIEW_SQL})"""))
def knowledge_by_day(spark, sf):
    """Guides written by day; one day is written a second time with new texts, twice, and all is read back."""
    folder = scratch(spark, "knowledge")
    guides = guide.generate_onboarding(part_records(spark, sf)).withColumn("day", (F.col("id") % 3).cast("int"))
    records_source.write_knowledge(guides, folder, by=["day"])
    again = guides.where("day = 1").withColumn("project_overview", F.concat("project_overview", F.lit(" (again)")))
    for _ in range(2):
        records_source.write_knowledge(again, folder, by=["day"])
    return records_source.read_knowledge(spark, folder, guides.schema).select("id", "day", "project_overview", "used_llm")


_SECTIONS = o.values_table("sections", "section, title", c.SECTION_LABELS.items())
_PROVENANCE_SQL = f"""SELECT id, section, CASE WHEN len(own) > 0 THEN 'No data detected' WHEN section = 'architecture_diagram' THEN 'Pattern-matched'
    WHEN section = 'important_files' THEN 'Repository-derived' WHEN used_llm THEN 'AI-generated' ELSE 'Rule-based' END AS badge,
  array_to_string(list_concat([CASE WHEN section = 'architecture_diagram' AND len(own) > 0 THEN {o.q(c.REASON_DIAGRAM_EMPTY)}
      WHEN section = 'architecture_diagram' THEN {o.q(c.REASON_DIAGRAM)} WHEN used_llm THEN title || {o.q(c.REASON_MODEL)} ELSE title || {o.q(c.REASON_RULES)} END],
    list_transform(own, lambda n: regexp_replace(n, '^[^:]+:\\s*', ''))), chr(10)) AS reasons
FROM (SELECT id, used_llm, section, title, list_filter(notes, lambda n: starts_with(n, section || ':')) AS own FROM all_notes CROSS JOIN sections)"""


@query(o.with_(*o.PARTS, *o.GUIDE, o.NOTES, _SECTIONS, "all_notes AS (SELECT id, false AS used_llm, notes FROM notes)", _PROVENANCE_SQL))
def section_provenance(spark, sf):
    rows = provenance.section_provenance(guide.generate_onboarding(part_records(spark, sf)), "id")
    return rows.withColumn("reasons", lines("reasons"))


# ---------------------------------------------------------------- records as rows

def _items(spark, sf):
    """Landed once: the steps, the audit and the redaction all read it."""
    return land(long_records.accepted_items(scanned(spark, sf)))


def _placed(rows):
    """Rows with the position that the array forms give them; only a check needs it."""
    place = Window.partitionBy("repo_id").orderBy("rank", "path", "i")
    return rows.select(F.col("repo_id").alias("id"), (F.row_number().over(place) - 1).cast("long").alias("pos"), "step")


@query(o.with_(*o.FLEET, *o.GUIDE, o.SETUP_ROWS_SQL))
def setup_step_rows(spark, sf):
    return _placed(long_records.setup_steps(long_records.steps(_items(spark, sf))))


@query(o.with_(*o.FLEET, *o.GUIDE, o.WORKFLOW_ROWS_SQL))
def workflow_step_rows(spark, sf):
    return _placed(long_records.workflow_steps(long_records.steps(_items(spark, sf))))


@query(o.with_(*o.FLEET, o.KNOWN, """mentions AS (
    SELECT id + 1 AS id, 'tech_stack' AS section, unnest(languages) AS name FROM rec
    UNION ALL SELECT id + 1, 'important_files', f.path || '/part' FROM (SELECT id, unnest(files) AS f FROM rec)
    UNION ALL SELECT id + 1, 'dependencies', unnest(deps) FROM rec)""", f"""
  SELECT m.id, section, CASE section WHEN 'tech_stack' THEN 'tech_stack name' WHEN 'dependencies' THEN 'dependency name' ELSE 'important_files path' END
    || ' not in input: ' || {o.repr_('m.name')} AS failure FROM mentions m
  WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.id = m.id AND (k.name = lower(m.name)
    OR section = 'important_files' AND list_contains(string_split(lower(m.name), '/'), k.name)))"""))
def grounding_failure_rows(spark, sf):
    """What a text about each repository gets wrong that was written from its neighbour's record."""
    rows = long_records.entries(_items(spark, sf))
    section = F.when(F.col("section") == "languages", "tech_stack").otherwise(F.col("section"))
    name = F.when(F.col("section") == "important_files", F.concat("name", F.lit("/part"))).otherwise(F.col("name"))
    mentions = rows.where(F.col("section") != "title").select(
        (F.col("repo_id") + 1).alias("repo_id"), section.alias("section"), F.struct("section", "key", "i").alias("pos"), name.alias("name"))
    found = long_records.grounding_failures(mentions, long_records.known_names(rows))
    return found.select(F.col("repo_id").alias("id"), "section", "failure")


@query(o.with_(*o.FLEET, f"""SELECT id, section, name, pattern FROM (
    SELECT id, 'important_files' AS section, f.path AS name, coalesce({o._F('f.path')}, {o._V('f.path')}) AS pattern FROM (SELECT id, unnest(files) AS f FROM rec)
    UNION ALL SELECT id, 'dependencies', n, {o._V('n')} FROM (SELECT id, unnest(deps) AS n FROM rec)
    UNION ALL SELECT id, 'languages', n, {o._V('n')} FROM (SELECT id, unnest(languages) AS n FROM rec)
    UNION ALL SELECT id, 'title', project_name, {o._V('project_name')} FROM rec WHERE project_name IS NOT NULL)
  WHERE pattern IS NULL"""))
def clean_entry_rows(spark, sf):
    """The entries that pass the secret scan."""
    rows = long_records.redacted_entries(long_records.entries(_items(spark, sf)))
    return rows.where("pattern IS NULL").select(F.col("repo_id").alias("id"), "section", "name", "pattern")


# ---------------------------------------------------------------- secrets, prompts, audit

@query(o.secrets_sql("documents", "doc_id", "text"))
def document_secrets(spark, sf):
    return sanitize.scan_secrets(d.spread(
        spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")), "text")


@query(o.secrets_sql("pages", "page_id", "html"))
def page_secrets(spark, sf):
    return sanitize.scan_secrets(d.spread(
        spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html")), "html")


@query(o.secrets_sql("conversations", "conv_id, turn", "text"))
def conversation_secrets(spark, sf):
    return sanitize.scan_secrets(d.spread(
        spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "text")), "text")


@query(f"""SELECT id, pattern, preview FROM (SELECT id, {o.secret_case('text', c.SECRET_VALUES)} AS pattern, text[:4] || '…' AS preview
    FROM (SELECT p_partkey AS id, {d.SECRET_TEXT} AS text FROM part)) WHERE pattern IS NOT NULL""".replace("{text}", "VARCHAR"))
def secret_texts(spark, sf):
    """Texts of which each value pattern finds some."""
    return sanitize.scan_secrets(d.secrets_from_part(spark, sf).select("id", "text"), "text")


@query(f"""SELECT repo_id, path, pattern FROM (SELECT p_partkey AS repo_id, path, {o.secret_case(o.base('path'), c.SECRET_FILES)} AS pattern
    FROM (SELECT p_partkey, {d.SECRET_PATH} AS path FROM part)) WHERE pattern IS NOT NULL""".replace("{text}", "VARCHAR"))
def secret_paths(spark, sf):
    """Paths of which each name pattern finds some."""
    return sanitize.scan_secret_files(d.secrets_from_part(spark, sf).select(F.col("id").alias("repo_id"), "path"))


@query(o.with_(*o.PARTS, o.REDACTIONS, "SELECT * FROM redactions"))
def record_redactions(spark, sf):
    return sanitize.redactions(sanitize.sanitize(part_records(spark, sf))).select(
        "id", long("pos"), "field_path", "pattern")


@query(o.with_(*o.PARTS, o.KNOWN, """SELECT id, name FROM known"""))
def known_names(spark, sf):
    return part_records(spark, sf).select("id", F.explode(audit.known_names()).alias("name"))


_ANSWERED = (d.RESPONSES_SQL, """answers AS (SELECT id, response AS doc FROM responses SEMI JOIN rec USING (id)
  WHERE json_valid(response) AND json_exists(response, '$.architecture')
    AND json_type(response, '$.architecture') = 'VARCHAR' AND json_type(response, '$.project_overview') = 'VARCHAR'
    AND len(list_filter(CAST(CASE WHEN json_valid(response) THEN response->'$.setup_guide' END AS JSON[]), lambda x: json_type(x) <> 'VARCHAR')) = 0
    AND len(list_filter(CAST(CASE WHEN json_valid(response) THEN response->'$.tech_stack' END AS JSON[]), lambda x: json_type(x, '$.name') <> 'VARCHAR')) = 0
    AND len(list_filter(CAST(CASE WHEN json_valid(response) THEN response->'$.dependencies' END AS JSON[]), lambda x: NOT json_exists(x, '$.purpose'))) = 0)""")
_FAILED = f"""failed AS (
  SELECT id, 1 AS o, i, 'tech_stack name not in input: ' || {o.repr_('n')} AS failure FROM (SELECT id, i, t[i]->>'$.name' AS n FROM (SELECT id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT id, CAST(doc->'$.tech_stack' AS JSON[]) AS t FROM answers)))
    WHERE (id, lower(n)) NOT IN (SELECT id, name FROM known)
  UNION ALL
  SELECT id, 2, i, 'important_files path not in input: ' || {o.repr_('n')} FROM (SELECT id, i, t[i]->>'$.path' AS n FROM (SELECT id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT id, CAST(doc->'$.important_files' AS JSON[]) AS t FROM answers))) x
    WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.id = x.id AND (k.name = lower(n) OR list_contains(string_split(lower(n), '/'), k.name)))
  UNION ALL
  SELECT id, 3, i, 'dependency name not in input: ' || {o.repr_('n')} FROM (SELECT id, i, t[i]->>'$.name' AS n FROM (SELECT id, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT id, CAST(doc->'$.dependencies' AS JSON[]) AS t FROM answers)))
    WHERE (id, lower(n)) NOT IN (SELECT id, name FROM known))"""


def _merged(spark, sf):
    responses = d.responses_from_part(spark, sf).withColumnRenamed("part_id", "id")
    return fleet.guides_from_responses(part_records(spark, sf), responses, "id", "response")


@query(o.with_(*o.PARTS, *_ANSWERED, "SELECT id, (id IN (SELECT id FROM answers)) AS is_complete FROM responses"
               " WHERE id IN (SELECT id FROM rec)"))
def complete_responses(spark, sf):
    responses = d.responses_from_part(spark, sf).withColumnRenamed("part_id", "id")
    kept = responses.join(part_records(spark, sf).select("id"), "id", "left_semi")
    return prompts.parse_generated(kept, "response").select("id", "is_complete")


@query(o.with_(d.RESPONSES_SQL, """valid AS (SELECT id, CASE WHEN json_valid(response) THEN response END AS doc FROM responses)""", """
  SELECT id, 'not a JSON object' AS problem FROM valid WHERE doc IS NULL
  UNION ALL SELECT id, 'architecture: missing' FROM valid WHERE doc IS NOT NULL AND NOT json_exists(doc, '$.architecture')
  UNION ALL SELECT id, 'architecture: not a string' FROM valid WHERE json_type(doc, '$.architecture') <> 'VARCHAR'
  UNION ALL SELECT id, 'project_overview: not a string' FROM valid WHERE json_type(doc, '$.project_overview') <> 'VARCHAR'
  UNION ALL SELECT id, 'setup_guide[' || (i - 1) || ']: not a string' FROM (SELECT id, s, unnest(range(1, len(s) + 1)) AS i FROM (
    SELECT id, CAST(doc->'$.setup_guide' AS JSON[]) AS s FROM valid WHERE doc IS NOT NULL)) WHERE json_type(s[i]) <> 'VARCHAR'
  UNION ALL SELECT id, 'tech_stack[' || (i - 1) || '].name: not a string' FROM (SELECT id, s, unnest(range(1, len(s) + 1)) AS i FROM (
    SELECT id, CAST(doc->'$.tech_stack' AS JSON[]) AS s FROM valid WHERE doc IS NOT NULL)) WHERE json_type(s[i], '$.name') <> 'VARCHAR'
  UNION ALL SELECT id, 'dependencies[' || (i - 1) || '].purpose: missing' FROM (SELECT id, s, unnest(range(1, len(s) + 1)) AS i FROM (
    SELECT id, CAST(doc->'$.dependencies' AS JSON[]) AS s FROM valid WHERE doc IS NOT NULL)) WHERE NOT json_exists(s[i], '$.purpose')"""))
def response_problems(spark, sf):
    """Every way in which an answer breaks its contract."""
    responses = d.responses_from_part(spark, sf).withColumnRenamed("part_id", "id")
    return prompts.parse_generated(responses, "response").select("id", F.explode("problems").alias("problem"))


@query(o.with_(*o.PARTS, o.KNOWN, *_ANSWERED, _FAILED,
               "SELECT id, row_number() OVER (PARTITION BY id ORDER BY o, i) - 1 AS pos, failure FROM failed"))
def response_grounding_failures(spark, sf):
    return _merged(spark, sf).select("id", F.posexplode("failures").alias("pos", "failure")).select(
        "id", long("pos"), "failure")


@query(o.with_(*o.PARTS, *o.GUIDE, o.NOTES, *o.DIAGRAM_BASE, *_ANSWERED, f"""SELECT r.id, a.id IS NOT NULL AS used_llm,
  array_to_string(CASE WHEN a.id IS NULL THEN notes WHEN contains(diagram, '{c.DIAGRAM_UNKNOWN}')
    THEN list_append(CAST(doc->'$.data_completeness_notes' AS VARCHAR[]), '{c.DIAGRAM_UNKNOWN_NOTE}')
    ELSE CAST(doc->'$.data_completeness_notes' AS VARCHAR[]) END, chr(10)) AS notes, diagram
  FROM rec r LEFT JOIN answers a USING (id) JOIN notes USING (id) JOIN drawn USING (id)"""))
def merged_guides(spark, sf):
    return _merged(spark, sf).select(
        "id", "used_llm", lines("data_completeness_notes").alias("notes"),
        F.col("architecture_diagram").alias("diagram"))


@query(o.with_(*o.PARTS, *o.GUIDE, o.NOTES, *o.DIAGRAM_BASE, *_ANSWERED, _SECTIONS, f"""all_notes AS (SELECT r.id, a.id IS NOT NULL AS used_llm,
  CASE WHEN a.id IS NULL THEN notes WHEN contains(diagram, '{c.DIAGRAM_UNKNOWN}')
    THEN list_append(CAST(doc->'$.data_completeness_notes' AS VARCHAR[]), '{c.DIAGRAM_UNKNOWN_NOTE}')
    ELSE CAST(doc->'$.data_completeness_notes' AS VARCHAR[]) END AS notes
  FROM rec r LEFT JOIN answers a USING (id) JOIN notes USING (id) JOIN drawn USING (id))""", _PROVENANCE_SQL))
def merged_provenance(spark, sf):
    """Where the sections of guides come from of which a model wrote some."""
    return provenance.section_provenance(_merged(spark, sf), "id").withColumn("reasons", lines("reasons"))


@query(o.with_(*o.PARTS, o.KNOWN, f"""SELECT id, pos, label || ' not in input: ' || {o.repr_('n')} AS failure FROM (
    SELECT id, 'tech_stack name' AS label, unnest(list_concat(languages, frameworks)) AS n, 0 AS pos FROM rec
    UNION ALL SELECT id, 'important_files path', unnest(list_transform(files, lambda f: f.path)), 0 FROM rec
    UNION ALL SELECT id, 'dependency name', unnest(deps), 0 FROM rec)
  WHERE (id, lower(n)) NOT IN (SELECT id, name FROM known)"""))
def rule_based_grounding_failures(spark, sf):
    return fleet.audit_job(part_records(spark, sf), "id").select("id", long("pos"), "failure")


@query(o.with_(*o.PARTS, o.REDACTIONS, o.KNOWN, *_ANSWERED, _FAILED, """SELECT r.id, coalesce(n, 0) AS n_redactions, coalesce(m, 0) AS n_failures FROM rec r
  LEFT JOIN (SELECT id, count(*) AS n FROM redactions GROUP BY 1) USING (id) LEFT JOIN (SELECT id, count(*) AS m FROM failed GROUP BY 1) USING (id)"""))
def audit_summary(spark, sf):
    clean = sanitize.sanitize(part_records(spark, sf))
    return audit.audit_summary(clean, _merged(spark, sf), "id").select(
        "id", long("n_redactions"), long("n_failures"))


_CLEAN = f"CASE WHEN ({{0}}) IS NOT NULL THEN '{c.REDACTED}' ELSE {{1}} END"


@query(o.with_(*o.PARTS, o.REDACTIONS, f"""SELECT id, {o.q(c.PROMPT_VERSION)} AS prompt_version,
  (SELECT coalesce(array_to_string(list({_CLEAN.format(f"coalesce({o._F('path')}, {o._V('path')})", 'path')} ORDER BY i), chr(10)), '') FROM file_rows f WHERE f.id = rec.id) AS files,
  (SELECT coalesce(array_to_string(list({_CLEAN.format(o._V('name'), 'name')} ORDER BY i), chr(10)), '') FROM dep_rows f WHERE f.id = rec.id) AS deps,
  (SELECT coalesce(array_to_string(list({_CLEAN.format(f"coalesce({o._V('leaf')}, {o._F('leaf')})", 'leaf')} ORDER BY n), chr(10)), '') FROM structure_leaves f WHERE f.id = rec.id AND json_type(structure) = 'ARRAY') AS structure,
  project_name, true AS wrapped FROM rec"""))
def prompts_for_records(spark, sf):
    """Prompts read back field by field, so that the JSON inside is checked whole."""
    rows = prompts.build_prompts(part_records(spark, sf))
    wrapped = (F.startswith("prompt", F.lit(c.PROMPT_HEAD)) & F.endswith("prompt", F.lit(c.PROMPT_TAIL)))
    body = F.substr("prompt", F.lit(len(c.PROMPT_HEAD) + 1),
                    F.length("prompt") - len(c.PROMPT_HEAD) - len(c.PROMPT_TAIL))
    read, _ = analysis.parse_analyses(
        rows.select("id", "prompt_version", wrapped.alias("wrapped"), body.alias("body")), "body")
    return read.select(
        "id", "prompt_version", lines(F.transform("important_files", lambda f: f["path"])).alias("files"),
        lines(F.transform("dependencies", lambda x: x["name"])).alias("deps"),
        F.coalesce(lines(F.from_json(F.when(F.startswith("project_structure", F.lit("[")),
                                            F.col("project_structure")), "array<string>")), F.lit(""))
        .alias("structure"), "project_name", "wrapped")


@query(o.with_(*o.PARTS, """SELECT id, true AS is_new FROM rec JOIN judged ON part_id = id WHERE id % 7 = 2 OR id % 11 = 5
    AND source_text NOT IN (SELECT source_text FROM judged WHERE part_id % 11 <> 5 AND reason IS NULL)"""))
def incremental_prompts(spark, sf):
    """A second run emits the prompts of the records that changed or are new since the first, and no other."""
    table = f"results_{uuid.uuid4().hex}"
    records = part_records(spark, sf)
    first = incremental.pending_prompts(spark, records.where("id % 11 <> 5"), table)
    incremental.save_results(first.select("cache_key", F.lit("answer").alias("answer")), table, buckets=8)
    second = records.withColumn("project_name", F.when(F.col("id") % 7 == 2, F.concat(F.coalesce("project_name", F.lit("")), F.lit(" v2")))
                                .otherwise(F.col("project_name")))
    made = land(incremental.pending_prompts(spark, second, table).select("id", F.lit(True).alias("is_new")))
    spark.sql(f"DROP TABLE {table}")
    return made


# ---------------------------------------------------------------- request log

@query(o.with_(d.REQUESTS_SQL, o.metrics()))
def request_metrics(spark, sf):
    return _rounded(request_log.request_metrics(d.requests_from_events(spark, sf)))


@query(o.with_(d.REQUESTS_SQL, o.metrics("strftime(ts, '%Y-%m-%d %H')")))
def request_metrics_by_hour(spark, sf):
    hourly = d.requests_from_events(spark, sf).withColumn("bucket", F.date_format("ts", "yyyy-MM-dd HH"))
    return _rounded(request_log.request_metrics(hourly, "bucket"))


def _rounded(metrics):
    return metrics.withColumn("fallback_rate", F.round("fallback_rate", 9)).withColumn(
        "avg_latency_ms", F.round("avg_latency_ms", 6))


@query(o.with_(d.REQUESTS_SQL, f"""SELECT cache_key, count(*) AS total FROM requests GROUP BY 1
  HAVING count(*) > {c.PAGE_MIN_REQUESTS} AND count(*) FILTER (path = 'fallback') / count(*) > {c.PAGE_RATE}"""))
def paging_keys(spark, sf):
    return request_log.paging(request_log.request_metrics(
        d.requests_from_events(spark, sf), "cache_key")).select("cache_key", "total")


# A lower bar, so that the test data has keys that page.
_PAGE = dict(rate=0.2, min_requests=3)


@query(o.with_(d.REQUESTS_SQL, """SELECT cache_key, count(*) AS total FROM requests GROUP BY 1
  HAVING count(*) > 3 AND count(*) FILTER (path = 'fallback') / count(*) > 0.2"""))
def paging_keys_low_bar(spark, sf):
    return request_log.paging(request_log.request_metrics(
        d.requests_from_events(spark, sf), "cache_key"), **_PAGE).select("cache_key", "total")


@query(o.with_(d.REQUESTS_SQL, o.STREAKS, "SELECT * FROM streaks"))
def fallback_streaks(spark, sf):
    return request_log.fallback_streaks(d.requests_from_events(spark, sf)).select("request_id", "streak")


@query(o.with_(d.REQUESTS_SQL, o.STREAKS, f"SELECT * FROM streaks WHERE streak >= {c.FALLBACK_ALERT_THRESHOLD}"))
def fallback_alerts(spark, sf):
    return request_log.fallback_alerts(d.requests_from_events(spark, sf)).select("request_id", "streak")


@query(o.with_(d.REQUESTS_SQL, o.TTL, "SELECT request_id, outcome FROM outcomes"))
def cache_outcomes(spark, sf):
    return request_log.ttl_outcomes(d.requests_from_events(spark, sf)).select("request_id", "outcome")


# All requests of one event type share a key here, so a few keys hold the whole log.
_HOT = d.REQUESTS_SQL.replace("CAST(user_id AS VARCHAR) AS cache_key", "event_type AS cache_key")


def _hot_requests(spark, sf):
    requests = d.as_requests(spark.read.parquet(f"{sf}/events.parquet"), "event_type")
    return requests.withColumn("cache_key", F.col("event_type")).drop("event_type")


@query(o.with_(_HOT, o.TTL, "SELECT request_id, outcome FROM outcomes"))
def cache_outcomes_hot_keys(spark, sf):
    return request_log.ttl_outcomes(_hot_requests(spark, sf)).select("request_id", "outcome")


@query(o.with_(_HOT, o.TTL, o.admitted(500), "SELECT request_id, served FROM served"))
def budget_admission(spark, sf):
    return request_log.admit(_hot_requests(spark, sf), cap=500).select("request_id", "served")


@query(o.with_(_HOT, o.TTL, """SELECT request_id, CASE outcome WHEN 'miss' THEN 'llm' ELSE 'cache_hit' END AS served FROM outcomes"""))
def budget_unlimited(spark, sf):
    return request_log.admit(_hot_requests(spark, sf), cap=0).select("request_id", "served")


# ---------------------------------------------------------------- streams

def _event_stream(spark, sf) -> DataFrame:
    table = f"{sf}/events.parquet"
    # A pattern also stands for a table that is one file; a plain path has to be a folder.
    return d.as_requests(spark.readStream.schema(spark.read.parquet(table).schema).parquet(f"{table}*"))


def _drain(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Run a stream over what has arrived, into files, and read them back."""
    folder = scratch(spark, "stream")
    (stream.writeStream.format("parquet").option("path", f"{folder}/rows")
     .option("checkpointLocation", f"{folder}/state").outputMode("append")
     .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


@query(o.with_(d.REQUESTS_SQL, o.TTL, "SELECT request_id, outcome FROM outcomes"))
def cache_outcomes_stream(spark, sf):
    return _drain(spark, request_stream.stream_ttl(_event_stream(spark, sf))).select("request_id", "outcome")


@query(o.with_(d.REQUESTS_SQL, o.STREAKS, f"SELECT * FROM streaks WHERE streak >= {c.FALLBACK_ALERT_THRESHOLD}"))
def fallback_alerts_stream(spark, sf):
    scoped = _event_stream(spark, sf).withColumn("scope", F.lit("all"))
    return _drain(spark, request_stream.stream_alerts(scoped, "scope")).select("request_id", "streak")


# Stateful operators with timers need this store.
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FILES = 3


def _shuffled(spark, requests: DataFrame, heartbeat: bool = False) -> DataFrame:
    """A stream over ``requests`` in files that are out of order, one file a batch; a heartbeat far ahead comes last."""
    folder = scratch(spark, "shuffled")
    dealt = requests.withColumn("_file", F.pmod(F.xxhash64("request_id"), F.lit(FILES)))
    for i in range(FILES):
        dealt.where(F.col("_file") == i).drop("_file").coalesce(1).write.mode("append").parquet(folder)
    if heartbeat:
        beat = {"ts": F.expr("timestamp'2200-01-01 00:00:00'"), "request_id": F.lit(-1)}
        spark.range(1).select(*[beat.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in requests.schema]) \
            .write.mode("append").parquet(folder)
    return spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", "1").parquet(folder)


def _settled(spark, stream: DataFrame) -> DataFrame:
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        return _drain(spark, stream).where("request_id >= 0")
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


# Longer than the log, so that files in any order hold no late row.
_WHOLE_LOG = "36500 days"


@query(o.with_(d.REQUESTS_SQL, o.TTL, "SELECT request_id, outcome FROM outcomes"))
def cache_outcomes_event_time(spark, sf):
    """The stream over shuffled files settles every request as the batch form does."""
    stream = _shuffled(spark, d.requests_from_events(spark, sf), heartbeat=True)
    return _settled(spark, event_time.stream_ttl(stream, lateness=_WHOLE_LOG)).select("request_id", "outcome")


_KEYED_STREAKS = """islands AS (SELECT *, sum(CASE WHEN path IN ('llm', 'cache_hit') THEN 1 ELSE 0 END) OVER (PARTITION BY cache_key ORDER BY ts, request_id) AS island FROM requests),
streaks AS (SELECT request_id, CAST(sum(CASE WHEN path = 'fallback' THEN 1 ELSE 0 END) OVER (PARTITION BY cache_key, island ORDER BY ts, request_id) AS BIGINT) AS streak FROM islands)"""


@query(o.with_(d.REQUESTS_SQL, _KEYED_STREAKS, "SELECT request_id, streak FROM streaks"))
def fallback_streaks_event_time(spark, sf):
    """Streaks per key from shuffled files."""
    stream = _shuffled(spark, d.requests_from_events(spark, sf), heartbeat=True)
    return _settled(spark, event_time.stream_streaks(stream, "cache_key", lateness=_WHOLE_LOG)).select("request_id", "streak")


def _metrics_table(spark, sf, key=None, window="1 hour"):
    requests = d.as_requests(spark.read.parquet(f"{sf}/events.parquet"), *([key] if key else []))
    by = [key] if key else []
    updates = metrics_stream.windowed_metrics(_shuffled(spark, requests), *by, window=window, lateness=_WHOLE_LOG)
    folder = scratch(spark, "metrics")
    metrics_stream.start_upsert(updates, f"{folder}/rows", f"{folder}/state", availableNow=True).awaitTermination()
    return metrics_stream.current(spark, f"{folder}/rows", updates.schema, [*by, "window_start", "window_end"])


@query(o.with_(d.REQUESTS_SQL, o.metrics("strftime(ts, '%Y-%m-%d %H')")))
def request_metrics_stream(spark, sf):
    """Hourly metrics, updated batch by batch."""
    table = _metrics_table(spark, sf).withColumn("bucket", F.date_format("window_start", "yyyy-MM-dd HH"))
    return _rounded(table.drop("window_start", "window_end")).select(
        "bucket", "total", *[f"n_{p}" for p in c.REQUEST_PATHS], "fallback_rate", "avg_latency_ms")


@query(f"""SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS total FROM (SELECT *, {d._PATHS} AS path FROM events) GROUP BY 1, 2
  HAVING count(*) > {c.PAGE_MIN_REQUESTS} AND count(*) FILTER (path = 'fallback') / count(*) > {c.PAGE_RATE}""")
def paging_keys_stream(spark, sf):
    """The event types that page someone on a day, from the updated table."""
    table = _metrics_table(spark, sf, "event_type", "1 day")
    return metrics_stream.paging_windows(table).select("event_type", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "total")
