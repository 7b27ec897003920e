"""DuckDB statements that compute the registered queries independently.

They share only the derived input tables and the fixed values with the Spark side; every rule
is written again in terms of DuckDB lists, lambdas and JSON functions.
"""

from fleetlens import catalogs as c
from fleetlens.sources import derived as d


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(q(v) for v in values) + ")"


def sql_list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def values_table(name: str, columns: str, rows) -> str:
    body = ", ".join("(" + ", ".join(q(v) if isinstance(v, str) else str(v) for v in row) + ")"
                     for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


def with_(*ctes_and_body: str) -> str:
    *ctes, body = ctes_and_body
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body


# ---------------------------------------------------------------- shared pieces

FILES = d.FILES_SQL
SCANNED = f"""scanned AS (
  SELECT repo_id, path, content, parts, lower(parts[-1]) AS name,
    CASE WHEN contains(path, '/') THEN array_to_string(parts[:-2], '/') ELSE '' END AS dir
  FROM (SELECT *, string_split(path, '/') AS parts FROM files)
  WHERE len(list_filter(parts[:-2], lambda x: x IN {in_list(c.IGNORED_DIRS)} OR x LIKE '.%')) = 0)"""
_SEEN = f"list_position(list_transform(parts[:-2], lambda x: x IN {in_list(c.IGNORED_DIRS)} OR x LIKE '.%'), true)"
#: Every directory that a listing shows before its first ignored one, files in it or not.
DIRS = f"""dirs AS (
  SELECT DISTINCT repo_id, array_to_string(parts[:n], '/') AS path
  FROM (SELECT repo_id, parts, unnest(range(1, coalesce({_SEEN}, len(parts)))) AS n FROM (
    SELECT repo_id, string_split(path, '/') AS parts FROM files)))"""
BASE = (FILES, SCANNED)

LANGUAGES = values_table("language_of", "extension, language", c.LANGUAGES.items())
LABELS = values_table("label_of", "name, label", c.IMPORTANT_FILES.items())
PURPOSES = values_table("purpose_of", "dep_key, purpose", c.PURPOSES.items())
ENTRY_RANKS = values_table("entry_rank", "name, rank", [(n, i) for i, n in enumerate(c.ENTRY_POINTS)])
SIGNALS = values_table("signal_of", "tier, signal", [
    (t, s) for t, ss in (("frontend", c.FRONTEND_SIGNALS), ("backend", c.BACKEND_SIGNALS),
                         ("database", c.DATABASE_SIGNALS), ("external", c.SERVICE_SIGNALS))
    for s in ss])
NODES = values_table("node_of", "signal, node, label", [
    (s, "Ext_" + s.replace(".", "_").replace(" ", "_").replace("-", "_").replace("@", "").title(),
     s.title()) for s in c.SERVICE_SIGNALS])

EXTENSION = "lower(CASE WHEN regexp_matches(parts[-1], '^.+\\.[^.]+$') THEN regexp_extract(parts[-1], '([^.]+)$', 1) ELSE '' END)"
LANG_FILES = f"""lang_files AS (
  SELECT repo_id, path, extension, language
  FROM (SELECT repo_id, path, {EXTENSION} AS extension FROM scanned) JOIN language_of USING (extension))"""

NUMBERED = """lines AS (
  SELECT repo_id, path, name, i, trim(string_split(content, chr(10))[i]) AS line
  FROM (SELECT *, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM scanned
        WHERE name IN ('requirements.txt', 'pyproject.toml', 'go.mod', 'cargo.toml')))"""

DEPS = f"""
pip_deps AS (
  SELECT repo_id, path, i, 0 AS j, trim(regexp_extract(trim(string_split(line, '#')[1]), '^([^><=!~;@]*)', 1)) AS package
  FROM lines WHERE name = 'requirements.txt' AND line <> '' AND line[1] NOT IN ('#', '-')),
npm AS (
  SELECT repo_id, path, content, json_valid(content) AND coalesce(json_type(CASE WHEN json_valid(content) THEN content END) = 'OBJECT', false) AS ok,
    CASE WHEN json_valid(content) THEN content END AS doc
  FROM scanned WHERE name = 'package.json'),
npm_deps AS (
  SELECT repo_id, path, s * 1000 + i AS i, 0 AS j, keys[i] AS package FROM (
    SELECT *, unnest(range(1, len(keys) + 1)) AS i FROM (
      SELECT repo_id, path, 1 AS s, json_keys(json_extract(doc, '$.dependencies')) AS keys FROM npm WHERE ok
      UNION ALL SELECT repo_id, path, 2, json_keys(json_extract(doc, '$.devDependencies')) FROM npm WHERE ok))),
toml_state AS (
  SELECT *, max(CASE WHEN line LIKE '[%' THEN i END) OVER (PARTITION BY repo_id, path ORDER BY i) AS at FROM lines WHERE name = 'pyproject.toml'),
toml_deps AS (
  SELECT repo_id, path, i, j, regexp_extract(item, '^([^><=!~;\\[@ ]*)', 1) AS package FROM (
    SELECT repo_id, path, i, unnest(items) AS item, unnest(range(1, len(items) + 1)) AS j FROM (
      SELECT repo_id, path, i, regexp_extract_all(line[position('[' IN line):], '"([^"]*)"', 1) AS items
      FROM toml_state WHERE line LIKE 'dependencies = %'))
  UNION ALL
  SELECT t.repo_id, t.path, t.i, 0, regexp_extract(t.line, '^([^ =]+)', 1) FROM toml_state t
  JOIN lines h ON h.repo_id = t.repo_id AND h.path = t.path AND h.i = t.at
  WHERE h.line = '[tool.poetry.dependencies]' AND t.line LIKE '%=%' AND t.line NOT LIKE '[%'
    AND lower(regexp_extract(t.line, '^([^ =]+)', 1)) <> 'python'),
go_state AS (
  SELECT *, coalesce(last_value(CASE WHEN regexp_matches(line, '^require\\s*\\(') THEN 1 WHEN line = ')' THEN 0 END IGNORE NULLS)
    OVER (PARTITION BY repo_id, path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside
  FROM lines WHERE name = 'go.mod'),
go_deps AS (
  SELECT repo_id, path, i, 0 AS j, CASE WHEN regexp_matches(line, '^require\\s+(\\S+)\\s+') THEN regexp_extract(line, '^require\\s+(\\S+)\\s+', 1)
    ELSE string_split(line, ' ')[1] END AS package
  FROM go_state WHERE NOT regexp_matches(line, '^require\\s*\\(') AND line <> ')'
    AND (regexp_matches(line, '^require\\s+(\\S+)\\s+') OR (inside = 1 AND line <> '' AND line NOT LIKE '//%'))),
cargo_state AS (
  SELECT *, max(CASE WHEN line LIKE '[%' THEN i END) OVER (PARTITION BY repo_id, path ORDER BY i) AS at FROM lines WHERE name = 'cargo.toml'),
cargo_deps AS (
  SELECT t.repo_id, t.path, t.i, 0 AS j, regexp_extract(t.line, '^([A-Za-z0-9_\\-]+)\\s*=', 1) AS package
  FROM cargo_state t JOIN lines h ON h.repo_id = t.repo_id AND h.path = t.path AND h.i = t.at
  WHERE h.line IN ('[dependencies]', '[dev-dependencies]') AND regexp_matches(t.line, '^([A-Za-z0-9_\\-]+)\\s*=')),
declared AS (
  SELECT * FROM pip_deps UNION ALL SELECT * FROM npm_deps UNION ALL SELECT * FROM toml_deps
  UNION ALL SELECT * FROM go_deps UNION ALL SELECT * FROM cargo_deps),
kinds(kind, kind_rank) AS (VALUES {", ".join(f"({q(m)}, {i})" for i, m in enumerate(c.MANIFESTS, 1))}),
bad_toml AS (SELECT repo_id, path FROM lines WHERE name = 'pyproject.toml' AND line LIKE '%= =%'),
deps AS (
  SELECT s.repo_id, s.path AS source, k.kind, k.kind_rank,
    row_number() OVER (PARTITION BY s.repo_id, s.path ORDER BY p.i, p.j) - 1 AS rn, p.package
  FROM scanned s JOIN kinds k ON s.name = k.kind
  LEFT JOIN (SELECT * FROM declared WHERE package <> '') p ON p.repo_id = s.repo_id AND p.path = s.path)""".strip()
DEP_BASE = (*BASE, NUMBERED, DEPS)

# Problems that make the whole repository an error.
ERRORS = """errors AS (
  SELECT repo_id, 'Unexpected error during analysis: ' || arg_min(text, (stage, path)) AS error FROM (
    SELECT repo_id, path, 0 AS stage, '''list'' object has no attribute ''get''' AS text FROM npm WHERE json_type(doc) = 'ARRAY'
    UNION ALL SELECT repo_id, path, 2, '''NoneType'' object has no attribute ''keys''' FROM npm WHERE ok AND json_type(doc, '$.dependencies') = 'NULL'
    UNION ALL SELECT repo_id, path, 3, 'Invalid value (at line 1, column 8)' FROM bad_toml)
  GROUP BY 1)"""

MAINS = """mains AS (
  SELECT repo_id, path AS manifest,
    CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*/)[^/]*$', 1) ELSE '' END
      || regexp_replace(doc->>'$.main', '^\\./', '') AS path
  FROM npm WHERE ok AND json_type(doc, '$.main') = 'VARCHAR')"""
ENTRIES = """entries AS (
  SELECT repo_id, path, min((rank, manifest)) AS k FROM (
    SELECT repo_id, path, rank, '' AS manifest FROM scanned JOIN entry_rank USING (name)
    UNION ALL SELECT repo_id, path, 13, manifest FROM mains) GROUP BY 1, 2)"""
ENTRY_BASE = (*DEP_BASE, ENTRY_RANKS, MAINS, ENTRIES)

def _has(*names):
    return f"coalesce(bool_or(name IN {in_list(names)}), false)"


FLAGS = f"""flags AS (
  SELECT repo_id, count(path) AS total_files,
    CASE WHEN {_has('pyproject.toml', 'setup.py')} THEN 'Python package'
      WHEN {_has('requirements.txt')} AND {_has('manage.py')} THEN 'Django application'
      WHEN {_has('requirements.txt')} THEN 'Python application'
      WHEN {_has('package.json')} AND {_has('angular.json')} THEN 'Angular application'
      WHEN {_has('package.json')} AND {_has('next.config.js', 'next.config.ts')} THEN 'Next.js application'
      WHEN {_has('package.json')} AND {_has('vite.config.ts', 'vite.config.js')} THEN 'Vite application'
      WHEN {_has('package.json')} THEN 'Node.js application'
      WHEN {_has('cargo.toml')} THEN 'Rust project'
      WHEN {_has('go.mod')} THEN 'Go module'
      WHEN {_has('pom.xml', 'build.gradle')} THEN 'Java/JVM project'
      WHEN {_has('dockerfile')} THEN 'Containerised application' ELSE 'Unknown' END AS type,
    coalesce(bool_or(starts_with(name, 'test_') OR ends_with(name, '_test.py')), false) OR repo_id IN (
      SELECT repo_id FROM dirs WHERE lower(string_split(path, '/')[-1]) IN {in_list(c.TEST_DIR_NAMES)}) AS has_tests,
    {_has(*c.CI_MARKERS)} AS has_ci, {_has(*c.DOCKER_MARKERS)} AS has_docker
  FROM (SELECT DISTINCT repo_id FROM files) LEFT JOIN scanned USING (repo_id) GROUP BY 1)"""
# ---------------------------------------------------------------- records

REC_PARTS = f"""{d.RECORDS_SQL},
judged AS (
  SELECT part_id, source_text, CASE WHEN NOT json_valid(source_text) THEN 'not a JSON object'
    WHEN json_type(source_text, '$.languages') <> 'ARRAY' THEN 'languages: not a list' END AS reason
  FROM record_texts),
docs AS (
  SELECT part_id, source_text->>'$.project_name' AS project_name,
    coalesce(CAST(source_text->'$.languages' AS VARCHAR[]), []) AS languages,
    coalesce(CAST(source_text->'$.frameworks' AS VARCHAR[]), []) AS frameworks,
    coalesce(CAST(source_text->'$.important_files' AS JSON[]), []) AS file_docs,
    coalesce(CAST(source_text->'$.dependencies' AS JSON[]), []) AS dep_docs,
    CASE WHEN json_type(source_text, '$.project_structure') <> 'NULL' THEN source_text->'$.project_structure' END AS structure
  FROM judged WHERE reason IS NULL),
parsed AS (
  SELECT part_id, project_name, languages, frameworks, structure, file_docs, dep_docs,
    list_transform(file_docs, lambda e: {{'path': CASE json_type(e) WHEN 'VARCHAR' THEN e->>'$' ELSE e->>'$.path' END,
      'description': CASE json_type(e) WHEN 'VARCHAR' THEN NULL ELSE e->>'$.description' END}}) AS files,
    list_transform(dep_docs, lambda e: CASE json_type(e) WHEN 'VARCHAR' THEN e->>'$' ELSE e->>'$.name' END) AS deps
  FROM docs),
broken AS (
  SELECT part_id, 'languages list exceeds limit of 50 items (got ' || len(languages) || ')' AS violation FROM parsed WHERE len(languages) > 50
  UNION ALL SELECT part_id, 'project_name exceeds 2048 characters' FROM parsed WHERE length(project_name) > 2048),
rec AS (SELECT part_id AS id, * EXCLUDE (part_id) FROM parsed)"""

REC_FLEET = f"""{ERRORS},
label_rows AS (SELECT repo_id, path, label FROM scanned JOIN label_of USING (name)),
n_files AS (SELECT repo_id, count(*) AS n FROM label_rows GROUP BY 1),
n_deps AS (SELECT repo_id, count(package) AS n FROM deps GROUP BY 1),
titles AS (
  SELECT repo_id, arg_min({{'t': CASE WHEN starts_with(content, '# ') THEN string_split(content, chr(10))[1][3:] END}}, (contains(path, '/'), path)).t AS title
  FROM scanned WHERE starts_with(name, 'readme') GROUP BY 1),
langs AS (SELECT repo_id, list(language ORDER BY n DESC, language) AS languages FROM (
  SELECT repo_id, language, count(*) AS n FROM lang_files GROUP BY 1, 2) GROUP BY 1),
labelled AS (SELECT repo_id, list({{'path': path, 'description': label}} ORDER BY path) AS files FROM label_rows GROUP BY 1),
flat AS (SELECT repo_id, list(package ORDER BY kind_rank, source, rn) FILTER (package IS NOT NULL) AS deps FROM deps GROUP BY 1),
tops AS (SELECT repo_id, list(path ORDER BY path) AS top FROM dirs WHERE NOT contains(path, '/') GROUP BY 1),
entry_lists AS (SELECT repo_id, list(path ORDER BY k, path) AS entry_points FROM entries GROUP BY 1),
rejects AS (SELECT repo_id, error AS reason FROM errors),
broken AS (
  SELECT repo_id, 'important_files exceeds limit of 200 items (got ' || n || ')' AS violation FROM n_files
    WHERE n > 200 AND repo_id NOT IN (SELECT repo_id FROM errors)
  UNION ALL SELECT repo_id, 'dependencies exceeds limit of 500 items (got ' || n || ')' FROM n_deps
    WHERE n > 500 AND repo_id NOT IN (SELECT repo_id FROM errors)),
rec AS (
  SELECT f.repo_id AS id, title AS project_name, coalesce(languages, []) AS languages, CAST([] AS VARCHAR[]) AS frameworks,
    coalesce(files, []) AS files, coalesce(deps, []) AS deps,
    CAST(to_json({{'type': type, 'has_tests': has_tests, 'has_ci': has_ci, 'has_docker': has_docker,
      'top_level_dirs': coalesce(top, []), 'entry_points': coalesce(entry_points, [])}}) AS JSON) AS structure
  FROM flags f LEFT JOIN titles USING (repo_id) LEFT JOIN langs USING (repo_id) LEFT JOIN labelled USING (repo_id)
  LEFT JOIN flat USING (repo_id) LEFT JOIN tops USING (repo_id) LEFT JOIN entry_lists USING (repo_id)
  WHERE f.repo_id NOT IN (SELECT repo_id FROM rejects))"""
FLEET = (*ENTRY_BASE, LANGUAGES, LABELS, LANG_FILES, DIRS, FLAGS, REC_FLEET)
PARTS = (REC_PARTS,)

# ---------------------------------------------------------------- guide over `rec`


def base(p):
    return f"regexp_extract({p}, '([^/]*)$', 1)"


def dirname(p):
    return f"CASE WHEN contains({p}, '/') THEN regexp_replace({p}, '/[^/]*$', '') ELSE '' END"


def run_in(directory, command):
    return f"CASE WHEN {directory} <> '' THEN 'cd ' || {directory} || ' && ' ELSE '' END || {command}"


def dep_key(n):
    cut = f"regexp_extract(trim({n}), '^([^<>=!~;\\[\\s]*)', 1)"
    return f"lower(CASE WHEN position('@' IN {cut}[2:]) > 0 THEN {cut}[:position('@' IN {cut}[2:])] ELSE {cut} END)"


def repr_(x):
    e = f"replace({x}, '\\', '\\\\')"
    return (f"CASE WHEN contains({x}, '''') AND NOT contains({x}, '\"') THEN '\"' || {e} || '\"' "
            f"ELSE '''' || replace({e}, '''', '\\''') || '''' END")


def ordered_distinct(expr):
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


def named(*names):
    return f"list_filter(det, lambda f: f.name IN {in_list(names)})"


IS_REQ = f"regexp_matches(f.name, {q(c.REQUIREMENTS_PATTERN)})"
_LOCK_PM = "CASE k.name " + " ".join(f"WHEN {q(n)} THEN {q(p)}" for n, p in c.LOCKFILES.items()) + " END"
_ASGI_F, _ASGI_S = sql_list(c.ASGI_FRAMEWORKS), sql_list(c.ASGI_SERVERS)

DETECTED = f"""raw_paths AS (
  SELECT *, list_concat(list_transform(files, lambda f: f.path),
    CASE json_type(structure) WHEN 'OBJECT' THEN flatten(list_transform(
        list_filter(json_keys(structure), lambda k: k NOT IN {in_list(c.STRUCTURE_METADATA_KEYS)} AND json_type(structure->k) = 'ARRAY'),
        lambda k: list_transform(CAST(structure->k AS VARCHAR[]), lambda i: CASE WHEN i LIKE '/%' THEN i ELSE k || '/' || i END)))
      WHEN 'ARRAY' THEN CAST(structure AS VARCHAR[]) ELSE [] END) AS raw
  FROM rec),
cleaned AS (SELECT *, list_filter(list_transform(raw, lambda p: regexp_replace(trim(replace(p, chr(92), '/')), '^\\./', '')),
  lambda p: p <> '') AS every_path FROM raw_paths),
detected AS (SELECT *, {ordered_distinct('every_path')} AS det_paths FROM cleaned),
d1 AS (SELECT *, list_transform(det_paths, lambda p: {{'path': p, 'name': lower({base('p')}), 'base': {base('p')}, 'dir': {dirname('p')}}}) AS det,
  list_transform(deps, lambda n: {dep_key('n')}) AS keys, list_transform(languages, lambda l: lower(l)) AS langs,
  CASE WHEN json_type(structure) = 'OBJECT' AND json_type(structure, '$.entry_points') = 'ARRAY'
    THEN list_filter(CAST(structure->'$.entry_points' AS VARCHAR[]), lambda e: trim(e) <> '') ELSE [] END AS reported,
  CASE WHEN json_type(structure) = 'OBJECT' AND json_type(structure, '$.top_level_dirs') = 'ARRAY'
    THEN CAST(structure->'$.top_level_dirs' AS VARCHAR[]) END AS top
  FROM detected),
d2 AS (SELECT *, CASE WHEN len(reported) > 0 THEN reported ELSE list_transform({named(*c.WELL_KNOWN_ENTRIES)}, lambda f: f.path) END AS entry_list,
  list_transform({named('package.json')}, lambda m: {{'path': m.path, 'dir': m.dir,
    'pm': list_transform(list_filter(det, lambda k: k.name IN {in_list(c.LOCKFILES)} AND k.dir = m.dir), lambda k: {_LOCK_PM})[1]}}) AS node
  FROM d1),
d3 AS (SELECT *, entry_list[1] AS entry, coalesce({dirname('entry_list[1]')}, '') AS entry_dir, lower({base('entry_list[1]')}) AS entry_name,
  {_ASGI_S} AS servers, {_ASGI_F} AS asgi FROM d2)"""

_MODULE = "replace(entry[:-4], '/', '.')"


def pack(condition, value):
    return f"CASE WHEN {condition} THEN [{value}] ELSE CAST([] AS VARCHAR[]) END"


_FIRST_REQ = f"list_filter(det, lambda f: {IS_REQ})[1]"
_LOCK_NAMES = " / ".join(sorted(c.LOCKFILES))


def _editable(name):
    one = f"{named(name)}[1]"
    return (f"{run_in(one + '.dir', q('python -m pip install -e .'))} || ' # editable install of the project in ''' || {one}.path || ''''")


_PYTHON = (f"CASE WHEN {_FIRST_REQ} IS NOT NULL THEN 'python -m pip install -r ' || {_FIRST_REQ}.path "
           f"WHEN {named('pyproject.toml')}[1] IS NOT NULL THEN {_editable('pyproject.toml')} "
           f"WHEN {named('setup.py')}[1] IS NOT NULL THEN {_editable('setup.py')} END")
_TEST_SEGMENT = f"list_has_any(string_split(lower(f.path), '/')[:2], {sql_list(c.TEST_DIR_SIGNALS)})"
_TEST_FILE = " OR ".join(f"contains(f.name, {q(s)})" for s in c.TEST_FILE_SIGNALS)
_FLAG = "coalesce(CASE WHEN json_type(structure) = 'OBJECT' THEN structure->>'$.{0}' = 'true' END, false)"
_PM = "coalesce(m.pm, 'npm')"

STEPS = f"""s1 AS (SELECT *,
  list_concat(list_concat({pack(f'({_PYTHON}) IS NOT NULL', _PYTHON)}, list_transform(node, lambda m: {run_in('m.dir', _PM + " || ' install'")})),
    list_concat({pack(named('go.mod') + '[1] IS NOT NULL', run_in(named('go.mod') + '[1].dir', q('go mod download')))},
      {pack(named('cargo.toml') + '[1] IS NOT NULL', run_in(named('cargo.toml') + '[1].dir', q('cargo fetch')))})) AS found,
  list_transform(list_filter(node, lambda m: m.pm IS NULL), lambda m: 'no lock file next to ''' || m.path || ''' was detected ({_LOCK_NAMES}), so npm is assumed') AS install_gap,
  list_concat(list_transform({named(*c.ENV_TEMPLATES)}, lambda f: 'cp ' || f.path || ' ' || CASE WHEN f.dir <> '' THEN f.dir || '/.env' ELSE '.env' END || ' # copy the template, then fill in the values it lists'),
    list_transform({named(*c.CONFIG_FILES)}, lambda f: 'Review the configuration file ''' || f.path || ''' before running the project.')) AS env,
  list_transform({named(*c.ENV_TEMPLATES)}, lambda f: 'the variable names required by ''' || f.path || ''' were not detected (the analyzer reports the file, not its contents)') AS env_gap,
  CASE WHEN entry_name LIKE '%.py' THEN CASE WHEN list_has_any(keys, servers) THEN 'uvicorn ' || {_MODULE} || ':app --reload'
      WHEN list_contains(keys, 'flask') THEN 'flask --app ' || {_MODULE} || ' run --debug' ELSE 'python ' || entry END
    WHEN entry_name LIKE '%.go' THEN 'go run ' || entry
    WHEN regexp_matches(entry_name, '\\.(js|mjs|cjs)$') THEN 'node ' || entry END AS command,
  CASE WHEN entry_name LIKE '%.py' THEN CASE
      WHEN list_has_any(keys, servers) AND list_has_any(keys, asgi) THEN 'the ASGI application object name in ''' || entry || ''' was not detected — '':app'' assumes the conventional name'
      WHEN list_has_any(keys, servers) THEN 'no known ASGI framework was detected, so the object name in ''' || entry || ''' was not detected — confirm '':app''' END
    WHEN regexp_matches(entry_name, '\\.(go|js|mjs|cjs)$') THEN NULL
    WHEN regexp_matches(entry_name, '\\.(ts|tsx|jsx)$') THEN '''' || entry || ''' needs a build step before it can run, and the build command was not detected by the analyzer'
    ELSE 'the run command for the entry point ''' || entry || ''' was not detected' END AS caveat,
  list_filter(node, lambda m: m.dir <> entry_dir) AS fronts,
  regexp_replace(regexp_replace(lower(coalesce(nullif(project_name, ''), 'app')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
  {_FLAG.format('has_tests')} OR len(list_filter(det, lambda f: {_TEST_SEGMENT} OR {_TEST_FILE})) > 0 AS tested
  FROM d3),
s2 AS (SELECT *,
  CASE WHEN len(found) > 0 THEN found WHEN len(deps) > 0 THEN ['Dependencies detected: ' || array_to_string(deps, ', ') || ' — no dependency manifest (requirements.txt, pyproject.toml, package.json, go.mod or Cargo.toml) was detected, so the install command was not determined.'] ELSE [] END AS install,
  CASE WHEN entry IS NULL THEN {pack('len(node) = 0', q(c.NO_ENTRY_POINT))} ELSE {pack('command IS NOT NULL', 'command')} END AS start_step,
  {pack('entry IS NOT NULL AND caveat IS NOT NULL', 'caveat')} AS start_gap,
  list_transform(fronts, lambda m: {run_in('m.dir', _PM + " || ' run dev'")}) AS front,
  list_transform(fronts, lambda m: 'the ''dev'' script in ''' || m.path || ''' was not detected (the analyzer reads dependencies, not scripts) — list them with ''' || {run_in('m.dir', _PM + " || ' run'")} || '''') AS front_gap,
  {pack(f"len({named(*c.CONTAINER_FILES)}) > 0", "'docker build -t ' || CASE WHEN slug = '' THEN 'app' ELSE slug END || ' .  # Dockerfile detected at the repository root'")} AS docker,
  CASE WHEN NOT tested THEN NULL
    WHEN list_contains(langs, 'python') THEN 'python -m pytest  # run from the directory that contains the tests'
    WHEN list_contains(langs, 'go') THEN 'go test ./...' WHEN list_contains(langs, 'rust') THEN 'cargo test'
    WHEN len(node) > 0 OR (list_contains(langs, 'typescript') AND list_contains(langs, 'javascript')) THEN 'npm test  # the test script in package.json was not detected by the analyzer'
    WHEN list_has_any(keys, {sql_list(c.TEST_DIR_SIGNALS)}) THEN 'npm test'
    ELSE 'the test runner for this project was not detected by the analyzer' END AS test
  FROM s1),
s3 AS (SELECT *, list_concat(list_concat(list_concat(install, env),
    CASE WHEN start_step = [{q(c.NO_ENTRY_POINT)}] AND len(install) + len(env) = 0 THEN [] ELSE start_step END), list_concat(front, docker)) AS setup,
  list_concat(list_concat(install_gap, env_gap), list_concat(start_gap, front_gap)) AS setup_gaps,
  list_concat(list_concat(start_gap, front_gap), list_concat(install_gap, env_gap)) AS all_gaps
  FROM s2)"""
GUIDE = (DETECTED, STEPS)

_HAS_TOP = "coalesce(len(top) > 0, false)"
_MANIFEST_NAMES = ("package.json", "pyproject.toml", "go.mod", "cargo.toml")
_JOINED = "array_to_string({}, chr(10))"

SETUP_SQL = f"SELECT id, {_JOINED.format(f'CASE WHEN len(setup) > 0 THEN setup ELSE [{q(c.NOT_DETECTED)}] END')} AS setup_guide FROM s3"
_WORKFLOW = f"""CASE WHEN len(setup) = 0 THEN [{q(c.NOT_DETECTED)}] ELSE
  list_concat(list_concat(list_concat(start_step, front), list_concat(install, env)), list_concat(list_concat(docker, {pack('test IS NOT NULL', 'test')}),
    list_concat(list_concat({pack(_FLAG.format('has_ci'), q('CI configuration was detected — run your change through the same pipeline the repository uses before opening a pull request.'))},
      list_transform({named(*c.TASK_RUNNERS)}, lambda f: {run_in('f.dir', 'f.base')} || ' <target>  # the available targets in ''' || f.path || ''' were not detected')),
      list_transform({ordered_distinct('all_gaps')}, lambda g: 'Not detected: ' || g || '.')))) END"""
WORKFLOW_SQL = f"SELECT id, {_JOINED.format(_WORKFLOW)} AS development_workflow FROM s3"
# The same as rows.
SETUP_ROWS_SQL = f"""SELECT id, unnest(range(0, len(s))) AS pos, unnest(s) AS step FROM (
  SELECT id, CASE WHEN len(setup) > 0 THEN setup ELSE [{q(c.NOT_DETECTED)}] END AS s FROM s3)"""
WORKFLOW_ROWS_SQL = f"SELECT id, unnest(range(0, len(s))) AS pos, unnest(s) AS step FROM (SELECT id, {_WORKFLOW} AS s FROM s3)"
TASKS_SQL = f"""SELECT id,
  CASE WHEN len(files) > 0 THEN 'Read the ' || len(files) || ' file(s) the analyzer flagged as important, starting with ''' || replace(files[1].path, chr(92), '/') || ''', and note what each one is responsible for.'
    ELSE 'No important files were detected by the analyzer — list the repository root and identify the main source directory yourself.' END AS task_1,
  CASE WHEN len(list_filter(det, lambda f: f.name IN {in_list(_MANIFEST_NAMES)} OR {IS_REQ})) > 0 THEN 'Open ' || array_to_string(list_transform(
      list_filter(det, lambda f: f.name IN {in_list(_MANIFEST_NAMES)} OR {IS_REQ}), lambda f: {repr_('f.path')}), ' and ') || ' and find where the declared dependencies are actually imported in the code.'
    ELSE 'No dependency manifest was detected by the analyzer — ask a teammate which packages need to be installed before running the project.' END AS task_2,
  CASE WHEN entry IS NOT NULL THEN 'Trace the code path from the detected entry point ''' || entry || '''' || CASE WHEN {_HAS_TOP}
      THEN ' through the top-level directories ' || array_to_string(list_transform(top, lambda t: {repr_('t')}), ', ') ELSE '' END || '.'
    ELSE 'No application entry point was detected by the analyzer — find the process that starts the project and work backwards from it.' END AS task_3,
  CASE WHEN test IS NOT NULL THEN 'Get the project running locally and confirm the test suite passes (' || trim(string_split(test, '#')[1]) || ').'
    ELSE 'No test suite was detected by the analyzer — start the project locally and confirm the main process comes up.' END AS task_4,
  'Make one small, low-risk change' || CASE WHEN {_HAS_TOP} THEN ' in ''' || top[1] || '''' ELSE '' END || ' — a documentation fix or a clarifying comment — and open it as a review to learn the contribution flow.' AS task_5
FROM s3"""
NOTES = f"""notes AS (SELECT id, list_filter(list_concat(list_concat([
    CASE WHEN coalesce(project_name, '') = '' THEN 'project_name unavailable' END,
    CASE WHEN len(languages) + len(frameworks) = 0 THEN 'languages/frameworks unavailable' END,
    CASE WHEN len(files) = 0 THEN 'important_files unavailable' END,
    CASE WHEN len(deps) = 0 THEN 'dependencies unavailable' END],
    list_transform(setup_gaps, lambda g: 'setup_guide: ' || g)),
    [{q(c.ARCHITECTURE_NOTE)}, CASE WHEN structure IS NULL THEN 'project_structure unavailable' END]), lambda n: n IS NOT NULL) AS notes FROM s3)"""
NOTES_SQL = f"SELECT id, {_JOINED.format('notes')} AS notes FROM notes"
_SEGMENTS = "list_transform(CAST(structure AS VARCHAR[]), lambda p: string_split(replace(p, chr(92), '/'), '/')[1])"
_FILE_TOPS = "list_transform(list_filter(files, lambda f: contains(replace(f.path, chr(92), '/'), '/')), lambda f: string_split(replace(f.path, chr(92), '/'), '/')[1])"
OVERVIEW = f"""tops_of AS (SELECT *, CASE
    WHEN json_type(structure) = 'OBJECT' AND list_contains(json_keys(structure), 'top_level_dirs') THEN list_filter(coalesce(top, []), lambda t: t <> '')
    WHEN json_type(structure) = 'OBJECT' THEN list_filter(json_keys(structure), lambda k: k <> '')
    WHEN json_type(structure) = 'ARRAY' AND json_array_length(structure) > 0 THEN {_SEGMENTS} ELSE {_FILE_TOPS} END AS tops FROM s3),
tops_distinct AS (SELECT *, list_filter({ordered_distinct('tops')}, lambda t: t <> '') AS dirs6 FROM tops_of)"""
OVERVIEW_SQL = f"""SELECT id, concat_ws(' ',
  CASE WHEN coalesce(project_name, '') <> '' AND len(languages) > 0 THEN '''' || project_name || ''' is a software project primarily written in ' || array_to_string(languages, ', ') || '.'
    WHEN coalesce(project_name, '') <> '' THEN '''' || project_name || ''' is a software project.'
    WHEN len(languages) > 0 THEN 'This project is primarily written in ' || array_to_string(languages, ', ') || '.'
    ELSE 'This project''s name and primary language were not detected.' END,
  CASE WHEN len(frameworks) > 0 THEN 'It makes use of ' || array_to_string(frameworks, ', ') || '.' END,
  CASE WHEN len(dirs6) > 0 THEN 'The repository is organized into the following top-level directories: ' || array_to_string(list_transform(dirs6, lambda x: '''' || x || ''''), ', ') || '.' END,
  CASE WHEN len(deps) > 0 THEN 'Key dependencies include ' || array_to_string(deps, ', ') || '.' END) AS project_overview FROM tops_distinct"""

NAMES = "signal_names AS (SELECT id, lower(unnest(list_concat(frameworks, deps))) AS name FROM rec)"
SUMMARY = """summary AS (
  SELECT id, coalesce(bool_or(tier = 'frontend'), false) AS f, coalesce(bool_or(tier = 'backend'), false) AS b,
    coalesce(bool_or(tier = 'database'), false) AS d,
    coalesce(list(DISTINCT signal ORDER BY signal) FILTER (tier = 'external'), []) AS services
  FROM rec LEFT JOIN (SELECT n.id AS nid, s.* FROM signal_names n JOIN signal_of s ON contains(n.name, s.signal)) ON nid = id GROUP BY 1)"""
DIAGRAM = f"""drawn AS (
  SELECT s.id, concat_ws(chr(10), 'graph TD', CASE WHEN f THEN '    Frontend["Frontend"]' END, CASE WHEN b THEN '    Backend["Backend / API"]' END,
    CASE WHEN d THEN '    Database[("Database")]' END, nodes, CASE WHEN f AND b THEN '    Frontend --> Backend' END,
    CASE WHEN b AND d THEN '    Backend --> Database' END, CASE WHEN b THEN edges END,
    CASE WHEN NOT f AND NOT b AND NOT d AND len(services) = 0 THEN '    Unknown["{c.DIAGRAM_UNKNOWN}"]' END) AS diagram
  FROM summary s LEFT JOIN (
    SELECT id, string_agg('    ' || node || '["' || label || '"]', chr(10) ORDER BY signal) AS nodes,
      string_agg('    Backend --> ' || node, chr(10) ORDER BY signal) AS edges
    FROM (SELECT id, unnest(services) AS signal FROM summary) JOIN node_of USING (signal) GROUP BY 1) g USING (id))"""
DIAGRAM_BASE = (SIGNALS, NODES, NAMES, SUMMARY, DIAGRAM)

# ---------------------------------------------------------------- READMEs

_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e]|\x{0085}|\x{2028}|\x{2029}"
README_RAW = f"""{d.READMES_SQL},
prefixed AS (SELECT repo_id, path, content AS raw FROM readmes),
split_up AS (SELECT *, string_split_regex(raw, '{_BREAK}') AS all_lines FROM prefixed),
kept AS (SELECT *, CASE WHEN all_lines[-1] = '' THEN all_lines[:-2] ELSE all_lines END AS ls FROM split_up),
rl AS (SELECT repo_id, i, ls[i] AS line FROM (SELECT repo_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM kept))"""
README_FACTS_SQL = f"""SELECT k.repo_id, path, title, description, raw AS raw_excerpt
FROM (SELECT repo_id, path, raw, CASE WHEN regexp_matches(raw, '(?m)^#\\s+(.+)$') THEN trim(regexp_extract(raw, '(?m)^#\\s+(.+)$', 1), chr(32) || chr(13)) END AS title FROM kept) k
LEFT JOIN (
  SELECT l.repo_id, string_agg(trim(line), ' ' ORDER BY l.i) AS description FROM rl l JOIN (
    SELECT s.repo_id, first_text, coalesce((SELECT min(x.i) FROM kinds_of x WHERE x.repo_id = s.repo_id AND x.kind = 'stop' AND x.i > first_text), 1000000) AS stop_at
    FROM (SELECT repo_id, min(i) AS first_text FROM kinds_of WHERE kind = 'text' GROUP BY 1) s) b
    ON b.repo_id = l.repo_id AND l.i >= first_text AND l.i < stop_at
    JOIN kinds_of t ON t.repo_id = l.repo_id AND t.i = l.i AND t.kind = 'text' GROUP BY 1) d ON d.repo_id = k.repo_id"""
README_KINDS = """kinds_of AS (SELECT repo_id, i, CASE WHEN trim(line) = '' OR trim(line) LIKE '#%' THEN 'stop'
  WHEN regexp_matches(trim(line), '^(!\\[|<|```)') THEN 'skip' ELSE 'text' END AS kind FROM rl)"""
README_SECTIONS = """fences AS (
  SELECT repo_id, i, line, CASE WHEN regexp_matches(line, '^(`{3}|~{3})') THEN line[1] ELSE '' END AS mark,
    CASE WHEN regexp_matches(line, '^(`{3}|~{3})') THEN line[1] ELSE '' END AS open FROM rl WHERE i = 1
  UNION ALL
  SELECT r.repo_id, r.i, r.line, m.mark, CASE WHEN m.mark = '' THEN f.open WHEN f.open = '' THEN m.mark WHEN f.open = m.mark THEN '' ELSE f.open END
  FROM fences f JOIN rl r ON r.repo_id = f.repo_id AND r.i = f.i + 1,
    LATERAL (SELECT CASE WHEN regexp_matches(r.line, '^(`{3}|~{3})') THEN r.line[1] ELSE '' END AS mark) m),
levels AS (SELECT *, CASE WHEN open = '' AND mark = '' AND regexp_matches(line, '^#{1,6}\\s+.+$') THEN length(regexp_extract(line, '^(#{1,6})\\s', 1)) ELSE 0 END AS level FROM fences),
sectioned AS (SELECT *, sum(CASE WHEN level > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY repo_id ORDER BY i) AS sid FROM levels),
headed AS (SELECT repo_id, sid, level, trim(regexp_extract(line, '^#{1,6}\\s+(.+)$', 1)) AS heading,
  lead(level) OVER (PARTITION BY repo_id ORDER BY sid) AS following FROM sectioned WHERE level > 0),
bodies AS (SELECT repo_id, sid, trim(string_agg(line, chr(10) ORDER BY i), chr(10) || ' ') AS body FROM sectioned
  WHERE level = 0 AND NOT regexp_matches(line, '^(\\s*[-*_]){3,}\\s*$') GROUP BY 1, 2),
flushed AS (SELECT h.repo_id, h.sid, heading, body FROM headed h JOIN bodies b ON b.repo_id = h.repo_id AND b.sid = h.sid
  WHERE level > 1 AND body <> '' AND (following IS NULL OR following = 1 OR following <= level)),
grouped AS (SELECT repo_id, heading, min(sid) AS first_sid, arg_max(body, sid) AS body FROM flushed GROUP BY 1, 2)"""
README_SECTIONS_SQL = "SELECT repo_id, row_number() OVER (PARTITION BY repo_id ORDER BY first_sid) - 1 AS pos, heading, body FROM grouped"

# ---------------------------------------------------------------- request log

TTL = f"""distinct_ts AS (SELECT cache_key, ts, min(request_id) AS first_id FROM requests GROUP BY 1, 2),
pointers AS MATERIALIZED (SELECT a.cache_key, a.ts, b.ts AS nxt FROM (SELECT *, ts + INTERVAL {c.CACHE_TTL_SECONDS} SECONDS AS expires FROM distinct_ts) a
  ASOF LEFT JOIN distinct_ts b ON a.cache_key = b.cache_key AND a.expires < b.ts),
anchors AS (
  SELECT cache_key, min(ts) AS ts FROM distinct_ts GROUP BY 1
  UNION ALL SELECT p.cache_key, p.nxt FROM anchors a JOIN pointers p ON p.cache_key = a.cache_key AND p.ts = a.ts WHERE p.nxt IS NOT NULL),
missed AS (SELECT a.cache_key, a.ts, first_id FROM anchors a JOIN distinct_ts t ON t.cache_key = a.cache_key AND t.ts = a.ts),
outcomes AS (SELECT r.*, CASE WHEN m.first_id IS NOT NULL THEN 'miss' ELSE 'hit' END AS outcome
  FROM requests r LEFT JOIN missed m ON m.cache_key = r.cache_key AND m.ts = r.ts AND m.first_id = r.request_id)"""


def admitted(cap: int) -> str:
    return f"""ranked AS (SELECT cache_key, ts, row_number() OVER (ORDER BY ts, first_id) <= {cap} AS admitted FROM missed),
served AS (SELECT o.request_id, o.outcome, CASE WHEN o.outcome = 'miss' THEN CASE WHEN k.admitted THEN 'llm' ELSE 'fallback' END
    WHEN k.admitted THEN 'cache_hit' ELSE 'fallback' END AS served
  FROM outcomes o ASOF JOIN ranked k ON o.cache_key = k.cache_key AND o.ts >= k.ts)"""


STREAKS = """islands AS (SELECT *, sum(CASE WHEN path IN ('llm', 'cache_hit') THEN 1 ELSE 0 END) OVER (ORDER BY ts, request_id) AS island FROM requests),
streaks AS (SELECT request_id, CAST(sum(CASE WHEN path = 'fallback' THEN 1 ELSE 0 END) OVER (PARTITION BY island ORDER BY ts, request_id) AS BIGINT) AS streak FROM islands)"""


def metrics(by: str = "") -> str:
    lead, group = (f"{by} AS bucket, ", " GROUP BY 1") if by else ("", "")
    counts = ", ".join(f"count(*) FILTER (path = {q(p)}) AS n_{p}" for p in c.REQUEST_PATHS)
    return (f"SELECT {lead}count(*) AS total, {counts}, "
            "round(coalesce(count(*) FILTER (path = 'fallback') / nullif(count(*), 0), 0), 9) AS fallback_rate, "
            f"round(coalesce(avg(latency_ms), 0), 6) AS avg_latency_ms FROM requests{group}")


# ---------------------------------------------------------------- secrets

def secret_case(column: str, patterns) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, {q(p)}) THEN {q(n)}" for n, p in patterns) + " END"


def secrets_sql(table: str, keys: str, column: str) -> str:
    return (f"SELECT * FROM (SELECT {keys}, {secret_case(column, c.SECRET_VALUES)} AS pattern, "
            f"CASE WHEN length({column}) > 4 THEN {column}[:4] || '…' ELSE '****' END AS preview FROM {table}) WHERE pattern IS NOT NULL")


_V = lambda x: secret_case(x, c.SECRET_VALUES)
_F = lambda x: secret_case(base(x), c.SECRET_FILES)
REDACTIONS = f"""structure_leaves AS (
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY o, i) AS n, leaf FROM (
    SELECT id, 0 AS o, unnest(range(1, CAST(json_array_length(structure) AS BIGINT) + 1)) AS i, unnest(CAST(structure AS VARCHAR[])) AS leaf FROM rec WHERE json_type(structure) = 'ARRAY'
    UNION ALL SELECT id, o, unnest(range(1, CAST(json_array_length(v) AS BIGINT) + 1)), unnest(CAST(v AS VARCHAR[])) FROM (
      SELECT id, o, structure->(json_keys(structure)[o]) AS v FROM (SELECT id, structure, unnest(range(1, len(json_keys(structure)) + 1)) AS o FROM rec WHERE json_type(structure) = 'OBJECT')) WHERE json_type(v) = 'ARRAY'
    UNION ALL SELECT id, o, 0, v->>'$' FROM (
      SELECT id, o, structure->(json_keys(structure)[o]) AS v FROM (SELECT id, structure, unnest(range(1, len(json_keys(structure)) + 1)) AS o FROM rec WHERE json_type(structure) = 'OBJECT')) WHERE json_type(v) = 'VARCHAR')),
file_rows AS (SELECT id, i, file_docs[i] AS e, files[i].path AS path, files[i].description AS description, json_type(file_docs[i]) = 'OBJECT' AS entry
  FROM (SELECT *, unnest(range(1, len(files) + 1)) AS i FROM rec)),
dep_rows AS (SELECT id, i, deps[i] AS name, json_type(dep_docs[i]) = 'OBJECT' AS entry, dep_docs[i]->>'$.version' AS version
  FROM (SELECT *, unnest(range(1, len(deps) + 1)) AS i FROM rec)),
events_of AS (
  SELECT id, 1 AS o, 0 AS i, 'project_name' AS field_path, {_V('project_name')} AS pattern FROM rec
  UNION ALL SELECT id, 2, i, 'languages[' || (i - 1) || ']', {_V('languages[i]')} FROM (SELECT id, languages, unnest(range(1, len(languages) + 1)) AS i FROM rec)
  UNION ALL SELECT id, 3, i, 'frameworks[' || (i - 1) || ']', {_V('frameworks[i]')} FROM (SELECT id, frameworks, unnest(range(1, len(frameworks) + 1)) AS i FROM rec)
  UNION ALL SELECT id, 4, i * 2, 'important_files[' || (i - 1) || ']' || CASE WHEN entry THEN '.path' WHEN {_F('path')} IS NOT NULL THEN ' path' ELSE '' END, coalesce({_F('path')}, {_V('path')}) FROM file_rows
  UNION ALL SELECT id, 4, i * 2 + 1, 'important_files[' || (i - 1) || '].description', {_V('description')} FROM file_rows WHERE {_F('path')} IS NULL
  UNION ALL SELECT id, 5, i * 2, 'dependencies[' || (i - 1) || ']' || CASE WHEN entry THEN '.name' ELSE '' END, {_V('name')} FROM dep_rows
  UNION ALL SELECT id, 5, i * 2 + 1, 'dependencies[' || (i - 1) || '].version', {_V('version')} FROM dep_rows
  UNION ALL SELECT id, 6, n, CASE WHEN {_V('leaf')} IS NOT NULL THEN 'project_structure leaf' ELSE 'project_structure filename' END, coalesce({_V('leaf')}, {_F('leaf')}) FROM structure_leaves),
redactions AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY o, i) - 1 AS pos, field_path, pattern FROM events_of WHERE pattern IS NOT NULL)"""

# ---------------------------------------------------------------- audit

KNOWN = """known AS (
  SELECT DISTINCT id, name FROM (
    SELECT id, lower(unnest(languages)) AS name FROM rec UNION ALL SELECT id, lower(unnest(frameworks)) FROM rec
    UNION ALL SELECT id, lower(unnest(deps)) FROM rec
    UNION ALL SELECT id, lower(f.path) FROM (SELECT id, unnest(files) AS f FROM rec)
    UNION ALL SELECT id, unnest(string_split(replace(lower(f.path), chr(92), '/'), '/')) FROM (SELECT id, unnest(files) AS f FROM rec)
    UNION ALL SELECT id, lower(project_name) FROM rec WHERE project_name <> ''))"""
