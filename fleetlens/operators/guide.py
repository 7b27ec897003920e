"""The rule-based onboarding guide.

A record is one row with bounded lists, so the whole guide is a chain of projections over it:
no join, no shuffle, any number of repositories in parallel.  The parts name columns and hold no
data, so each expression is built once per process.
"""

from functools import cache, reduce

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens import catalogs
from fleetlens.functions import names, paths
from fleetlens.functions.text import (concat_all, head, literal_map, no_strings, one_of, py_repr, some,
                                      strings)
from fleetlens.operators import signals


RECORD_FIELDS = ("schema_version", "project_name", "languages", "frameworks", "important_files",
                 "dependencies", "project_structure")


def _text(*parts) -> Column:
    """Concatenation of literals and columns."""
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _missing(c) -> Column:
    return c.isNull() | (c == "")


def _named(files, *wanted) -> Column:
    return F.filter(files, lambda f: one_of(f["name"], wanted))


def _requirements(f) -> Column:
    return f["name"].rlike(catalogs.REQUIREMENTS_PATTERN)


# ---------------------------------------------------------------- what the record tells

def with_structure(analyses: DataFrame) -> DataFrame:
    """Add the parsed structure: ``_tree`` (object entries in order) or ``_listed`` (flat list)."""
    text = F.col("project_structure")
    return (analyses
            .withColumns({
                "_map": F.from_json(text, "map<string,variant>"),
                "_listed": F.when(F.startswith(F.ltrim(text), F.lit("[")),
                                  F.from_json(text, "array<string>"))})
            .withColumn("_tree", F.map_entries("_map")))


def _list_of(v) -> Column:
    """Members of a VARIANT list as strings, NULL when it is not a list."""
    return F.when(F.startswith(F.schema_of_variant(v), F.lit("ARRAY")),
                  F.try_variant_get(v, "$", "array<string>"))


def _member(key) -> Column:
    """Value under a structure key, NULL when absent or when the structure is not an object."""
    return F.element_at("_map", key)


def _flag(key) -> Column:
    """Truth of a structure value."""
    v = _member(key)
    kind = F.schema_of_variant(v)
    truth = (
        F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(kind == "VOID", False)
        .when(kind == "STRING", F.try_variant_get(v, "$", "string") != "")
        .when(kind == "OBJECT<>", False)
        .when(F.startswith(kind, F.lit("ARRAY")), F.size(F.try_variant_get(v, "$", "array<variant>")) > 0)
        .when(F.startswith(kind, F.lit("OBJECT")), True)
        .otherwise(F.try_variant_get(v, "$", "double") != 0))
    return F.coalesce(truth, F.lit(False))


def detected_files(analyses: DataFrame) -> DataFrame:
    """Add ``detected``: important files, then structure leaves, without repeats, in order."""
    def leaves(e):
        items = F.transform(F.coalesce(_list_of(e["value"]), no_strings()), paths.posix)
        key = paths.posix(e["key"])
        return F.transform(items, lambda i: F.when(F.startswith(i, F.lit("/")), i)
                           .otherwise(F.concat(key, F.lit("/"), i)))

    tree = F.filter(F.col("_tree"), lambda e: ~one_of(e["key"], catalogs.STRUCTURE_METADATA_KEYS))
    candidates = concat_all(
        F.transform("important_files", lambda f: f["path"]),
        F.coalesce(F.flatten(F.transform(tree, leaves)), no_strings()),
        F.coalesce(F.col("_listed"), no_strings()))
    clean = F.filter(F.transform(candidates, paths.rel_path), lambda p: p.isNotNull() & (p != ""))
    return analyses.withColumn("detected", F.array_distinct(clean))


def shown_file(p) -> Column:
    """What the guide steps look at in a path."""
    return F.struct(p.alias("path"), F.lower(paths.basename(p)).alias("name"), paths.dir_of(p).alias("dir"),
                    paths.basename(p).alias("base"))


def looks_like_test(f) -> Column:
    segments = F.slice(F.split(F.lower(f["path"]), "/"), 1, 2)
    return F.arrays_overlap(segments, strings(catalogs.TEST_DIR_SIGNALS)) | reduce(
        lambda a, b: a | b, [F.contains(f["name"], F.lit(s)) for s in catalogs.TEST_FILE_SIGNALS])


def with_signals(analyses: DataFrame) -> DataFrame:
    """Everything the guide steps look at, one column per signal."""
    reported = F.transform(
        F.filter(F.coalesce(_list_of(_member("entry_points")), no_strings()),
                 lambda e: ~e.rlike(r"(?U)^\s*$")), paths.posix)
    known_entries = F.transform(_named(F.col("files"), *catalogs.WELL_KNOWN_ENTRIES),
                                lambda f: f["path"])
    dep_names = F.transform("dependencies", lambda d: d["name"])
    shown = F.transform("detected", shown_file)
    df = detected_files(with_structure(analyses)).withColumns({
        "files": shown, "dep_names": dep_names, "langs": F.transform("languages", F.lower),
        "top_dirs": _list_of(_member("top_level_dirs"))})
    df = df.withColumns({
        "dep_keys": F.transform("dep_names", names.normalise_dep),
        "entries": F.when(F.size(reported) > 0, reported).otherwise(known_entries),
        "manifests": _named(F.col("files"), "package.json"),
        "locks": _named(F.col("files"), *catalogs.LOCKFILES),
        "signal_names": signals.signal_names(F.col("frameworks"), F.col("dep_names"))})
    # The package manager of a manifest is pinned by the first lock file of its own directory.
    pinned = F.transform("manifests", lambda m: F.struct(
        m["path"].alias("path"), m["dir"].alias("dir"),
        F.element_at(literal_map(catalogs.LOCKFILES),
                     head(F.filter("locks", lambda k: k["dir"] == m["dir"]))["name"]).alias("pm")))
    return (df.withColumns({"node": pinned, "entry": head(F.col("entries"))})
            .withColumn("entry_dir", F.coalesce(paths.dir_of("entry"), F.lit(""))))


# ---------------------------------------------------------------- guide parts

@cache
def overview_dirs() -> Column:
    """Top-level directories, by the shape of the structure."""
    def segments(raw):
        return F.transform(raw, lambda p: F.split(paths.posix(p), "/"))

    from_list = F.array_distinct(F.filter(
        F.transform(segments(F.col("_listed")), head), lambda s: s != ""))
    from_files = F.array_distinct(F.transform(
        F.filter(segments(F.transform("important_files", lambda f: f["path"])),
                 lambda s: F.size(s) > 1), head))
    listed = F.try_variant_get(F.element_at("_map", "top_level_dirs"), "$", "array<variant>")
    # Entries that count as nothing are dropped: null, "", 0, false, and empty lists and objects.
    reported = F.coalesce(F.transform(
        F.filter(listed, lambda v: v.isNotNull() & ~F.coalesce(F.to_json(v), F.lit("null")).isin(
            "null", '""', "0", "0.0", "-0.0", "false", "[]", "{}")),
        lambda v: F.try_variant_get(v, "$", "string")), no_strings())
    return (
        F.when(F.col("_map").isNotNull(),
               F.when(F.map_contains_key("_map", "top_level_dirs"), reported)
               .otherwise(F.filter(F.map_keys("_map"), lambda k: k != "")))
        .when(F.size("_listed") > 0, from_list)
        .otherwise(from_files))


@cache
def overview() -> Column:
    name, langs = F.col("project_name"), F.array_join("languages", ", ")
    has_name, has_langs = ~_missing(name), F.size("languages") > 0
    first = (
        F.when(has_name & has_langs,
               _text("'", name, "' is a software project primarily written in ", langs, "."))
        .when(has_name, _text("'", name, "' is a software project."))
        .when(has_langs, _text("This project is primarily written in ", langs, "."))
        .otherwise("This project's name and primary language were not detected."))
    dirs = F.transform("top_overview", lambda d: _text("'", d, "'"))
    return F.concat_ws(
        " ", first,
        F.when(F.size("frameworks") > 0,
               _text("It makes use of ", F.array_join("frameworks", ", "), ".")),
        F.when(F.size("top_overview") > 0,
               _text("The repository is organized into the following top-level directories: ",
                     F.array_join(dirs, ", "), ".")),
        F.when(F.size("dep_names") > 0,
               _text("Key dependencies include ", F.array_join("dep_names", ", "), ".")))


@cache
def tech_stack() -> Column:
    def items(column, category):
        return F.transform(column, lambda n: F.struct(
            n.alias("name"), F.lit(category).alias("category"), F.lit(catalogs.ROLE).alias("role")))

    return F.concat(items("languages", "language"), items("frameworks", "framework"))


@cache
def file_explanations() -> Column:
    return F.transform("important_files", lambda f: F.struct(
        f["path"].alias("path"),
        F.when(_missing(f["description"]), catalogs.PURPOSE_UNKNOWN).otherwise(f["description"])
        .alias("purpose")))


@cache
def dependency_explanations() -> Column:
    return F.transform("dep_names", lambda n: F.struct(
        n.alias("name"), names.dependency_purpose(n).alias("purpose")))


def python_install() -> Column:
    files = F.col("files")
    requirements = head(F.filter(files, _requirements))["path"]

    def editable(name):
        found = head(_named(files, name))
        return F.when(found.isNotNull(), _text(
            paths.run_in(found["dir"], "python -m pip install -e ."),
            " # editable install of the project in '", found["path"], "'"))

    return F.coalesce(_text("python -m pip install -r ", requirements),
                      editable("pyproject.toml"), editable("setup.py"))


def _fetch(name, command) -> Column:
    found = head(_named(F.col("files"), name))
    return some(found.isNotNull(), paths.run_in(found["dir"], command))


def go_install() -> Column:
    return _fetch("go.mod", "go mod download")


def rust_install() -> Column:
    return _fetch("cargo.toml", "cargo fetch")


def node_install() -> Column:
    return F.transform("node", lambda m: paths.run_in(
        m["dir"], _text(F.coalesce(m["pm"], F.lit("npm")), " install")))


@cache
def install_steps() -> Column:
    python = python_install()
    return concat_all(some(python.isNotNull(), python), node_install(), go_install(), rust_install())


@cache
def unresolved_step() -> Column:
    return _text(
        "Dependencies detected: ", F.array_join("dep_names", ", "), " — no dependency manifest "
        "(requirements.txt, pyproject.toml, package.json, go.mod or Cargo.toml) "
        "was detected, so the install command was not determined.")


@cache
def install_gaps() -> Column:
    return lock_gaps("node")


def lock_gaps(packages) -> Column:
    locks = " / ".join(sorted(catalogs.LOCKFILES))
    return F.transform(F.filter(packages, lambda m: m["pm"].isNull()), lambda m: _text(
        "no lock file next to '", m["path"], f"' was detected ({locks}), so npm is assumed"))


def template_steps() -> Column:
    return F.transform(_named(F.col("files"), *catalogs.ENV_TEMPLATES), lambda f: _text(
        "cp ", f["path"], " ", F.when(f["dir"] != "", _text(f["dir"], "/.env")).otherwise(".env"),
        " # copy the template, then fill in the values it lists"))


def config_steps() -> Column:
    return F.transform(_named(F.col("files"), *catalogs.CONFIG_FILES), lambda f: _text(
        "Review the configuration file '", f["path"], "' before running the project."))


@cache
def env_steps() -> Column:
    return F.concat(template_steps(), config_steps())


@cache
def env_gaps() -> Column:
    return F.transform(_named(F.col("files"), *catalogs.ENV_TEMPLATES), lambda f: _text(
        "the variable names required by '", f["path"], "' were not detected "
        "(the analyzer reports the file, not its contents)"))


@cache
def start_command() -> Column:
    """``STRUCT<command, caveat>`` for the first entry point."""
    path = F.col("entry")
    name = F.lower(paths.basename(path))
    module = paths.module_of(path)
    server = F.arrays_overlap("dep_keys", strings(catalogs.ASGI_SERVERS))
    framework = F.arrays_overlap("dep_keys", strings(catalogs.ASGI_FRAMEWORKS))
    python, served = name.rlike(r"\.py\z"), _text("uvicorn ", module, ":app --reload")
    command = (
        F.when(python & server, served)
        .when(python & F.array_contains("dep_keys", "flask"),
              _text("flask --app ", module, " run --debug"))
        .when(python, _text("python ", path))
        .when(name.rlike(r"\.go\z"), _text("go run ", path))
        .when(name.rlike(r"\.[mc]?js\z"), _text("node ", path)))
    caveat = (
        F.when(python & server & framework, _text(
            "the ASGI application object name in '", path, "' was not detected — "
            "':app' assumes the conventional name"))
        .when(python & server, _text(
            "no known ASGI framework was detected, so the object name in '", path,
            "' was not detected — confirm ':app'"))
        .when(name.rlike(r"\.(?:tsx?|jsx)\z"), _text(
            "'", path, "' needs a build step before it can run, and the build command "
            "was not detected by the analyzer"))
        .when(command.isNull(), _text(
            "the run command for the entry point '", path, "' was not detected")))
    return F.struct(command.alias("command"), caveat.alias("caveat"))


@cache
def start_steps() -> Column:
    no_entry = F.col("entry").isNull()
    return F.concat(
        some(no_entry & (F.size("manifests") == 0), catalogs.NO_ENTRY_POINT),
        some(~no_entry, F.col("start.command")))


def _frontends() -> Column:
    """Packages outside the directory of the entry point."""
    return F.filter("node", lambda m: m["dir"] != F.col("entry_dir"))


def dev_steps(packages) -> Column:
    return F.transform(packages, lambda m: paths.run_in(
        m["dir"], _text(F.coalesce(m["pm"], F.lit("npm")), " run dev")))


@cache
def frontend_steps() -> Column:
    return dev_steps(_frontends())


@cache
def frontend_gaps() -> Column:
    return dev_gaps(_frontends())


def dev_gaps(packages) -> Column:
    return F.transform(packages, lambda m: _text(
        "the 'dev' script in '", m["path"], "' was not detected (the analyzer reads dependencies, "
        "not scripts) — list them with '",
        paths.run_in(m["dir"], _text(F.coalesce(m["pm"], F.lit("npm")), " run")), "'"))


@cache
def docker_steps() -> Column:
    return some(F.size(_named(F.col("files"), *catalogs.CONTAINER_FILES)) > 0, _text(
        "docker build -t ", names.docker_slug("project_name"),
        " .  # Dockerfile detected at the repository root"))


@cache
def test_step() -> Column:
    """Test command, NULL when the record shows no tests."""
    def language(name):
        return F.array_contains("langs", name)

    has_tests = _flag("has_tests") | F.exists("files", looks_like_test)
    command = (
        F.when(language("python"), "python -m pytest  # run from the directory that contains the tests")
        .when(language("go"), "go test ./...")
        .when(language("rust"), "cargo test")
        .when((F.size("manifests") > 0) | (language("typescript") & language("javascript")),
              "npm test  # the test script in package.json was not detected by the analyzer")
        .when(F.arrays_overlap("dep_keys", strings(catalogs.TEST_DIR_SIGNALS)), "npm test")
        .otherwise("the test runner for this project was not detected by the analyzer"))
    return F.when(has_tests, command)


def runner_steps() -> Column:
    return F.transform(_named(F.col("files"), *catalogs.TASK_RUNNERS), lambda f: _text(
        paths.run_in(f["dir"], f["base"]), " <target>  # the available targets in '", f["path"],
        "' were not detected"))


def ci_steps() -> Column:
    return some(_flag("has_ci"), (
        "CI configuration was detected — run your change through the same "
        "pipeline the repository uses before opening a pull request."))


@cache
def ci_and_runner_steps() -> Column:
    return F.concat(ci_steps(), runner_steps())


@cache
def starter_tasks() -> Column:
    files, top = F.col("files"), F.col("top_dirs")
    has_top = F.coalesce(F.size(top) > 0, F.lit(False))
    manifests = F.transform(
        F.filter(files, lambda f: one_of(f["name"], catalogs.MANIFESTS) | _requirements(f)),
        lambda f: py_repr(f["path"]))
    read = F.when(F.size("important_files") > 0, _text(
        "Read the ", F.size("important_files").cast("string"),
        " file(s) the analyzer flagged as important, starting with '",
        paths.posix(head(F.col("important_files"))["path"]),
        "', and note what each one is responsible for.")).otherwise(
        "No important files were detected by the analyzer — list the repository "
        "root and identify the main source directory yourself.")
    follow = F.when(F.size(manifests) > 0, _text(
        "Open ", F.array_join(manifests, " and "), " and find where the "
        "declared dependencies are actually imported in the code.")).otherwise(
        "No dependency manifest was detected by the analyzer — ask a teammate "
        "which packages need to be installed before running the project.")
    through = F.when(has_top, _text(" through the top-level directories ",
                                    F.array_join(F.transform(top, py_repr), ", "))).otherwise("")
    trace = F.when(F.col("entry").isNotNull(), _text(
        "Trace the code path from the detected entry point '", F.col("entry"), "'", through,
        ".")).otherwise(
        "No application entry point was detected by the analyzer — find the "
        "process that starts the project and work backwards from it.")
    prove = F.when(F.col("test").isNotNull(), _text(
        "Get the project running locally and confirm the test suite passes (",
        F.trim(F.regexp_extract("test", "^([^#]*)", 1)), ").")).otherwise(
        "No test suite was detected by the analyzer — start the project locally "
        "and confirm the main process comes up.")
    where = F.when(has_top, _text(" in '", paths.posix(head(top)), "'")).otherwise("")
    change = _text("Make one small, low-risk change", where, " — a documentation fix or a "
                   "clarifying comment — and open it as a review to learn the contribution flow.")
    return F.array(read, follow, trace, prove, change)


@cache
def architecture_diagram() -> Column:
    """Diagram from the ``tier_*`` and ``services`` columns."""
    return signals.diagram(F.col("tier_frontend"), F.col("tier_backend"), F.col("tier_database"),
                           F.col("services"))


@cache
def completeness_notes() -> Column:
    def note(condition, text):
        return some(condition, text)

    return concat_all(
        note(_missing(F.col("project_name")), "project_name unavailable"),
        note((F.size("languages") == 0) & (F.size("frameworks") == 0),
             "languages/frameworks unavailable"),
        note(F.size("important_files") == 0, "important_files unavailable"),
        note(F.size("dependencies") == 0, "dependencies unavailable"),
        F.transform("setup_gaps", lambda g: _text("setup_guide: ", g)),
        F.array(F.lit(catalogs.ARCHITECTURE_NOTE)),
        note(F.col("project_structure").isNull(), "project_structure unavailable"))


def with_steps(signalled: DataFrame) -> DataFrame:
    """Guide parts shared by the setup guide, the workflow and the notes."""
    df = signalled.withColumns({
        "start": F.when(F.col("entry").isNotNull(), start_command()),
        "install_found": install_steps(), "install_gap": install_gaps(),
        "env": env_steps(), "env_gap": env_gaps(),
        "front": frontend_steps(), "front_gap": frontend_gaps(),
        "docker": docker_steps(), "test": test_step(), "top_overview": overview_dirs(),
        "services": signals.services(F.col("signal_names")),
        **{f"tier_{t}": signals.tier_present(F.col("signal_names"), t) for t in signals.TIERS}})
    df = df.withColumns({
        "install": F.when(F.size("install_found") > 0, F.col("install_found"))
        .otherwise(some(F.size("dep_names") > 0, unresolved_step())),
        "start_step": start_steps(),
        "start_gap": some(F.col("start.caveat").isNotNull(), F.col("start.caveat"))})
    # A lone "not detected" start statement says nothing when no step precedes it.
    lone = (F.col("start_step") == F.array(F.lit(catalogs.NO_ENTRY_POINT))) \
        & (F.size("install") == 0) & (F.size("env") == 0)
    df = df.withColumn("start_shown", F.when(lone, no_strings()).otherwise(F.col("start_step")))
    steps = concat_all(F.col("install"), F.col("env"), F.col("start_shown"), F.col("front"), F.col("docker"))
    return df.withColumns({
        "setup_found": steps,
        "setup_gaps": concat_all(F.col("install_gap"), F.col("env_gap"), F.col("start_gap"),
                                 F.col("front_gap"))})


@cache
def setup_guide() -> Column:
    return F.when(F.size("setup_found") > 0, F.col("setup_found")) \
        .otherwise(F.array(F.lit(catalogs.NOT_DETECTED)))


@cache
def development_workflow() -> Column:
    gaps = F.array_distinct(concat_all(
        F.col("start_gap"), F.col("front_gap"), F.col("install_gap"), F.col("env_gap")))
    steps = concat_all(
        F.col("start_step"), F.col("front"), F.col("install"), F.col("env"), F.col("docker"),
        some(F.col("test").isNotNull(), F.col("test")), ci_and_runner_steps(),
        F.transform(gaps, lambda g: _text("Not detected: ", g, ".")))
    return F.when(F.size("setup_found") > 0, steps).otherwise(F.array(F.lit(catalogs.NOT_DETECTED)))


def generate_onboarding(analyses: DataFrame) -> DataFrame:
    """One guide per record; columns outside the record are kept."""
    keys = [c for c in analyses.columns if c not in RECORD_FIELDS]
    return with_steps(with_signals(analyses)).select(
        *keys,
        overview().alias("project_overview"),
        tech_stack().alias("tech_stack"),
        F.lit(catalogs.ARCHITECTURE_PROSE).alias("architecture"),
        file_explanations().alias("important_files"),
        dependency_explanations().alias("dependencies"),
        setup_guide().alias("setup_guide"),
        development_workflow().alias("development_workflow"),
        starter_tasks().alias("starter_tasks"),
        architecture_diagram().alias("architecture_diagram"),
        F.lit(False).alias("used_llm"),
        completeness_notes().alias("data_completeness_notes"),
        F.lit(1).alias("schema_version"))
