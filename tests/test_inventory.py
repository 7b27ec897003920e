import pytest

from fleetlens.operators import analysis, dependencies, guide, inventory, signals
from fleetlens.sources.files import dirs_of, land_files, prune_ignored, read_files
from tests.helpers import files, rows


def test_pruning(spark):
    df = files(spark, *[("r", p) for p in (
        ".github/workflows/ci.yml", "node_modules/x.js", "src/.env", "Build/x.py", "a/build/x.py",
        "a/builder/x.py", "x/env/y", "main.py")])
    assert sorted(r.path for r in prune_ignored(df).collect()) == [
        "Build/x.py", "a/builder/x.py", "main.py", "src/.env"]


def test_dirs(spark):
    df = files(spark, ("r", "a/b/c.py"), ("r", "a/d.py"), ("r", "e.py"), ("s", "z/q.py"))
    assert rows(dirs_of(df), "repo_id", "path") == [("r", "a"), ("r", "a/b"), ("s", "z")]
    assert rows(inventory.repo_totals(df), "repo_id") == [("r", 3, 2), ("s", 1, 1)]


def test_languages_and_important_files(spark):
    df = inventory.scan(files(spark, ("r", "a.py"), ("r", "B.PY"), ("r", "x.unknown"), ("r", ".py"),
                              ("r", "README.md"), ("r", "sub/LICENSE")))
    assert rows(inventory.language_counts(df), "language") == [("r", "Markdown", 1), ("r", "Python", 2)]
    assert rows(inventory.important_files(df), "path") == [
        ("r", "README.md", "README (Markdown)"), ("r", "sub/LICENSE", "License file")]


LADDER = [
    (["pyproject.toml", "package.json"], "Python package"), (["a/setup.py"], "Python package"),
    (["requirements.txt", "manage.py"], "Django application"), (["manage.py"], "Unknown"),
    (["requirements.txt", "go.mod"], "Python application"),
    (["package.json", "angular.json", "next.config.js"], "Angular application"),
    (["package.json", "next.config.ts"], "Next.js application"),
    (["package.json", "vite.config.js"], "Vite application"), (["Package.json"], "Node.js application"),
    (["Cargo.toml", "go.mod"], "Rust project"), (["go.mod"], "Go module"),
    (["pom.xml"], "Java/JVM project"), (["Dockerfile"], "Containerised application"), (["x"], "Unknown"),
]


def test_project_type(spark):
    df = files(spark, *[(f"{i:02}", p) for i, (names, _) in enumerate(LADDER) for p in names])
    found = [r.type for r in inventory.structure_flags(df).orderBy("repo_id").collect()]
    assert found == [kind for _, kind in LADDER]


def test_structure_flags(spark):
    df = files(spark, ("a", "Tests/x"), ("b", "test_x.py"), ("c", "x_test.py"), ("d", "testing/x"),
               ("e", "Jenkinsfile"), ("f", "docker-compose.yaml"), ("g", ".github/workflows/c.yml"))
    got = {r.repo_id: (r.has_tests, r.has_ci, r.has_docker)
           for r in inventory.structure_flags(df).collect()}
    no = (False, False, False)
    assert got == {"a": (True, False, False), "b": (True, False, False), "c": (True, False, False),
                   "d": no, "e": (False, True, False), "f": (False, False, True), "g": no}
    dotted = inventory.structure_flags(inventory.scan(df), workflows=df).where("repo_id = 'g'").first()
    assert dotted.has_ci and dotted.total_files == 0


def test_entry_points(spark):
    df = inventory.scan(files(
        spark, ("r", "b/main.py"), ("r", "a/main.py"), ("r", "app.js"), ("r", "main.rs"),
        ("r", "package.json", '{"main": "./app.js"}'), ("r", "w/package.json", '{"main": "lib/i.js"}'),
        ("r", "x/package.json", '{"main": 3}'), ("r", "y/package.json", '{"main": " "}'),
        ("r", "z/package.json", "{bad")))
    ordered = inventory.entry_points(df).orderBy("rank", "manifest", "path").collect()
    assert [r.path for r in ordered] == ["a/main.py", "b/main.py", "app.js", "main.rs", "w/lib/i.js"]


def test_readme_pick_and_facts(spark):
    df = inventory.scan(files(spark, ("r", "docs/README.md", "# D"), ("r", "readme.txt", "# R\n\ntext\n## S\nb"),
                              ("s", "b/README", "x"), ("s", "a/ReadMe.md", "# A"), ("t", "x.py")))
    facts = {r.repo_id: r for r in inventory.readme_facts(df).collect()}
    assert {k: (v.path, v.title) for k, v in facts.items()} == {
        "r": ("readme.txt", "R"), "s": ("a/ReadMe.md", "A")}
    assert facts["r"].description == "text" and facts["r"].raw_excerpt == "# R\n\ntext\n## S\nb"
    assert rows(inventory.readme_sections(df)) == [("r", 0, "S", "b")]


def test_extract_dependencies(spark):
    df = inventory.scan(files(spark, ("r", "requirements.txt", "b\na\nb"), ("r", "x/go.mod", "module m")))
    assert rows(dependencies.extract_dependencies(df), "source", "pos") == [
        ("r", "requirements.txt", "requirements.txt", 0, "b"),
        ("r", "requirements.txt", "requirements.txt", 1, "a"),
        ("r", "requirements.txt", "requirements.txt", 2, "b"), ("r", "x/go.mod", "go.mod", None, None)]


def test_signals(spark):
    df = spark.createDataFrame([("r", "engine"), ("r", "Vitest"), ("s", "boto3"), ("s", "psycopg2")],
                               "repo_id string, name string")
    assert rows(signals.architecture_signals(df), "name", "signal") == [
        ("r", "Vitest", "frontend", "vite"), ("s", "boto3", "external", "boto3"),
        ("r", "engine", "backend", "gin")]
    assert rows(signals.architecture_signals(df, exact=True)) == [("s", "boto3", "external", "boto3")]


def whole_repo():
    return [
        ("r", "README.md", "# My API\n"), ("r", "main.py"), ("r", "src/app.py"), ("r", "tests/test_a.py"),
        ("r", "requirements.txt", "fastapi\nuvicorn\nfastapi"), ("r", "web/package.json",
                                                                 '{"dependencies": {"react": "1"}, "main": "m.js"}'),
        ("r", "Dockerfile"), ("r", "node_modules/p/package.json", "[1]")]


def test_assemble(spark):
    scanned = inventory.scan(files(spark, *whole_repo()))
    ok = analysis.assemble_analyses(scanned)
    r = ok.first()
    assert analysis.rejected_repositories(scanned).count() == 0
    assert r.project_name == "My API" and r.languages == ["Python", "JSON", "Markdown"]
    assert [(f.path, f.description) for f in r.important_files] == [
        ("Dockerfile", "Docker container definition"), ("README.md", "README (Markdown)"),
        ("requirements.txt", "Python dependencies (pip)"), ("web/package.json", "Node.js project manifest")]
    assert [d.name for d in r.dependencies] == ["fastapi", "uvicorn", "fastapi", "react"]
    assert r.project_structure == (
        '{"type":"Python application","has_tests":true,"has_ci":false,"has_docker":true,'
        '"top_level_dirs":["src","tests","web"],"entry_points":["main.py","src/app.py","web/m.js"]}')
    made = guide.generate_onboarding(ok).first()
    assert made.setup_guide[:2] == ["python -m pip install -r requirements.txt", "cd web && npm install"]


def test_repo_facts_errors(spark):
    df = inventory.scan(files(
        spark, ("a", "pyproject.toml", "x = = 1"), ("a", "package.json", '{"dependencies": null}'),
        ("b", "q/package.json", '{"dependencies": null}'), ("b", "r/package.json", "[1]"), ("c", "x")))
    got = {r.repo_id: (r.status, r.error) for r in analysis.repo_facts(df).collect()}
    start = "Unexpected error during analysis: "
    assert got == {"a": ("error", start + "'NoneType' object has no attribute 'keys'"),
                   "b": ("error", start + "'list' object has no attribute 'get'"), "c": ("ok", None)}
    ok, rejected = analysis.assemble_analyses(df), analysis.rejected_repositories(df)
    assert [r.repo_id for r in ok.collect()] == ["c"]
    assert sorted(r.repo_id for r in rejected.collect()) == ["a", "b"]


def test_no_repository_is_lost_to_a_limit(spark):
    many = "\n".join(f"p{i}" for i in range(5000))
    wide = [("w", f"d{i}/{'x' * 200}{i}/main.py") for i in range(400)]
    scanned = inventory.scan(files(spark, ("d", "requirements.txt", many), *wide, *[("r", f"d{i}/LICENSE") for i in range(201)]))
    records = analysis.assemble_analyses(scanned)
    got = {r.repo_id: r for r in records.collect()}
    assert len(got["d"].dependencies) == 5000 and len(got["r"].important_files) == 201 and "w" in got
    assert analysis.rejected_repositories(scanned).count() == 0
    assert {r.repo_id: r.violation for r in analysis.validate_limits(records)[1].collect()} == {
        "d": "dependencies exceeds limit of 500 items (got 5000)", "r": "important_files exceeds limit of 200 items (got 201)",
        "w": "project_structure exceeds size limit of 64 KiB when serialised"}
    guides = {r.repo_id: r for r in guide.generate_onboarding(records).collect()}
    assert set(guides) == {"d", "r", "w"} and len(guides["d"].dependencies) == 5000
    items = analysis.record_items(scanned).where("repo_id = 'd' and section = 'dependencies'").orderBy("pos").collect()
    assert [r.text for r in items] == [f"p{i}" for i in range(5000)]


def test_directories_of_ignored_files(spark):
    df = inventory.scan(files(spark, ("r", "tests/node_modules/a.js"), ("r", "a.py"), ("r", "x/.git/y/z"), ("s", "node_modules/q.js")))
    assert rows(dirs_of(df), "repo_id", "path") == [("r", "tests"), ("r", "x")]
    assert rows(inventory.top_level_dirs(df), "dir") == [("r", "tests"), ("r", "x")]
    assert rows(inventory.repo_totals(df), "repo_id") == [("r", 1, 2), ("s", 0, 0)]
    flags = {r.repo_id: (r.total_files, r.has_tests, r.type) for r in inventory.structure_flags(df).collect()}
    assert flags == {"r": (1, True, "Unknown"), "s": (0, False, "Unknown")}
    facts = {r.repo_id: (r.total_files, r.total_dirs, r.has_tests) for r in analysis.repo_facts(df).collect()}
    assert facts == {"r": (1, 2, True), "s": (0, 0, False)}


def test_workflows_count_where_asked_for(spark):
    listed = files(spark, ("r", ".github/workflows/ci.yml"), ("r", "a.py"), ("s", "b.py"))
    scanned = inventory.scan(listed)
    assert [r.has_ci for r in inventory.structure_flags(scanned).collect()] == [False, False]
    flags = {r.repo_id: (r.has_ci, r.total_files) for r in inventory.structure_flags(scanned, listed).collect()}
    assert flags == {"r": (True, 1), "s": (False, 1)}


def test_read_and_land_files(spark, tmp_path):
    root = tmp_path / "in put"
    for repo, path, *body in whole_repo():
        target = root / repo / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(body[0] if body else "x")
    (root / "s").mkdir()
    (root / "s" / "a b+c%20.py").write_bytes(b"\xff ok")
    names = ["__init__.py", "__main__.py", ".env.example", ".flake8", "_config.yml", ".github/workflows/ci.yml",
             "__tests__/x.js", "README.md", "tests/node_modules/k.js", "src/a.py"]
    for name in names:
        (root / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (root / "t" / name).write_text("x")
    df = read_files(spark, str(root), all_bodies=True)
    assert sorted(r.path for r in df.where("repo_id = 't'").collect()) == sorted(names)
    assert rows(dirs_of(inventory.scan(df.where("repo_id = 't'"))), "path") == [("t", "__tests__"), ("t", "src"), ("t", "tests")]
    several = read_files(spark, str(tmp_path / "in*"))
    assert several.count() == df.count()
    assert {r.path for r in several.where("content is not null").collect()} == {
        "README.md", "requirements.txt", "web/package.json", "node_modules/p/package.json"}
    assert sorted(r.path for r in df.where("repo_id = 'r'").collect()) == sorted(p for _, p, *_ in whole_repo())
    odd = df.where("repo_id = 's'").first()
    assert (odd.path, odd.content, odd.size) == ("a b+c%20.py", "\ufffd ok", 4)
    land_files(df, str(tmp_path / "landed"))
    landed = spark.read.parquet(str(tmp_path / "landed"))
    direct = analysis.assemble_analyses(inventory.scan(df))
    again = analysis.assemble_analyses(inventory.scan(landed))
    assert sorted(map(str, direct.collect())) == sorted(map(str, again.collect()))
    plan = dependencies.parse_manifests(inventory.scan(landed))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(file_class" in plan


def test_walk_by_frontier(spark, tmp_path):
    """A deep tree, links that lead upwards, dead links, empty and ignored directories."""
    root = tmp_path / "roots"
    deep = "/".join(f"d{i}" for i in range(25))
    names = [f"{deep}/end.py", "src/a.py", "src/b/c.py", "node_modules/p/index.js", ".git/config", "only/.cache/x", "README.md"]
    for name in names:
        (root / "mono" / name).parent.mkdir(parents=True, exist_ok=True)
        (root / "mono" / name).write_text("x")
    (root / "mono" / "empty").mkdir()
    (root / "mono" / "src" / "up").symlink_to(root / "mono")
    (root / "mono" / "src" / "over").symlink_to(root)
    (root / "mono" / "README.txt").symlink_to(root / "nowhere")
    (root / "mono" / "linked.py").symlink_to(root / "mono" / "src" / "a.py")
    (root / "stray.txt").write_text("belongs to no repository")
    found = read_files(spark, str(root))
    assert sorted(r.path for r in found.collect()) == sorted([*names, "README.txt", "linked.py"])
    assert {r.path: r.content for r in found.where("content is not null").collect()} == {"README.md": "x"}
    pruned = read_files(spark, "file://" + str(root), prune=True)
    assert sorted(r.path for r in pruned.collect()) == sorted(
        [*[n for n in names if not n.startswith(("node", ".git", "only"))], "README.txt", "linked.py", "node_modules/", ".git/", "only/.cache/"])
    for df in (found, pruned):
        assert rows(inventory.repo_totals(inventory.scan(df))) == [("mono", 6, 28)]
        assert ("mono", "only") in rows(dirs_of(inventory.scan(df)), "path")
    assert read_files(spark, str(root / "mono" / "empty")).count() == 0
