"""Per-repository facts from file paths.

Every aggregate here combines before the shuffle, so one repository with a large share of all
files sends a few partial rows per task, not its files.
"""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens import catalogs
from fleetlens.functions import paths, readme
from fleetlens.operators.dependencies import parse_manifests
from fleetlens.session import dimension
from fleetlens.sources.files import DIRECTORY, dirs_of, is_file, visible, with_file_class


def scan(files: DataFrame) -> DataFrame:
    """Visible files with their class, and where the walk stopped: the input of the operators below."""
    return visible(files)


def with_language(files: DataFrame) -> DataFrame:
    """Files of a known language; others are dropped."""
    languages = dimension(files.sparkSession, catalogs.LANGUAGES.items(), "extension, language")
    return (files.withColumn("extension", paths.extension("path"))
            .join(F.broadcast(languages), "extension"))


def language_counts(files: DataFrame) -> DataFrame:
    return (with_language(files).groupBy("repo_id", "language")
            .agg(F.count(F.lit(1)).alias("n_files")))


def important_files(files: DataFrame) -> DataFrame:
    labels = dimension(files.sparkSession, catalogs.IMPORTANT_FILES.items(), "name, label")
    return (files.select("repo_id", "path", F.lower(paths.basename("path")).alias("name"))
            .join(F.broadcast(labels), "name").select("repo_id", "path", "label"))


def top_level_dirs(files: DataFrame) -> DataFrame:
    return (files.select("repo_id", F.regexp_extract("path", r"(?s)^([^/]+)/", 1).alias("dir"))
            .where(F.col("dir") != "").distinct())


def project_type(has) -> Column:
    node = (
        F.when(has("angular.json"), "Angular application")
        .when(has("next.config.js", "next.config.ts"), "Next.js application")
        .when(has("vite.config.ts", "vite.config.js"), "Vite application")
        .otherwise("Node.js application")
    )
    return (
        F.when(has("pyproject.toml", "setup.py"), "Python package")
        .when(has("requirements.txt") & has("manage.py"), "Django application")
        .when(has("requirements.txt"), "Python application")
        .when(has("package.json"), node)
        .when(has("cargo.toml"), "Rust project")
        .when(has("go.mod"), "Go module")
        .when(has("pom.xml", "build.gradle"), "Java/JVM project")
        .when(has("dockerfile"), "Containerised application")
        .otherwise("Unknown")
    )


# Names that project_type, has_ci and has_docker look at.
MARKER_NAMES = (
    "pyproject.toml", "setup.py", "requirements.txt", "manage.py", "package.json", "angular.json",
    "next.config.js", "next.config.ts", "vite.config.ts", "vite.config.js", "cargo.toml", "go.mod",
    "pom.xml", "build.gradle", *catalogs.CI_MARKERS, *catalogs.DOCKER_MARKERS,
)


def looks_tested(path, name) -> Column:
    """A file or directory below a test directory, or a file named like a test."""
    low = F.lower(F.concat(F.lit("/"), path))
    below = reduce(or_, [F.contains(low, F.lit(f"/{d}/")) for d in catalogs.TEST_DIR_NAMES])
    return below | F.startswith(name, F.lit("test_")) | F.endswith(name, F.lit("_test.py"))


def structure_flags(files: DataFrame, workflows: DataFrame | None = None) -> DataFrame:
    """``total_files``, ``type``, ``has_tests``, ``has_ci``, ``has_docker`` in one pass over :func:`scan`.

    A walk doesn't enter ``.github``, so its workflows never count as CI; give the listing before the
    scan as ``workflows`` to count them too.
    """
    files, github = with_file_class(files), F.lit(False)
    if workflows is not None:
        listed = workflows.where(F.startswith("path", F.lit(".github/workflows/"))).select(
            "repo_id", F.lit("").alias("path"), F.lit("").alias("name"), F.lit(DIRECTORY).alias("file_class"),
            F.lit(True).alias("github")).distinct()
        files = files.select("repo_id", "path", "name", "file_class", F.lit(False).alias("github")).unionByName(listed)
        github = F.col("github")

    def has(*names):
        return F.bool_or(F.col("name").isin(*names))

    return files.groupBy("repo_id").agg(
        F.count_if(is_file()).alias("total_files"),
        project_type(has).alias("type"),
        F.bool_or(looks_tested(F.col("path"), F.col("name"))).alias("has_tests"),
        F.bool_or(F.col("name").isin(*catalogs.CI_MARKERS) | github).alias("has_ci"),
        has(*catalogs.DOCKER_MARKERS).alias("has_docker"),
    )


def repo_totals(files: DataFrame) -> DataFrame:
    dirs = dirs_of(files).groupBy("repo_id").agg(F.count(F.lit(1)).alias("total_dirs"))
    return (with_file_class(files).groupBy("repo_id").agg(F.count_if(is_file()).alias("total_files"))
            .join(dirs, "repo_id", "left")
            .select("repo_id", "total_files", F.coalesce("total_dirs", F.lit(0)).alias("total_dirs")))


def package_mains(files: DataFrame) -> DataFrame:
    """``main`` of every package.json, resolved against its directory."""
    return (parse_manifests(files).where((F.col("kind") == "package.json") & (F.col("main") != ""))
            .select("repo_id", F.col("source").alias("manifest"),
                    paths.join_path(paths.dir_of("source"), "main").alias("path")))


def entry_points(files: DataFrame) -> DataFrame:
    """``(repo_id, rank, manifest, path)``; order by rank, manifest, path within a repository.

    ``rank`` is the position of the name among the known entry points; a package ``main`` comes
    after all of them, in the order of its manifest.
    """
    ranks = dimension(files.sparkSession,
                      [(name, i) for i, name in enumerate(catalogs.ENTRY_POINTS)], "name, rank")
    named = (files.select("repo_id", "path", F.lower(paths.basename("path")).alias("name"))
             .join(F.broadcast(ranks), "name")
             .select("repo_id", F.struct("rank", F.lit("").alias("manifest")).alias("key"), "path"))
    mains = package_mains(files).select(
        "repo_id",
        F.struct(F.lit(len(catalogs.ENTRY_POINTS)).alias("rank"), "manifest").alias("key"), "path")
    return (named.unionByName(mains).groupBy("repo_id", "path").agg(F.min("key").alias("key"))
            .select("repo_id", "key.rank", "key.manifest", "path"))


def pick_readme(files: DataFrame) -> DataFrame:
    """One README per repository: at the root if there is one, then by path."""
    candidate = F.struct(F.contains("path", F.lit("/")).alias("nested"), "path",
                         readme.readme_text("content").alias("raw"))
    return (with_file_class(files).where(F.col("file_class") == "readme")
            .groupBy("repo_id").agg(F.min(candidate).alias("pick"))
            .select("repo_id", "pick.path", "pick.raw"))


def readme_facts(files: DataFrame) -> DataFrame:
    """Path, title, description, excerpt and sections of the picked README."""
    return pick_readme(files).select(
        "repo_id", "path",
        readme.readme_title("raw").alias("title"),
        readme.readme_description("raw").alias("description"),
        readme.readme_excerpt("raw").alias("raw_excerpt"),
        readme.readme_sections("raw").alias("sections"))


def readme_sections(files: DataFrame) -> DataFrame:
    """``(repo_id, pos, heading, body)``."""
    return (readme_facts(files)
            .select("repo_id", F.posexplode("sections").alias("pos", "s"))
            .select("repo_id", "pos", "s.heading", "s.body"))
