"""File tables: scan, pruning, directories and landing."""

import os
from collections.abc import Iterator
from fnmatch import fnmatchcase
from functools import reduce
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetlens import catalogs
from fleetlens.functions import paths
from fleetlens.functions.text import computed
from fleetlens.sources.landing import land

# Only these classes ever need their content.
WITH_CONTENT = ("manifest", "readme")
# Rows for directories in which the walk stopped.
DIRECTORY = "directory"


# Children of a directory that a task passes on at a time.
_CHUNK = 10_000
# Directories that one task lists in a round, and tasks of a round at most.
_DIRS_A_TASK, _TASKS = 64, 10_000
_FRONTIER = "base string, repo_id string, path string"
_FOUND = f"{_FRONTIER}, is_dir boolean, size long"


def read_files(spark: SparkSession, roots: str | list[str], all_bodies: bool = False, prune: bool = False) -> DataFrame:
    """``files(repo_id, path, content, size)`` from ``<root>/<repo_id>/<path>``, whatever the names.

    The walk goes level by level: every directory of a level is a row, a round lists them all in parallel, and what it finds is
    landed, so a deep or lopsided tree spreads over the tasks and a lost executor costs one round. The driver sees
    the roots and a count per round, no name. Links to directories are not followed. With ``prune`` the walk doesn't enter ignored
    and dot directories; each that it meets is a row whose path ends in ``/``, which :func:`visible` reads as the place where
    the walk stopped. A root may hold ``*`` and ``?``. ``content`` is read for manifests and READMEs, or for every
    file where ``all_bodies`` is set; a broken sequence in it becomes U+FFFD, a file that vanished or a dead link has none.
    """
    bases = [(base, None, "") for root in ([roots] if isinstance(roots, str) else roots) for base in _expand(root)]
    frontier = spark.createDataFrame(bases, _FRONTIER)
    waiting, levels = len(bases), []
    while waiting:
        tasks = max(1, min(-(-waiting // _DIRS_A_TASK) if waiting > spark.sparkContext.defaultParallelism * _DIRS_A_TASK
                           else min(waiting, spark.sparkContext.defaultParallelism), _TASKS))
        found = land(frontier.repartition(tasks).mapInPandas(_list_directories, _FOUND))
        if prune:
            name = F.concat(F.lit("/"), "path", F.lit("/"))
            stops = F.col("is_dir") & (F.col("path") != "") & name.rlike(paths.IGNORED_ANCESTOR)
            found = found.select("base", "repo_id", F.when(stops, F.concat("path", F.lit("/"))).otherwise(F.col("path")).alias("path"),
                                 (F.col("is_dir") & ~stops).alias("is_dir"), "size")
        levels.append(found.where("not is_dir"))
        frontier = found.where("is_dir").select("base", "repo_id", "path")
        waiting = frontier.count()
    listed = reduce(DataFrame.unionByName, levels) if levels else spark.createDataFrame([], _FOUND)
    classed = with_file_class(listed.drop("is_dir"))
    wanted = F.lit(True) if all_bodies else F.col("file_class").isin(*WITH_CONTENT)
    wanted = wanted & ~F.endswith("path", F.lit("/"))
    bodies = classed.withColumn("wanted", wanted).select("base", "repo_id", "path", "size", "wanted").mapInPandas(
        _bodies, "repo_id string, path string, raw binary, size long")
    return bodies.select("repo_id", "path", F.make_valid_utf8(F.col("raw").cast("string")).alias("content"), "size")


def _store(location: str):
    """The file system of a location, and the path in it."""
    from pyarrow import fs

    if "://" in location and not location.startswith("file:"):
        return fs.FileSystem.from_uri(location)
    path = location.removeprefix("file:").lstrip("/")
    return fs.LocalFileSystem(), "/" + path


def _children(location: str) -> Iterator[tuple[str, bool, int]]:
    """(name, is a directory, size) of what a directory holds, hidden names too, one by one.

    A local link to a directory is left out; a link to a file counts as that file.
    """
    from pyarrow import fs

    store, path = _store(location)
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(path) as entries:
            for e in entries:
                if e.is_dir():
                    if not e.is_symlink():
                        yield e.name, True, 0
                else:
                    try:
                        yield e.name, False, e.stat().st_size
                    except FileNotFoundError:  # a dead link
                        yield e.name, False, 0
        return
    for i in store.get_file_info(fs.FileSelector(path)):
        yield i.base_name, i.type == fs.FileType.Directory, i.size or 0


def _expand(root: str) -> list[str]:
    """The directories that a root with ``*`` or ``?`` stands for."""
    parts = root.rstrip("/").split("/")
    at = next((i for i, p in enumerate(parts) if "*" in p or "?" in p), None)
    if at is None:
        return [root.rstrip("/")]
    base = "/".join(parts[:at])
    return [found for name, is_dir, _ in sorted(_children(base)) if is_dir and fnmatchcase(name, parts[at])
            for found in _expand("/".join([base, name, *parts[at + 1:]]))]


def _list_directories(frames):
    """The children of every directory; those of a base are repositories, and files beside them belong to none."""
    names = ["base", "repo_id", "path", "is_dir", "size"]
    for frame in frames:
        for base, repo, path in frame[["base", "repo_id", "path"]].itertuples(index=False):
            top = repo is None
            children = _children(base if top else f"{base}/{repo}/{path}".rstrip("/"))
            while chunk := list(islice(children, _CHUNK)):
                rows = [(base, name, "", True, 0) for name, is_dir, _ in chunk if is_dir] if top else [
                    (base, repo, f"{path}/{name}".lstrip("/"), is_dir, size) for name, is_dir, size in chunk]
                if rows:
                    yield pd.DataFrame(rows, columns=names)


def _bodies(frames):
    for frame in frames:
        for at in range(0, len(frame), 64):
            part = frame.iloc[at:at + 64]
            raw = []
            for base, repo, path, wanted in zip(part["base"], part["repo_id"], part["path"], part["wanted"], strict=True):
                raw.append(_body(f"{base}/{repo}/{path}") if wanted else None)
            yield pd.DataFrame({"repo_id": part["repo_id"], "path": part["path"], "raw": raw, "size": part["size"]})


def _body(location: str) -> bytes | None:
    store, place = _store(location)
    try:
        with store.open_input_stream(place) as stream:
            return stream.read()
    except FileNotFoundError:
        return None


def prune_ignored(files: DataFrame) -> DataFrame:
    """Drop files below an ignored or dot directory; dot-files stay."""
    return files.where(~F.col("path").rlike(paths.IGNORED_ANCESTOR))


def visible(files: DataFrame) -> DataFrame:
    """Files as a walk meets them: it doesn't enter ignored or dot directories.

    A file below one becomes a row for the directory in which the walk stopped, with a path that ends in
    ``/`` (empty at the root), no content and the class ``directory``. So a directory that holds nothing
    else is still known.
    """
    if "file_class" in files.columns:
        return files
    # One pass: as a union of files and directories, everything below would be read and derived twice.
    hidden = F.col("path").rlike(paths.BELOW_IGNORED)
    classed = with_file_class(files.where(F.col("path").isNotNull()))
    stopped = {"path": F.regexp_extract("path", paths.VISIBLE_PREFIX, 0), "name": F.lit(""), "file_class": F.lit(DIRECTORY)}
    return classed.select(*[
        F.col(c) if c == "repo_id" else F.when(hidden, stopped.get(c, F.lit(None))).otherwise(F.col(c)).alias(c)
        for c in classed.columns])


def is_file():
    return F.col("file_class") != DIRECTORY


def with_file_class(files: DataFrame) -> DataFrame:
    """Add ``name`` (lower-cased base name) and ``file_class``.

    A table landed by :func:`land_files` already has both.
    """
    if "file_class" in files.columns:
        return files
    files = files.withColumn("name", F.lower(paths.basename("path")))
    return files.withColumn(
        "file_class",
        F.when(F.col("name").isin(*catalogs.MANIFESTS), "manifest")
        .when(F.startswith("name", F.lit("readme")), "readme")
        .otherwise("other"))


def land_files(files: DataFrame, path: str) -> None:
    """Write the visible files partitioned by class, and the directories where the walk stopped.

    Manifest and README readers then open only their own small partitions and the passes over
    paths never read a file body.
    """
    landed = visible(files)
    body = F.when(F.col("file_class").isin(*WITH_CONTENT), F.col("content"))
    landed = landed.withColumn("content", body)
    (landed.where(is_file()).unionByName(landed.where(~is_file()).distinct())
     .write.mode("overwrite").partitionBy("file_class").parquet(path))


def dirs_of(files: DataFrame) -> DataFrame:
    """``dirs(repo_id, path)``: every visible directory at any depth, even if all in it is ignored."""
    # Few directories hold many files: reduce to distinct parents before expanding prefixes.
    parents = (computed(files.select("repo_id", "path"), dir=paths.dir_of("path"))
               .where(F.col("dir") != "").select("repo_id", "dir").distinct())
    depth = F.length("dir") - F.length(F.replace(F.col("dir"), F.lit("/"))) + 1
    return (parents.select("repo_id", "dir", F.explode(F.sequence(F.lit(1), depth)).alias("n"))
            .select("repo_id", F.call_function("substring_index", "dir", F.lit("/"), "n").alias("path")).distinct())
