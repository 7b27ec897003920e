"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a task turns into Python objects at a time.
SLICE_ROWS = 512


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows, so that long texts stay few in memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: What a worker keeps for its next tasks, by name.
_KEPT: dict = {}


def keep(name: tuple, make: Callable):
    """``make()``, kept by the worker for its next tasks of the same operator; see :func:`tidy`."""
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


def _begin(names: tuple) -> None:
    for name in [n for n in _KEPT if n not in names]:
        del _KEPT[name]


def _end() -> None:
    """What is free goes back to the system: a worker lives on, and its allocators would hold the most that any task took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator], *names: tuple) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow``, in a worker that keeps ``names`` alone of what other operators kept, and no free memory."""
    def tidied(batches):
        _begin(names)
        yield from run(batches)
        _end()

    return tidied


def append_columns(df: DataFrame, inputs: list[str], added: T.StructType,
                   compute: Callable[..., list[pa.Array]], rows: int = SLICE_ROWS) -> DataFrame:
    """``df`` with the columns ``added``, which ``compute`` makes from the arrays of ``inputs``.

    A column of ``df`` with the name of an added one is replaced. Every other column passes as it is.
    """
    taken = {f.name.lower() for f in added}
    names = [c for c in df.columns if c.lower() not in taken]
    # Inputs travel under positions, so that an added name may equal that of an input.
    wide = df.select(*[F.col(f"`{c}`") for c in names],
                     *[F.col(f"`{c}`").alias(f"_in{i}") for i, c in enumerate(inputs)])
    kept = T.StructType([f for f in wide.schema if not f.name.startswith("_in")])
    schema = T.StructType([*kept.fields, *added.fields])
    width = len(kept.fields)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in slices(batches, rows):
            made = compute(*batch.columns[width:])
            arrays = [a if a.type == f.type else a.cast(f.type)
                      for a, f in zip([*batch.columns[:width], *made], arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return wide.mapInArrow(tidy(run), schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a session without one gets a local folder, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="fleetlens-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def land(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *landed: DataFrame) -> None:
    """Delete tables of :func:`land` that nothing reads any more."""
    for df in landed:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def most_frequent(counts: DataFrame, by: str, limit: int) -> DataFrame:
    """The rows of ``counts`` with the highest ``by``, at most ``limit``; rows of about equal counts stay together.

    A histogram of at most 1,024 steps gives the threshold, so only the rows that are wanted need reach the driver.
    """
    n = F.col(by)
    width = F.length(F.bin(n))
    shift = F.greatest(width - 4, F.lit(0))
    steps = counts.where(n > 0).groupBy(F.expr(f"shiftright({by}, greatest(length(bin({by})) - 4, 0))").alias("top"),
                                        shift.cast("int").alias("shift")).count().collect()
    threshold, held = None, 0
    for step in sorted(steps, key=lambda r: -(r.top << r.shift)):
        held += step["count"]
        if held > limit:
            break
        threshold = step.top << step.shift
    return counts.where(n >= threshold) if threshold is not None else counts.limit(0)


def spread_sample(rows: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """At most ``size`` rows, those with the lowest hash of ``key``; few more are ever sorted."""
    total = rows.count()
    space = 1 << 40
    share = min(space, int(space * (2 * size + 1000) / max(total, 1)) + 1)
    order = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(space))
    return rows.where(order < share).orderBy(order, *[F.col(c) for c in rows.columns]).limit(size)


def highest(counts: DataFrame, by: str, key: str, limit: int) -> DataFrame:
    """The ``limit`` rows of ``counts`` with the highest ``by``, of equal ones those with the lowest ``key``, a 64-bit hash.

    Exact: what :func:`most_frequent` leaves out is filled up from the counts right below it.
    """
    top = most_frequent(counts, by, limit)
    held, low = top.agg(F.count("*"), F.min(by)).first()
    below = counts.where(F.col(by) > 0) if low is None else counts.where((F.col(by) > 0) & (F.col(by) < low))
    # Counts repeat; the step that crosses the limit is wide only where counts are high and words few.
    for n, rows in below.groupBy(by).count().orderBy(F.desc(by)).limit(max(limit - held, 0)).collect():
        ties = counts.where(F.col(by) == n)
        if held + rows > limit:
            # Keys are spread evenly, so a range of them holds little more than is wanted; else it is widened.
            share = 2 * (limit - held) + 1000
            while True:
                bound = min((1 << 63) - 1, (1 << 64) * share // rows - (1 << 63))
                few = ties.where(F.col(key) <= F.lit(bound))
                if bound == (1 << 63) - 1 or few.count() >= limit - held:
                    break
                share *= 8
            return top.unionByName(few.orderBy(key).limit(limit - held))
        top, held = counts.where(F.col(by) >= n), held + rows
    return top
