"""Request-log operators: metrics, fallback streaks, cache hits and budget.

Order matters in a log, yet no task may receive the log of a whole scope or key.  Time is cut
into blocks: windows run inside a block, one summary row per block is chained per scope or key,
and the carried value is joined back.  The chained table grows with the time span only.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetlens import catalogs
from fleetlens.sources.landing import land

HOUR, DAY = 3600, 86400
# Requests that one task puts in order.
BLOCK_ROWS = 100_000


def _block(micros: Column, seconds: int) -> Column:
    return F.floor(micros / F.lit(seconds * 1_000_000)).cast("long")


def _scoped(requests: DataFrame, scope: str | None) -> DataFrame:
    """Add ``_scope``: a column of the log, or one constant for all of it."""
    return requests.withColumn("_scope", F.col(scope) if scope else F.lit("all"))


# ---------------------------------------------------------------- metrics

def request_metrics(requests: DataFrame, *by: str) -> DataFrame:
    """Totals, counts per path, fallback rate and average latency; zero for an empty log."""
    counts = [F.count_if(F.col("path") == p).alias(f"n_{p}") for p in catalogs.REQUEST_PATHS]
    rows = requests.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), *counts, F.avg("latency_ms").alias("avg"))
    return rows.select(
        *by, "total", *[f"n_{p}" for p in catalogs.REQUEST_PATHS],
        F.coalesce(F.try_divide(F.col("n_fallback").cast("double"), "total"), F.lit(0.0))
        .alias("fallback_rate"),
        F.coalesce("avg", F.lit(0.0)).alias("avg_latency_ms"))


def paging(metrics: DataFrame, rate: float = catalogs.PAGE_RATE,
           min_requests: int = catalogs.PAGE_MIN_REQUESTS) -> DataFrame:
    """Metric rows that should page someone: nearly everything falls back."""
    return metrics.where((F.col("fallback_rate") > rate) & (F.col("total") > min_requests))


# ---------------------------------------------------------------- streaks

def _row_blocks(rows: DataFrame, block_rows: int, tick_micros: int) -> DataFrame:
    """Add ``_block``: consecutive requests of a scope, about ``block_rows`` of them however dense the log.

    Requests are counted per tick before the shuffle.  The counts are summed up within an hour and over
    the hours, so even one scope with all traffic is summed by many tasks.  A block may be larger by
    the requests of one tick.
    """
    micros = F.unix_micros("ts")
    rows = rows.withColumns({"_tick": F.floor(micros / tick_micros).cast("long"), "_hour": _block(micros, HOUR)})
    ticks = rows.groupBy("_scope", "_hour", "_tick").agg(F.count(F.lit(1)).alias("n"))
    hours = ticks.groupBy("_scope", "_hour").agg(F.sum("n").alias("n"))

    def before(*by, order):
        return F.coalesce(F.sum("n").over(
            Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    hours = hours.select("_scope", "_hour", before("_scope", order="_hour").alias("_earlier"))
    placed = ticks.withColumn("_within", before("_scope", "_hour", order="_tick")).join(hours, ["_scope", "_hour"])
    blocks = placed.select("_scope", "_tick", F.floor((F.col("_earlier") + F.col("_within")) / block_rows).alias("_block"))
    return rows.join(blocks, ["_scope", "_tick"]).drop("_tick", "_hour")


def fallback_streaks(requests: DataFrame, scope: str | None = None, block_rows: int = BLOCK_ROWS,
                     tick_micros: int = 1_000_000) -> DataFrame:
    """Add ``streak``: consecutive fallbacks so far.

    A model answer or a cache hit resets it, an error leaves it unchanged.
    """
    rows = _row_blocks(_scoped(requests, scope), block_rows, tick_micros)
    within = Window.partitionBy("_scope", "_block").orderBy("ts", "request_id") \
        .rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(
        "_island", F.sum(F.col("path").isin("llm", "cache_hit").cast("long")).over(within))
    island = Window.partitionBy("_scope", "_block", "_island").orderBy("ts", "request_id") \
        .rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_streak", F.sum((F.col("path") == "fallback").cast("long")).over(island))

    # The last island of a block is what it hands on; a block without a reset adds to it.
    chain = Window.partitionBy("_scope").orderBy("_block")
    blocks = rows.groupBy("_scope", "_block").agg(F.max(F.struct("_island", "_streak")).alias("last"))
    blocks = blocks.withColumn("_run", F.sum((F.col("last._island") > 0).cast("long")).over(
        chain.rowsBetween(Window.unboundedPreceding, 0)))
    handed = F.sum("last._streak").over(
        Window.partitionBy("_scope", "_run").orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, 0))
    carried = (blocks.withColumn("_out", handed)
               .select("_scope", "_block", F.coalesce(F.lag("_out").over(chain), F.lit(0))
                       .alias("_carry")))
    streak = F.col("_streak") + F.when(F.col("_island") == 0, F.col("_carry")).otherwise(0)
    return (rows.join(carried, ["_scope", "_block"]).withColumn("streak", streak)
            .drop("_scope", "_block", "_island", "_streak", "_carry"))


def fallback_alerts(requests: DataFrame, scope: str | None = None) -> DataFrame:
    """Requests recorded while the streak is at or over the threshold."""
    return fallback_streaks(requests, scope).where(
        F.col("streak") >= catalogs.FALLBACK_ALERT_THRESHOLD)


# ---------------------------------------------------------------- cache

# What a block does to the cache state: an entry whose expiry is below ``upto`` leaves the block
# with expiry ``leaves``; an expiry at or above every ``upto`` passes through unchanged.
_UNSEEN = np.iinfo(np.int64).min


def _jump_to_last(after: np.ndarray) -> np.ndarray:
    """Last index reached from each index by following ``after`` (its length marks the end)."""
    jump = np.where(after < len(after), after, np.arange(len(after)))
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            return jump
        jump = further


def _runs(upto: np.ndarray, leaves: np.ndarray):
    """One piece per run of equal results."""
    last = np.append(leaves[1:] != leaves[:-1], True)
    return upto[last], leaves[last]


def _follow(expiry, upto: np.ndarray, leaves: np.ndarray):
    at = np.searchsorted(upto, expiry, side="right")
    return np.where(at < len(upto), leaves[np.minimum(at, len(upto) - 1)], expiry)


def _compose(first, second, width: int):
    """What two consecutive blocks do together.

    An expiry that enters is below the first time of the first block plus ``width``, so a function holds no
    more pieces than there are times within one ``width``.
    """
    (upto, leaves), (u, l) = first, second
    start, end = np.searchsorted(u, upto[-1], side="right"), np.searchsorted(u, upto[0] + width, side="right") + 1
    return _runs(np.append(upto, u[start:end]), np.append(_follow(leaves, u, l), l[start:end]))


def _cuts(*columns: np.ndarray) -> np.ndarray:
    """Start of every run of equal rows, and the length."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.append(np.flatnonzero(new), len(new))


def _groups(batches: Iterator[pd.DataFrame], by: Sequence[str]) -> Iterator[dict[str, np.ndarray]]:
    """Groups of consecutive rows with equal ``by``; a group may span batches."""
    held = []

    def joined():
        frame = pd.concat(held) if len(held) > 1 else held[0]
        return {c: frame[c].to_numpy() for c in frame.columns}

    for batch in batches:
        if batch.empty:
            continue
        cuts = _cuts(*[batch[c].to_numpy() for c in by])
        for start, end in zip(cuts[:-1], cuts[1:]):
            part = batch.iloc[start:end]
            if held and any(held[-1][c].iloc[-1] != part[c].iloc[0] for c in by):
                yield joined()
                held = []
            held.append(part)
    if held:
        yield joined()


def _per_group(rows: DataFrame, by: Sequence[str], order: Sequence[str], schema: str, fn) -> DataFrame:
    """``fn(group) -> columns`` for every group of ``by``, its rows in ``order``.

    Groups are streamed through sorted partitions: most hold a handful of rows, for which a
    Python call with its own frame per group would cost far more than the work.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        out, size = [], 0
        for group in _groups(batches, by):
            columns = fn(group)
            out.append(columns)
            size += len(columns[-1])
            if size >= 50_000:
                yield frame(out)
                out, size = [], 0
        if out:
            yield frame(out)

    def frame(out):
        return pd.DataFrame({n: np.concatenate([np.broadcast_to(c[i], np.shape(c[-1])) for c in out])
                             for i, n in enumerate(names)})

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)


def _nodes(group):
    """``(node, upto, leaves)`` of each node of a group that is sorted by node and ``upto``."""
    cuts = _cuts(group["node"])
    for start, end in zip(cuts[:-1], cuts[1:]):
        yield int(group["node"][start]), group["upto"][start:end], group["leaves"][start:end]


def _entries(group):
    """The expiry with which each node of the group is entered."""
    nodes, entered, expiry = [], [], int(group["entry"][0])
    for node, upto, leaves in _nodes(group):
        nodes.append(node)
        entered.append(expiry)
        expiry = int(_follow(np.int64(expiry), upto, leaves))
    return group["key"][0], np.array(nodes, np.int64), np.array(entered, np.int64)


_PIECES, _STARTS = "key string, node long, upto long, leaves long", "key string, node long, entry long"


def _tree_entries(functions: DataFrame, nodes: int, fan: int, width: int) -> DataFrame:
    """``(key, node, entry)``: the expiry with which every node is entered, by a prefix over a tree of functions.

    Upwards ``fan`` neighbours are composed into their parent until one node a key is left; downwards each parent hands
    its entry to its children. No task meets more than ``fan`` functions of a key, and there are as many levels as the
    logarithm of the longest key's blocks.
    """
    def parent(df):
        return df.withColumn("parent", F.floor(F.col("node") / fan).cast("long"))

    def composed(group):
        whole = None
        for _, upto, leaves in _nodes(group):
            whole = (upto, leaves) if whole is None else _compose(whole, (upto, leaves), width)
        return group["key"][0], int(group["parent"][0]), *whole

    levels = []
    while nodes > 1:
        levels.append(land(functions))
        functions = _per_group(parent(levels[-1]), ["key", "parent"], ["node", "upto"], _PIECES, composed)
        nodes = -(-nodes // fan)
    entries = functions.select("key", "node").distinct().withColumn("entry", F.lit(_UNSEEN))
    for functions in reversed(levels):
        below = parent(functions).join(entries.withColumnRenamed("node", "parent"), ["key", "parent"])
        entries = _per_group(below, ["key", "parent"], ["node", "upto"], _STARTS, _entries)
    return entries


#: Blocks of one time slice; a slice of a key with more requests than a block may hold is cut.
_SLICE = 1 << 20


def _time_blocks(times: DataFrame, block_seconds: int, block_rows: int, tick_micros: int) -> DataFrame:
    """Add ``block``: slices of ``block_seconds``, of which those of a key with more than ``block_rows`` requests are cut.

    The requests of a dense slice are counted per tick, summed up and cut by count; only dense slices have such ticks.
    """
    times = times.withColumns({"slice": _block(F.col("us"), block_seconds), "tick": F.floor(F.col("us") / tick_micros).cast("long")})
    dense = times.groupBy("key", "slice").count().where(F.col("count") > block_rows).select("key", "slice")
    ticks = times.join(dense, ["key", "slice"], "left_semi").groupBy("key", "slice", "tick").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("key", "slice").orderBy("tick").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    parts = ticks.select("key", "slice", "tick", F.floor(before / block_rows).cast("long").alias("part"))
    return times.join(parts, ["key", "slice", "tick"], "left").withColumn(
        "block", F.col("slice") * _SLICE + F.coalesce("part", F.lit(0))).drop("slice", "tick", "part")


def ttl_misses(requests: DataFrame, keys: Sequence[str] = ("cache_key",),
               ttl: int = catalogs.CACHE_TTL_SECONDS,
               block_seconds: int = HOUR, span_seconds: int = DAY, block_rows: int = BLOCK_ROWS,
               tick_micros: int = 100_000) -> DataFrame:
    """``(keys…, us, request_id)``: the requests that miss an anchored cache.

    The first request of a key opens a window of ``ttl`` seconds; later ones inside it (the end
    included) are hits and do not extend it.  ``us`` is the time in microseconds.

    Most requests have no neighbour within the window and are settled by two comparisons.  Only
    the rest depend on what came before: their blocks, of ``block_seconds`` and at most about ``block_rows`` requests,
    are turned into functions from entry expiry to exit expiry, composed in a tree whose nodes have
    ``span_seconds / block_seconds`` children, and walked with the entry that results.
    """
    keys, width, fan = list(keys), ttl * 1_000_000, max(2, span_seconds // block_seconds)
    times = requests.select(F.to_json(F.struct(*keys)).alias("key"), F.unix_micros("ts").alias("us"),
                            "request_id") \
        .groupBy("key", "us").agg(F.min("request_id").alias("request_id"))
    times = _time_blocks(times, block_seconds, block_rows, tick_micros)

    in_block = Window.partitionBy("key", "block").orderBy("us")
    in_key = Window.partitionBy("key").orderBy("block")
    edges = times.groupBy("key", "block").agg(F.min("us").alias("lo"), F.max("us").alias("hi")) \
        .select("key", "block", (F.row_number().over(in_key) - 1).cast("long").alias("node"), F.lag("hi").over(in_key).alias("before"),
                F.lead("lo").over(in_key).alias("after"))
    placed = (times.withColumn("prev", F.lag("us").over(in_block))
              .withColumn("next", F.lead("us").over(in_block)).join(edges, ["key", "block"]))
    gap_before = F.col("us") - F.coalesce("prev", "before")
    gap_after = F.coalesce("next", "after") - F.col("us")
    alone = (F.coalesce(gap_before > width, F.lit(True)) & F.coalesce(gap_after > width, F.lit(True)))
    placed = land(placed.select("key", "node", "us", "request_id", alone.alias("alone")))
    lonely = placed.where("alone").select("key", "us", "request_id")
    crowded = placed.where(~F.col("alone")).drop("alone")
    last = crowded.agg(F.max("node")).first()[0]

    def block_function(group):
        us = group["us"]
        last = _jump_to_last(np.searchsorted(us, us + width, side="right"))
        # An entry expires inside the first ttl of the block, so later starts cannot be first.
        reachable = np.searchsorted(us, us[0] + width, side="left") + 1
        return group["key"][0], int(group["node"][0]), *_runs(us[:reachable], (us[last] + width)[:reachable])

    def walk(group):
        us = group["us"]
        after = np.searchsorted(us, us + width, side="right")
        at, misses = int(np.searchsorted(us, group["entry"][0], side="right")), []
        while at < len(us):
            misses.append(at)
            at = int(after[at])
        return group["key"][0], us[misses], group["request_id"][misses]

    if last:
        functions = _per_group(crowded, ["key", "node"], ["us"], _PIECES, block_function)
        started = crowded.join(_tree_entries(functions, last + 1, fan, width), ["key", "node"])
    else:
        started = crowded.withColumn("entry", F.lit(_UNSEEN))
    walked = _per_group(started, ["key", "node"], ["us"], "key string, us long, request_id long", walk)
    key_type = ", ".join(f"{k} {requests.schema[k].dataType.simpleString()}" for k in keys)
    return (lonely.unionByName(walked).withColumn("_key", F.from_json("key", key_type))
            .select("_key.*", "us", "request_id"))


def ttl_outcomes(requests: DataFrame, keys: Sequence[str] = ("cache_key",),
                 ttl: int = catalogs.CACHE_TTL_SECONDS) -> DataFrame:
    """Add ``outcome``: ``miss`` for the request that opens a cache window, else ``hit``."""
    keys = list(keys)
    misses = ttl_misses(requests, keys, ttl).withColumn("_miss", F.lit(True))
    marked = (requests.withColumn("us", F.unix_micros("ts"))
              .join(misses, [*keys, "us", "request_id"], "left"))
    return marked.withColumn(
        "outcome", F.when(F.col("_miss"), "miss").otherwise("hit")).drop("us", "_miss")


# ---------------------------------------------------------------- budget

def running_total(rows: DataFrame, amount: Column, order: Sequence[str], block: str,
                  scope: str, name: str) -> DataFrame:
    """Add ``name``: running sum per scope, computed block by block."""
    within = Window.partitionBy(scope, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(scope).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_amount", amount.cast("long"))
    carried = rows.groupBy(scope, block).agg(F.sum("_amount").alias("_total")) \
        .select(scope, block, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_carry"))
    return (rows.withColumn("_part", F.sum("_amount").over(within))
            .join(carried, [scope, block])
            .withColumn(name, F.col("_part") + F.col("_carry"))
            .drop("_amount", "_part", "_carry"))


def admit(requests: DataFrame, cap: int, scope: str | None = None,
          ttl: int = catalogs.CACHE_TTL_SECONDS, block_seconds: int = HOUR) -> DataFrame:
    """Add ``outcome`` and ``served``: ``llm``, ``cache_hit`` or ``fallback``.

    Hits are free.  The first ``cap`` misses of a scope reach the model; afterwards nothing new
    enters the cache, so a request is a hit only while an admitted answer lasts and falls back
    otherwise.  A cap of zero or less is unlimited.
    """
    keys = ["_scope", "cache_key"]
    rows = ttl_outcomes(_scoped(requests, scope), keys, ttl)
    miss = F.col("outcome") == "miss"
    if cap <= 0:
        return rows.withColumn("served", F.when(miss, "llm").otherwise("cache_hit")).drop("_scope")
    rows = rows.withColumn("_block", _block(F.unix_micros("ts"), block_seconds))
    rows = running_total(rows, miss.cast("int"), ["ts", "request_id"], "_block", "_scope", "_n")
    admitted = F.col("_n") <= cap
    last = rows.where(miss & admitted).groupBy(*keys).agg(F.max(F.unix_micros("ts")).alias("_last"))
    covered = F.unix_micros("ts") <= F.col("_last") + ttl * 1_000_000
    served = (F.when(miss & admitted, "llm")
              .when(~miss & (admitted | F.coalesce(covered, F.lit(False))), "cache_hit")
              .otherwise("fallback"))
    return (rows.join(last, keys, "left").withColumn("served", served)
            .drop("_scope", "_block", "_n", "_last"))


def unprocessed(keyed: DataFrame, done: DataFrame) -> DataFrame:
    """Records whose ``cache_key`` has no result yet, for incremental runs."""
    return keyed.join(done.select("cache_key").distinct(), "cache_key", "left_anti")
