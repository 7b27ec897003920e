"""From buckets of possible partners to connected components, without large groups or all their pairs."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import discard, land, tidy

#: Partners of one node that one group compares; a node with more is split over several.
GROUP_ROWS = 256


def components(edges: DataFrame) -> DataFrame:
    """``node, comp`` for every node of ``edges(a, b)``: the smallest node that links reach.

    Each round hooks every node onto its smallest neighbour, follows the hooks to their ends, and contracts
    the links to what is left; a hub's links are folded to one row per task before they are shuffled. In
    every third round a hash that is new each time decides which neighbour is smallest: that halves what is
    left, as expected, whatever the order of the ids is. So rounds, and the jumps in each, are logarithmic.
    """
    spark = edges.sparkSession
    live = land(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels, done = None, 0
    while True:
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        jumped = _by_hash(both, done) if done % 3 == 2 else _ends(land(both.groupBy(F.col("a").alias("node")).agg(
            F.min("b").alias("low")).select("node", F.least("node", "low").alias("up"))))
        ends = jumped.select(F.col("node").alias("a"), F.col("up").alias("a_up"))
        others = jumped.select(F.col("node").alias("b"), F.col("up").alias("b_up"))
        rest = land(live.join(ends, "a").join(others, "b").where("a_up <> b_up").select(
            F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct())
        fresh = jumped if labels is None else labels.join(
            jumped.select(F.col("node").alias("comp"), "up"), "comp", "left").select(
                "node", F.coalesce("up", "comp").alias("up"))
        previous, labels = labels, land(fresh.select("node", F.col("up").alias("comp")))
        discard(spark, live, jumped, *([previous] if previous is not None else []))
        live, done = rest, done + 1
        if live.isEmpty():
            return labels


def _ends(hooks: DataFrame) -> DataFrame:
    """``node, up`` with the end of each node's hooks; the landed ``hooks(node, up)`` go."""
    while True:
        above = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jumped = land(hooks.join(above, "up").select("node", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")))
        discard(hooks.sparkSession, hooks)
        hooks = jumped.select("node", "up")
        if jumped.where("moved").isEmpty():
            return hooks


def _by_hash(both: DataFrame, salt: int) -> DataFrame:
    """``node, up``: groups by the ends of hooks onto the neighbour of the lowest hash, named by their smallest node."""
    def ranked(name: str):
        return F.struct(F.xxhash64(name, F.lit(salt)).alias("rank"), F.col(name).alias("up"))

    hooks = both.groupBy(F.col("a").alias("node")).agg(F.min(ranked("b")).alias("low"))
    ended = _ends(land(hooks.select("node", F.least(ranked("node"), "low")["up"].alias("up"))))
    named = land(ended.join(ended.groupBy("up").agg(F.min("node").alias("low")), "up").select("node", F.col("low").alias("up")))
    discard(both.sparkSession, ended)
    return named


def beside(pairs: DataFrame, bodies: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The bodies of ``pairs(a, b)`` side by side in streams: ``a, part, node, body``.

    Within a partition, the rows of a group (a, part) follow one another: first those with ``node`` null,
    the bodies of ``a``, then each partner ``b`` with its body. A node with many partners is split into
    parts, each with its own copy of the body of ``a``, so that no group grows with the data.
    """
    pairs = land(pairs)  # read four times below
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(group_rows)).alias("parts"))
    placed = pairs.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    own = placed.select("a", "part").distinct().join(
        bodies.withColumnRenamed("node", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("node"), "body")
    partners = placed.join(bodies.withColumnRenamed("node", "b"), "b").select(
        "a", "part", F.col("b").alias("node"), "body")
    return own.unionByName(partners).repartition("a", "part").sortWithinPartitions(
        "a", "part", F.col("node").asc_nulls_first())


def buckets(rows: DataFrame) -> DataFrame:
    """The rows of ``rows(token, ...)``, longs all, whose token stands in two rows or more.

    The rows of a token follow one another in a sorted partition; a stream over them holds no group.
    """
    names = rows.columns
    ordered = rows.repartition("token").sortWithinPartitions("token", *[c for c in names if c != "token"])

    def run(batches):
        held, twin = None, False  # the last row so far, and whether the one before it has its token
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = {c: batch.column(c).to_numpy() for c in names}
            if held is not None:
                columns = {c: np.concatenate([held[c], v]) for c, v in columns.items()}
            token = columns["token"]
            after = token[1:] == token[:-1]
            keep = np.concatenate([[twin], after[:-1]]) | after if len(after) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(columns[c][:-1][keep]) for c in names], names)
            twin = bool(after[-1]) if len(after) else twin
            held = {c: v[-1:] for c, v in columns.items()}
        if twin:
            yield pa.RecordBatch.from_arrays([pa.array(held[c]) for c in names], names)

    return ordered.mapInArrow(tidy(run), rows.schema)


#: Rows of a bucket that one task compares at a time; a larger bucket is cut into blocks of about this size.
BLOCK = 2048
#: Rounds in which every block names a forest of its candidates, before all that are left are named.
FORESTS = 2


def parity_bits(tokens: np.ndarray, bits: int) -> bytes:
    """A bitmap in which every token of a set of 64-bit hashes flips a bit.

    Two sets differ in at least as many tokens as their bitmaps differ in bits.
    """
    slots = ((tokens >> np.uint64(24)) % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(slots, minlength=bits) & 1).astype(np.uint8)).tobytes()


def link_buckets(members: DataFrame, confirm: Callable[[DataFrame], DataFrame], percent: int, block: int = BLOCK) -> DataFrame:
    """``node, comp``: components of the confirmed pairs of the landed ``members(token, node, n, left, bits)``.

    Rows of one token may link. ``n`` is the size of a node's set, ``left`` the number of its tokens from this
    one on, in the order of all tokens; ``bits`` are :func:`parity_bits`. Sizes, ``left`` and bits bound the
    intersection from above, so a pair that they rule out cannot link. Tasks hold a block of a bucket and
    name a forest of the pairs that are left: a bounded number per row. Once these are confirmed or not,
    blocks name what is still apart, and at last every such pair of a bucket is compared, blocks against blocks;
    no link is missed, and a bucket of copies never becomes pairs. No pair is confirmed twice.
    """
    spark = members.sparkSession
    columns = ["token", "node", "n", "left", "bits"]
    live, labels, tested, links, spent = members.withColumn("comp", F.col("node")), None, [], [], []
    for k in range(FORESTS + 1):
        last = k == FORESTS
        pairs = _compare(_blocks(live, block, k, last), percent, not last, k).select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tested:
            pairs = pairs.join(reduce(DataFrame.union, tested), ["a", "b"], "left_anti")
        tested.append(land(pairs))
        links.append(land(confirm(tested[-1])))
        if labels is None or not links[-1].isEmpty():
            spent += [] if labels is None else [labels]
            labels = components(reduce(DataFrame.union, links))
        if not last:
            live = land(_unsettled(live.select(*columns), labels))
            spent.append(live)
            if live.isEmpty():
                break
    discard(spark, *tested, *links, *spent)
    return labels


def _unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``members`` with ``comp``, of the buckets that the links so far leave in several components."""
    placed = members.join(labels, "node", "left").select(*members.columns, F.coalesce("comp", "node").alias("comp"))
    tokens = placed.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("token")
    return placed.join(tokens, "token", "left_semi")


def _blocks(live: DataFrame, block: int, salt: int, crossed: bool) -> DataFrame:
    """``live`` with the number of its block, ``part``; ``crossed``: once per pair of blocks of its bucket."""
    large = live.groupBy("token").count().where(F.col("count") > block).select(
        "token", F.ceil(F.col("count") / F.lit(block)).alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    own = live.join(large, "token", "left").withColumn("own", F.pmod(F.xxhash64("node", "bits", F.lit(salt)), parts))
    if crossed:
        own = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).withColumn(
            "part", F.least("own", "other") * parts + F.greatest("own", "other"))
    else:
        own = own.withColumn("part", F.col("own"))
    return own.select("token", "part", "n", "node", "left", "comp", "bits").repartition("token", "part").sortWithinPartitions(
        "token", "part", "n", "node")


def _compare(blocks: DataFrame, percent: int, forest: bool, turn: int) -> DataFrame:
    """``a, b``: pairs of a block that may link and are in different components, or a forest of them."""
    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            token, part = held.column("token").to_numpy(), held.column("part").to_numpy()
            cuts = np.flatnonzero((token[1:] != token[:-1]) | (part[1:] != part[:-1])) + 1
            if len(cuts):  # the last group may go on in the next batch
                yield _pairs(held.slice(0, cuts[-1]), np.concatenate([[0], cuts]), percent, forest, turn)
                held = held.slice(cuts[-1])
        if held is not None:
            yield _pairs(held, np.array([0, held.num_rows]), percent, forest, turn)

    return blocks.mapInArrow(tidy(run), "a long, b long")


def _pairs(rows: pa.Table, edges: np.ndarray, percent: int, forest: bool, turn: int) -> pa.RecordBatch:
    """The pairs of the groups between ``edges``; the rows of a group are in the order of their sizes."""
    node, n, left, comp = (rows.column(c).to_numpy() for c in ("node", "n", "left", "comp"))
    bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint64).reshape(len(node), -1)

    def slack(x, y):
        """What the bitmaps leave of the tokens that may differ, below zero if no link is possible; and these tokens."""
        total = n[x] + n[y]
        need = -(-percent * total // (100 + percent))
        ok = (comp[x] != comp[y]) & (100 * n[x] >= percent * n[y]) & (np.minimum(left[x], left[y]) >= need)
        x, y = np.broadcast_arrays(x, y)
        near = np.flatnonzero(ok)
        apart = np.bitwise_count(bits[x[near]] ^ bits[y[near]]).sum(axis=1, dtype=np.int64)
        spare = np.full(len(ok), -1, np.int64)
        spare[near] = (total - 2 * need)[near] - apart
        return spare, total - 2 * need

    size = np.diff(edges)
    firsts = np.repeat(edges[:-1], size)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    # All groups at once: every row with the first of its group.
    spare, whole = slack(firsts, np.arange(len(node)))
    star = spare >= 0
    if forest:  # a narrow pair may fail and must not hide a better one
        star &= (2 * spare >= whole) | (np.repeat(size, size) == 2)
    a.append(node[firsts[star]])
    b.append(node[star])
    apart = ~star & (comp != comp[firsts])
    open_ = np.add.reduceat(apart, edges[:-1]) > 0 if forest else size > 2
    for g in np.flatnonzero(open_ & (size > 2)):
        lo, hi = edges[g], edges[g + 1]
        root = comp[lo:hi].copy()  # components, as the candidates join them
        if forest:
            root[np.isin(root, root[star[lo:hi]])] = root[0]
        for y in range(lo + 1, hi):
            low = lo if forest else lo + 1
            start = low + int(np.searchsorted(100 * n[low:y], percent * n[y]))
            x = np.arange(start, y)
            if forest:
                x = x[root[x - lo] != root[y - lo]]
            if not len(x):
                continue
            spare, _ = slack(x, np.full(len(x), y))
            x, spare = x[spare >= 0], spare[spare >= 0]
            if forest and len(x):
                # Of every component the likeliest partners: one in the first round, four times as many in each later one.
                x = x[np.lexsort((-spare, root[x - lo]))]
                roots, at, count = np.unique(root[x - lo], return_index=True, return_counts=True)
                x = x[np.arange(len(x)) - np.repeat(at, count) < 4 ** turn]
                root[np.isin(root, roots)] = root[y - lo]
            a.append(node[x])
            b.append(np.full(len(x), node[y]))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
