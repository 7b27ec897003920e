"""N-gram Jaccard join: prefix filters under several global token orders, then exact verification.

A document's set are its distinct shingles of ``width`` words (A-Z read as a-z, split at ASCII white
space); fewer words make one shingle of all. Two documents link when ``100 * intersection >= 80 *
union``. A set can only link with another that shares a token among its first ``n - ceil(0.8 n) + 1``
under any global order, so partners are sought under one order and kept only if they also share a
prefix token under each of the others. All orders put the frequent tokens last; how frequent tokens
are is counted over all documents, and the table of the most frequent ones is bounded. It decides only
the order, never which pairs are found.

Documents with equal sets are one class, represented by its smallest id. Members of a prefix token's
bucket are compared where they lie, by sizes, by the token's places in both and by bitmaps of their sets, which
bound the intersection; the pairs left go through the other orders to the verification. No link between different
sets is lost, and no group of copies is expanded into pairs.

Defined results: a document without words or text has an empty set and links with nothing; a null id
has no component; rows that repeat an id count as one document with the links of all of them; an empty
table gives no rows; other columns are ignored; texts of any length are read whole; equal counts are ordered by a hash.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import append_columns, discard, land, most_frequent, slices, tidy
from fleetlens.llm.linking import beside, buckets, link_buckets, parity_bits

WIDTH = 5
#: Links need this percentage of the union.
PERCENT = 80
#: Tokens that the orders put last, at most; only the order of tokens depends on this.
FREQUENT = 1_000_000
#: A token is counted as frequent where it stands in this many different sets of a task's slice.
LOCALLY = 2
SLICE = 16_384
#: Words that are hashed at a time, about.
HASHED_WORDS = 1 << 16
#: Bits of a set's bitmap; fewer let more pairs through to the verification.
BITS = 1024
#: Multipliers that set the orders apart.
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_FACTORS = np.array([0x9FB21C651E98DF25, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3,
                     0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x2D358DCCAA6C78A5], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values."""
    ordered = np.sort(values)
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(ordered) else ordered


def _shingles(ids: np.ndarray, size: int) -> np.ndarray:
    n = len(ids) - size + 1
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total = _mix(total + ids[k:k + n] * _FACTORS[k % len(_FACTORS)])
    return total


def shingle_sets(texts: Iterable[str | None], width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of every text as 64-bit hashes; the words of several texts are hashed at once."""
    held, size = [], 0
    for text in texts:
        held.append(text.encode("utf-8", "surrogatepass").lower().split() if text else [])
        size += len(held[-1])
        if size >= HASHED_WORDS:
            yield from _sets(held, width)
            held, size = [], 0
    yield from _sets(held, width)


def _sets(words: list[list[bytes]], width: int) -> Iterator[np.ndarray]:
    ends = np.cumsum([0, *map(len, words)]).tolist()
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, itertools.chain.from_iterable(words)), np.uint64, ends[-1])
    whole = _shingles(ids, width) if len(ids) >= width else ids[:0]
    for at, end in itertools.pairwise(ends):
        if 0 < end - at < width:
            yield _shingles(ids[at:end], end - at)
        else:  # those that begin in this text and end in it
            yield distinct(whole[at:max(at, end - width + 1)])


def prefix_size(n: int, percent: int) -> int:
    return n - (n * percent + 99) // 100 + 1


def linked(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)) or not len(x):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


# ---- one pass over the texts: classes of equal sets, and which tokens are frequent ----------------

def _survey(docs: DataFrame, width: int) -> DataFrame:
    """Rows ``id, print, n`` of documents, and rows ``token, n`` of tokens frequent in a slice."""
    schema = "id long, print binary, token long, n long"

    def run(batches):
        for batch in slices(batches, SLICE):
            prints, sizes, tokens, seen = [], [], [np.empty(0, np.uint64)], set()
            for found in shingle_sets((t.as_py() for t in batch.column(1)), width):
                sizes.append(len(found))
                prints.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                if prints[-1] not in seen:  # copies are one set
                    seen.add(prints[-1])
                    tokens.append(found)
            rows = pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints, pa.binary()), pa.nulls(batch.num_rows, pa.int64()),
                 pa.array(sizes, pa.int64())], ["id", "print", "token", "n"])
            yield rows
            values, counts = np.unique(np.concatenate(tokens), return_counts=True)
            often = counts >= LOCALLY
            k = int(often.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(values[often].view(np.int64)),
                 pa.array(counts[often], pa.int64())], ["id", "print", "token", "n"])

    return docs.mapInArrow(tidy(run), schema)


# ---- prefixes ------------------------------------------------------------------------------------

def _ranked(found: np.ndarray, ranks: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The infrequent tokens, the frequent ones, and the ranks of these."""
    tokens, rank = ranks
    at = np.searchsorted(tokens, found)
    known = (at < len(tokens)) & (tokens[np.minimum(at, len(tokens) - 1)] == found) if len(tokens) else np.zeros(len(found), bool)
    return found[~known], found[known], rank[at[known]]


def _ordered(rare: np.ndarray, late: np.ndarray, rank: np.ndarray, factor: int, size: int) -> np.ndarray:
    """The first ``size`` tokens in order: the infrequent ones by a hash, then the frequent ones, rarest first."""
    key = _mix(rare * np.uint64(factor))
    if len(rare) >= size:
        few = np.argpartition(key, size - 1)[:size]
        return rare[few[np.argsort(key[few])]]
    # Tokens of one rank are ordered by the hash, so that each order differs among them too.
    order = np.lexsort((_mix(late * np.uint64(factor)), rank))
    return np.concatenate([rare[np.argsort(key)], late[order[:size - len(rare)]]])


def _prefixes(docs: DataFrame, frequent, width: int, percent: int) -> DataFrame:
    """``node, n, prefix, bits`` and the prefixes under the other orders, packed."""
    schema = "node long, n long, prefix array<long>, others array<binary>, bits binary"

    def run(batches):
        ranks = frequent.value
        for batch in slices(batches):
            nodes, sizes, firsts, others, bits = [], [], [], [], []
            for node, found in zip(batch.column(0).to_pylist(), shingle_sets((t.as_py() for t in batch.column(1)), width), strict=True):
                if not len(found):
                    continue
                size = prefix_size(len(found), percent)
                nodes.append(node)
                sizes.append(len(found))
                ranked = _ranked(found, ranks)
                firsts.append(_ordered(*ranked, ORDERS[0], size).view(np.int64))
                others.append([np.sort((_ordered(*ranked, f, size) >> np.uint64(32)).astype(np.uint32)).tobytes()
                               for f in ORDERS[1:]])
                bits.append(parity_bits(found, BITS))
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(firsts, pa.list_(pa.int64())),
                 pa.array(others, pa.list_(pa.binary())), pa.array(bits, pa.binary())],
                ["node", "n", "prefix", "others", "bits"])

    return docs.mapInArrow(tidy(run), schema)


# ---- comparing ------------------------------------------------------------------------------------

def _share_prefixes(pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The pairs (a, b) that share a prefix token under every other order too."""
    packed = prefixes.select("node", F.col("others"))
    wide = pairs.join(packed.select(F.col("node").alias("a"), F.col("others").alias("x")), "a").join(
        packed.select(F.col("node").alias("b"), F.col("others").alias("y")), "b")

    def compute(xs, ys):
        out = []
        for x, y in zip(xs.to_pylist(), ys.to_pylist(), strict=True):
            out.append(all(len(np.intersect1d(np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32)))
                           for p, q in zip(x, y, strict=True)))
        return [pa.array(out, pa.bool_())]

    return append_columns(wide, ["x", "y"], T.StructType([T.StructField("shared", T.BooleanType())]), compute).where(
        "shared").select("a", "b").distinct()


def _verify(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    def run(batches):
        group, own = None, []
        for batch in slices(batches):
            a_out, b_out = [], []
            *keys, bodies = (c.to_pylist() for c in batch.columns)
            for a, part, node, found in zip(*keys, shingle_sets(bodies, width), strict=True):
                if (a, part) != group:
                    group, own = (a, part), []
                if node is None:
                    own.append(found)
                elif any(linked(x, found, percent) for x in own):
                    a_out.append(a)
                    b_out.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    return beside(pairs, texts).mapInArrow(tidy(run), "a long, b long")


def link_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH,
                   percent: int = PERCENT, frequent: int = FREQUENT) -> DataFrame:
    """``id, n_shingles, rep, component_id`` per row of ``docs``."""
    spark = docs.sparkSession
    texts = docs.select(F.col(key).cast("long").alias("node"), F.col(text).alias("body"))
    survey = land(_survey(texts, width))
    rows = survey.where("token is null").select("id", "print", "n")
    reps = rows.where("print is not null and id is not null").groupBy("print").agg(F.min("id").alias("rep"))
    counted = land(survey.where("token is not null").groupBy("token").agg(F.sum("n").alias("n")))
    # At most ``frequent`` tokens with a coarse rank.
    heavy = most_frequent(counted, "n", frequent).selectExpr("token", "cast(length(bin(n)) as tinyint) as level").toArrow()
    tokens = heavy.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    ranks = (tokens[order], heavy.column("level").to_numpy()[order])
    nodes = texts.join(reps.select(F.col("rep").alias("node")).distinct(), "node", "left_semi")
    prefixes = land(_prefixes(nodes, spark.sparkContext.broadcast(ranks), width, percent))
    found = buckets(prefixes.select(F.posexplode("prefix").alias("place", "token"), "node", "n").select(
        "token", "node", "n", (F.col("n") - F.col("place")).alias("left")))
    # Texts of one id and one size meet each other's bitmaps too: more candidates, none fewer.
    members = land(found.join(prefixes.select("node", "n", "bits"), ["node", "n"]).select("token", "node", "n", "left", "bits"))
    labels = link_buckets(
        members, lambda pairs: _verify(_share_prefixes(pairs, prefixes), texts, width, percent), percent)
    ends = labels.select(F.col("node").alias("rep"), "comp")
    out = rows.join(reps, "print", "left").join(ends, "rep", "left").select(
        "id", F.col("n").alias("n_shingles"), "rep",
        F.when(F.col("id").isNotNull(), F.coalesce("comp", "rep", "id")).alias("component_id"))
    discard(spark, members, prefixes, counted)
    return out
