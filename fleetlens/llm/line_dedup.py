"""Line dedup: fuzzy lines by MinHash, one line kept per component.

A line is compared by the shingles of ``shingle`` characters of its lower-cased text with single
blanks. A one-permutation MinHash fills ``bands * rows`` bins; lines that agree on all bins of a band
are candidates; their exact Jaccard similarity decides; components of the links follow from
distributed union-find. Of all occurrences in a component the one with the lowest (id, line number)
stays.

At a similarity of 0.8, a pair shares one of 12 bands of 5 rows with a probability of 0.991; above
0.85, of 0.999. Equal lines are folded before anything is compared.

With ``short_lines`` a line of fewer characters than a shingle is one shingle, so that it links with equal
lines; it needs no signature. Blank lines always stay.

Defined results: without ``short_lines`` a line of fewer characters than a shingle stays; a document
without lines stays as it is; a null id takes no part; rows that repeat an id and its text count as one document,
different texts of one id are documents of their own, in the order of a hash of the text; lines of any length are hashed
whole, in chunks; columns named as the added ones are replaced, all others pass; an empty table gives no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import append_columns, discard, land, slices, tidy
from fleetlens.llm.linking import beside, buckets, link_buckets, parity_bits

SHINGLE = 8
BANDS, ROWS = 12, 5
PERCENT = 80
#: Bits of the bitmap of a line's shingles.
BITS = 1024
#: Bins that an empty bin asks for a value, in a fixed order of its own.
PROBES = 400
_BASE = np.uint64(0x9FB21C651E98DF25)
#: Characters that are hashed at a time: so few that the arrays stay in a core's cache.
CHUNK_CHARS = 1 << 18


def normal(line: str) -> str:
    return " ".join(line.split()).lower()


def line_key(line: str) -> int:
    """A signed 64-bit name of a normalised line."""
    value = xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _hashes(codes: np.ndarray, shingle: int) -> np.ndarray:
    """A 64-bit hash of the ``shingle`` characters from each place on."""
    total, width = codes, 1
    # The sum of the characters times powers of the base, from the sums of half as many characters.
    for bit in bin(shingle)[3:]:
        total = total[:-width] + total[width:] * _power(width)
        width *= 2
        if bit == "1":
            total = total[:-1] + codes[width:] * _power(width)
            width += 1
    return _mix(total)


def _power(k: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), k, 1 << 64))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def shingle_set(line: str, shingle: int = SHINGLE) -> np.ndarray:
    return np.unique(_hashes(_codes(line), shingle))


@functools.cache
def _probes(bins: int) -> np.ndarray:
    """For each bin the bins it borrows from, in order; the same for every line."""
    with np.errstate(over="ignore"):
        grid = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(PROBES) + np.arange(PROBES, dtype=np.uint64)
        asked = (_mix(grid + np.uint64(1)) % np.uint64(bins)).astype(np.int64)
    # In the end every bin is asked, so a line with any shingle fills all bins.
    return np.concatenate([asked, (np.arange(bins)[:, None] + np.arange(bins)) % bins], axis=1)


def signatures(lines: list[str], shingle: int = SHINGLE, bins: int = BANDS * ROWS) -> np.ndarray:
    """One row of ``bins`` minima per line; every line has at least ``shingle`` characters."""
    out = np.empty((len(lines), bins), np.uint64)
    at = 0
    while at < len(lines):
        stop, size = at, 0
        while stop < len(lines) and (stop == at or size + len(lines[stop]) <= CHUNK_CHARS):
            size += len(lines[stop])
            stop += 1
        out[at:stop] = _minima(lines[at:stop], shingle, bins)
        at = stop
    return out


def _minima(lines: list[str], shingle: int, bins: int) -> np.ndarray:
    empty = np.uint64(1 << 63)
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    hashes = _hashes(_codes("".join(lines)), shingle)
    whole = np.ones(len(hashes), bool)  # not across the end of a line
    whole[np.cumsum(lengths)[:-1, None] - np.arange(1, shingle)] = False
    hashes = hashes[whole]
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    slot = (high - high // np.uint32(bins) * np.uint32(bins)).astype(np.int64)
    slot += np.repeat(np.arange(len(lines)) * bins, lengths - shingle + 1)
    out = np.full((len(lines), bins), empty, np.uint64)
    np.minimum.at(out.reshape(-1), slot, hashes & np.uint64(0xFFFFFFFF))
    probes = _probes(bins)
    row, bin_ = np.nonzero(out == empty)
    values = out.copy()
    for k in range(probes.shape[1]):
        if not len(row):
            break
        found = out[row, probes[bin_, k]]
        filled = found != empty
        values[row[filled], bin_[filled]] = found[filled]
        row, bin_ = row[~filled], bin_[~filled]
    return values


def band_keys(values: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per line and band."""
    out = np.empty((len(values), bands), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            key = np.full(len(values), b + 1, np.uint64)
            for r in range(rows):
                key = _mix(key * _BASE + values[:, b * rows + r])
            out[:, b] = key
    return out.view(np.int64)


def _lines(docs: DataFrame, shingle: int, short_lines: bool) -> DataFrame:
    """``key, bands`` of the distinct lines of a slice and ``key, id, row, line`` of every occurrence."""
    schema = "key long, id long, row long, line long, bands array<long>"
    arrow = pa.schema([*[(c, pa.int64()) for c in ("key", "id", "row", "line")], ("bands", pa.list_(pa.int64()))])

    def run(batches):
        for batch in slices(batches):
            keys, ids, rows, places, fresh = [], [], [], [], {}
            for doc, text, row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if doc is None or not text:
                    continue
                for i, raw in enumerate(text.split("\n")):
                    line = normal(raw)
                    if len(line) >= shingle or (short_lines and line):
                        key = line_key(line)
                        if len(line) >= shingle:
                            fresh[key] = line
                        keys.append(key)
                        ids.append(doc)
                        rows.append(row)
                        places.append(i)
            none = pa.nulls(len(keys), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int64()) for c in (keys, ids, rows, places)], none], schema=arrow)
            if fresh:
                bands = band_keys(signatures(list(fresh.values()), shingle))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(fresh) + 1) * bands.shape[1], pa.int32()),
                                                pa.array(bands.reshape(-1), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(fresh), pa.int64()), *[pa.nulls(len(fresh), pa.int64())] * 3, flat], schema=arrow)

    return docs.mapInArrow(tidy(run), schema)


def _bodies(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """``node, body``: the normalised line of each of ``nodes``."""
    def run(batches):
        seen: set[int] = set()
        for batch in slices(batches):
            found = {}
            for text in batch.column(1).to_pylist():
                for raw in text.split("\n") if text else ():
                    line = normal(raw)
                    if len(line) >= shingle:
                        key = line_key(line)
                        if key not in seen:
                            found[key] = line
            if len(seen) > 1_000_000:  # repeated lines are folded below in any case
                seen.clear()
            seen.update(found)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.string())],
                                             ["node", "body"])

    lines = docs.where(F.col("id").isNotNull()).mapInArrow(tidy(run), "node long, body string")
    return lines.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("body").alias("body"))


def _sketches(bodies: DataFrame, shingle: int) -> DataFrame:
    """``node, n, bits``: size and bitmap of the shingles of every line."""
    def run(batches):
        for batch in slices(batches):
            sets = [shingle_set(body, shingle) for body in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array([parity_bits(x, BITS) for x in sets], pa.binary())],
                ["node", "n", "bits"])

    return bodies.mapInArrow(tidy(run), "node long, n long, bits binary")


def _verify(pairs: DataFrame, bodies: DataFrame, shingle: int, percent: int) -> DataFrame:
    def run(batches):
        group, own = None, None
        for batch in slices(batches):
            a_out, b_out = [], []
            for a, part, node, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = shingle_set(body, shingle)
                if (a, part) != group:
                    group, own = (a, part), None
                if node is None:
                    own = found
                elif own is not None:
                    both = len(np.intersect1d(own, found, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(found) - both):
                        a_out.append(a)
                        b_out.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    return beside(pairs, bodies).mapInArrow(tidy(run), "a long, b long")


def line_components(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    percent: int = PERCENT, short_lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """``key, id, row, line`` of every occurrence, and ``node, comp`` of the lines that link with another."""
    own = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("row"))
    lines = land(_lines(own, shingle, short_lines))
    banded = lines.where("bands is not null").groupBy(F.col("key").alias("node")).agg(F.first("bands").alias("bands"))
    found = land(buckets(banded.select(F.explode("bands").alias("token"), "node")))
    bodies = land(_bodies(own, found.select("node").distinct(), shingle))
    members = land(found.join(_sketches(bodies, shingle), "node").select("token", "node", "n", F.col("n").alias("left"), "bits"))
    labels = link_buckets(members, lambda pairs: _verify(pairs, bodies, shingle, percent), percent)
    discard(docs.sparkSession, found, bodies, members)
    return lines.where("bands is null").select("key", "id", "row", "line"), labels


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``id, row, lines``: the numbers of the lines to remove from each document that loses any."""
    occurrences, labels = line_components(docs, key, text, **options)
    placed = occurrences.join(labels.withColumnRenamed("node", "key"), "key", "left").select(
        F.coalesce("comp", "key").alias("comp"), "id", "row", "line")
    first = placed.groupBy("comp").agg(F.min(F.struct("id", "row", "line")).alias("first"), F.count("*").alias("n")).where(
        "n > 1").select("comp", "first")
    rest = placed.join(first, "comp").where(F.struct("id", "row", "line") != F.col("first"))
    return rest.groupBy("id", "row").agg(F.sort_array(F.collect_set("line")).alias("lines"))


ADDED = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()),
                      T.StructField("kept_text", T.StringType())])


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with ``n_lines, n_removed`` and ``kept_text``; lines stay as they were written."""
    removed = removed_lines(docs, key, text, **options).select(F.col("id").alias("_id"), F.col("row").alias("_row"), F.col("lines").alias("_gone"))
    wide = docs.join(removed, (F.col(key).cast("long") == F.col("_id")) & (F.xxhash64(text) == F.col("_row")), "left").drop("_id", "_row")

    def compute(texts, gone):
        counts, lost, kept = [], [], []
        for t, g in zip(texts.to_pylist(), gone.to_pylist(), strict=True):
            lines = t.split("\n") if t else []
            away = set(g or ())
            counts.append(sum(1 for x in lines if x.strip()))
            lost.append(len(away))
            kept.append("\n".join(x for i, x in enumerate(lines) if i not in away) if away else t)
        return [pa.array(counts, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string())]

    return append_columns(wide, [text, "_gone"], ADDED, compute).drop("_gone")
