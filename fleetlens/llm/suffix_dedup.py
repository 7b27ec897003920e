"""Suffix dedup: every byte covered by a string of ``threshold`` bytes that also starts anywhere else goes.

A depth-limited radix sort of all suffixes through their first ``threshold`` bytes (windows), by digit
passes from coarse to fine; a group of one leaves the sort after each pass, and the groups that are left
after the last are exactly the repeated windows. Digits are hashed stretches of a window, so a pass is
a distributed grouping and no text but that of open documents moves:

1. The first digit of a window is its anchor: of its grams of ``GRAM`` bytes the one with the lowest
   hash. Neighbouring windows share their anchor, so they travel as one run. Runs that are equal as a
   whole are settled here; a run whose anchor nobody else has leaves.
2. The windows of an open run are split by their distance to the anchor into blocks. The digit is the
   stretch that all windows of a block have in common. Equal blocks are settled, lone ones leave.
3. The last digit is the whole window.

Every pass folds equal rows before its shuffle, so a passage that many documents share is one row per
task. Hashes have 128 bits in every decision. Long texts are cut into segments that overlap by a window.

Defined results: a null text is empty; a text shorter than a window keeps all; strings are judged on the
input; a repeated row repeats all its windows; a null id is a document like others; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import append_columns, discard, land, slices

THRESHOLD = 400
GRAM = 64
#: Distances to the anchor that make one block of the second pass.
BLOCK = 32
#: Window starts of a segment.
SEGMENT = 1 << 20
_ONE = np.uint64(1)


class Powers:
    """Hashes of stretches: a polynomial over random byte values, modulo 2**64."""

    def __init__(self, base: int, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + _ONE
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.concatenate([[_ONE], np.full(n - 1, self.base)]), dtype=np.uint64)
                self.down = np.cumprod(np.concatenate([[_ONE], np.full(n - 1, self.inverse)]), dtype=np.uint64)

    def prefix(self, raw: np.ndarray) -> np.ndarray:
        self._grow(len(raw) + 1)
        out = np.empty(len(raw) + 1, np.uint64)
        out[0] = 0
        np.cumsum(self.values[raw] * self.up[:len(raw)], out=out[1:])
        return out

    def stretch(self, prefix: np.ndarray, start, stop) -> np.ndarray:
        return mix((prefix[stop] - prefix[start]) * self.down[start])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def powers() -> tuple[Powers, Powers]:
    return Powers(0x9FB21C651E98DF25, 11), Powers(0xC2B2AE3D27D4EB4F, 12)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours."""
    n = len(x) - width + 1
    pad = -len(x) % width
    blocks = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def runs_of(raw: np.ndarray, hashes: tuple[Powers, Powers], threshold: int = THRESHOLD, gram: int = GRAM):
    """``low, high, anchor``: first and last start of windows with the same anchor, and their digits.

    ``raw`` is one segment. Returns (low, high, anchor, hash of the anchor, hash of the run).
    """
    first, second = hashes
    prefix = first.prefix(raw)
    n = len(raw) - gram + 1
    places = np.arange(n)
    key = mix((prefix[gram:] - prefix[:n]) * first.down[:n])
    # The place in the low bits: of equal grams the first is the anchor.
    low_bits = np.uint64((1 << 21) - 1)
    packed = (key & ~low_bits) | places.astype(np.uint64)
    anchor = (_sliding_min(packed, threshold - gram + 1) & low_bits).astype(np.int64)
    edge = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    high = np.concatenate([edge[1:], [len(anchor)]]) - 1
    at = anchor[edge]
    other = second.prefix(raw)
    # A run is named by its bytes and by where its windows lie around the anchor.
    body = second.stretch(other, edge, high + threshold)
    shape = mix((at - edge).astype(np.uint64) * np.uint64(1 << 20) + (at - high).astype(np.uint64) + _ONE)
    return edge, high, at, key[at], mix(body + shape)


def segments(size: int, threshold: int):
    """(start, stop) of overlapping segments whose windows make up those of a text."""
    return [(at, min(size, at + SEGMENT + threshold - 1)) for at in range(0, size - threshold + 1, SEGMENT)]


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted disjoint spans of the same bytes; touching spans become one."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    fresh = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    at = np.flatnonzero(fresh)
    return np.stack([spans[at, 0], reach[np.concatenate([at[1:], [len(spans)]]) - 1]], axis=1)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


# ---- first pass: runs ------------------------------------------------------------------------------

_ROW = "doc long, print long"
_SPANS = "spans array<struct<start:long,end:long>>"


def _span_array(per_row: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(per_row) if per_row else np.empty((0, 2), np.int64)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in per_row])]).astype(np.int32)
    pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0], pa.int64()), pa.array(flat[:, 1], pa.int64())], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(offsets), pairs)


def _runs(docs: DataFrame, threshold: int) -> DataFrame:
    """Rows ``anchor, run, doc, print, low, high, at``, one per different run of a document, and rows ``spans``
    of what a document repeats of itself."""
    schema = f"{_ROW}, anchor long, run long, low long, high long, at long, {_SPANS}"
    names = ["doc", "print", "anchor", "run", "low", "high", "at", "spans"]

    def run(batches):
        hashes = powers()
        span_type = _span_array([]).type
        for batch in slices(batches):
            found, selves = [], []
            for doc, name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = np.frombuffer(text.as_buffer() or b"", np.uint8)
                parts = []
                for start, stop in segments(len(raw), threshold):
                    low, high, at, anchor, body = runs_of(raw[start:stop], hashes, threshold)
                    parts.append((low + start, high + start, at + start, anchor, body))
                if not parts:
                    continue
                low, high, at, anchor, body = (np.concatenate(c) for c in zip(*parts, strict=True))
                _, first, inverse, counts = np.unique(body, return_index=True, return_inverse=True, return_counts=True)
                own = counts[inverse] > 1
                if own.any():
                    selves.append((doc, name, merged(np.stack([low[own], high[own] + threshold], axis=1))))
                found.append((np.full(len(first), doc), np.full(len(first), name), anchor[first], body[first],
                              low[first], high[first], at[first]))
            if found:
                doc, name, anchor, body, low, high, at = (np.concatenate(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, pa.int64()), pa.array(name, pa.int64()), _signed(anchor), _signed(body), pa.array(low),
                     pa.array(high), pa.array(at), pa.nulls(len(doc), span_type)], names)
            if selves:
                k = len(selves)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s[0] for s in selves], pa.int64()), pa.array([s[1] for s in selves], pa.int64()),
                     *[pa.nulls(k, pa.int64())] * 5, _span_array([s[2] for s in selves])], names)

    return docs.mapInArrow(run, schema)


def _fold(rows: DataFrame, digit: str, whole: str, weight=None) -> DataFrame:
    """One row per (digit, whole): how often it occurs, and its first place."""
    return rows.groupBy(digit, whole).agg(
        F.sum(weight if weight is not None else F.lit(1)).alias("n"), F.min(F.struct("doc", "print", "low", "high", "at")).alias("place"))


def _open(folded: DataFrame, digit: str) -> DataFrame:
    """Rows of digits under which something differs and something occurs once: these go on sorting.

    What occurs more often is settled; one row of it stays as a partner for the others.
    """
    undecided = folded.groupBy(digit).agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where(
        "kinds > 1 and least = 1").select(digit)
    return folded.join(undecided, digit, "left_semi").select("place.*", "n")


def _by_document(rows: DataFrame) -> DataFrame:
    return rows.groupBy("doc", "print").agg(F.collect_set(F.struct("low", "high", "at", "n")).alias("runs"))


# ---- second and third pass: blocks and windows -------------------------------------------------------

def _pieces(raw: np.ndarray, runs: list[dict], hashes, threshold: int, block: int):
    """Rows (core, whole, low, high, at, n) of the blocks of some runs of a text."""
    out = []
    low, high, at, n = (np.array([r[k] for r in runs], np.int64) for k in ("low", "high", "at", "n"))
    for start, stop in segments(len(raw), threshold):
        mine = (low >= start) & (low < start + SEGMENT)
        if not mine.any():
            continue
        part = raw[start:stop]
        a, z, x, w = low[mine] - start, high[mine] - start, at[mine] - start, n[mine]
        near, far = (x - z) // block, (x - a) // block
        count = far - near + 1
        owner = np.repeat(np.arange(len(a)), count)
        step = near[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        first = np.maximum(a[owner], x[owner] - step * block - block + 1)
        last = np.minimum(z[owner], x[owner] - step * block)
        prefix, other = hashes[0].prefix(part), hashes[1].prefix(part)
        centre = x[owner] - step * block
        core = hashes[0].stretch(prefix, centre, centre - block + 1 + threshold)
        body = hashes[1].stretch(other, first, last + threshold)
        shape = mix(((x[owner] - first) * (1 << 20) + (x[owner] - last) + 1).astype(np.uint64))
        out.append((core, mix(body + shape), first + start, last + start, x[owner] + start, w[owner]))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else None


def _windows(raw: np.ndarray, runs: list[dict], hashes, threshold: int, block: int):
    """Rows (core, whole, low, high, at, n) of the single windows of some blocks of a text."""
    out = []
    low, high, at, n = (np.array([r[k] for r in runs], np.int64) for k in ("low", "high", "at", "n"))
    for start, stop in segments(len(raw), threshold):
        mine = (low >= start) & (low < start + SEGMENT)
        if not mine.any():
            continue
        part = raw[start:stop]
        a, z = low[mine] - start, high[mine] - start
        count = z - a + 1
        p = np.repeat(a, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        out.append((hashes[0].stretch(hashes[0].prefix(part), p, p + threshold),
                    hashes[1].stretch(hashes[1].prefix(part), p, p + threshold),
                    p + start, p + start, np.repeat(at[mine], count), np.repeat(n[mine], count)))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else None


def _refine(texts: DataFrame, cut, threshold: int, block: int) -> DataFrame:
    """Finer rows of ``texts(doc, print, text, runs)``."""
    schema = f"{_ROW}, digit long, whole long, low long, high long, at long, n long"

    def run(batches):
        hashes = powers()
        for batch in slices(batches, 256):
            for doc, name, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2),
                                             batch.column(3).to_pylist(), strict=True):
                raw = np.frombuffer(text.as_buffer() or b"", np.uint8)
                rows = cut(raw, runs, hashes, threshold, block)
                if rows is None:
                    continue
                digit, whole, *rest = rows
                k = len(digit)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, doc), pa.int64()), pa.array(np.full(k, name), pa.int64()), _signed(digit),
                     _signed(whole), *[pa.array(c, pa.int64()) for c in rest]],
                    ["doc", "print", "digit", "whole", "low", "high", "at", "n"])

    return texts.mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, threshold: int = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``doc, print, spans``: the repeated stretches of ``docs(doc, print, text)`` with binary texts."""
    spark = docs.sparkSession
    passed = land(_runs(docs, threshold))
    rows = passed.where("anchor is not null").drop("spans")
    selves = passed.where("spans is not null").select("doc", "print", "spans")
    # A document that repeats a run has it twice, whatever the others have.
    twice = passed.where("anchor is not null")
    folded = land(_fold(twice, "anchor", "run"))
    settled = [rows.join(folded.where("n > 1").select("anchor", "run"), ["anchor", "run"]).select("doc", "print", "low", "high")]

    texts = land(docs.join(_by_document(_open(folded, "anchor")), ["doc", "print"]))
    blocks = land(_refine(texts.select("doc", "print", "text", "runs"), _pieces, threshold, block))
    block_folds = land(_fold(blocks, "digit", "whole", F.col("n")))
    settled.append(blocks.join(block_folds.where("n > 1").select("digit", "whole"), ["digit", "whole"]).select(
        "doc", "print", "low", "high"))

    finer = texts.select("doc", "print", "text").join(_by_document(_open(block_folds, "digit")), ["doc", "print"])
    windows = land(_refine(finer.select("doc", "print", "text", "runs"), _windows, threshold, block))
    often = windows.groupBy("digit", "whole").agg(F.sum("n").alias("n")).where("n > 1").select("digit", "whole")
    settled.append(windows.join(often, ["digit", "whole"]).select("doc", "print", "low", "high"))

    spans = settled[0].union(settled[1]).union(settled[2]).select(
        "doc", "print", F.struct(F.col("low").alias("start"), (F.col("high") + threshold).alias("end")).alias("span")).union(
            selves.select("doc", "print", F.explode("spans").alias("span")))
    out = land(spans.groupBy("doc", "print").agg(F.collect_set("span").alias("spans")))
    discard(spark, passed, folded, texts, blocks, block_folds, windows)
    return out


ADDED = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
                      T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())])


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """``key, n_bytes, n_removed, n_spans, kept`` of every row of ``docs``; ``kept`` is what is left, as bytes."""
    least = -(1 << 63)
    own = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")).withColumns({
        "doc": F.coalesce(F.col(key).cast("long"), F.lit(least)), "print": F.xxhash64("text")})
    spans = repeated_spans(own.select("doc", "print", "text"), threshold)

    def compute(texts, found):
        rows = []
        for raw, s in zip(texts.to_pylist(), found.to_pylist(), strict=True):
            away = merged(np.array([(x["start"], x["end"]) for x in s or ()], np.int64).reshape(-1, 2))
            kept, at = [], 0
            for a, z in away.tolist():
                kept.append(raw[at:a])
                at = z
            kept.append(raw[at:])
            rows.append((len(raw), int((away[:, 1] - away[:, 0]).sum()), len(away), b"".join(kept)))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return [*[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.binary())]

    wide = own.join(spans, ["doc", "print"], "left").select(key, "text", "spans")
    return append_columns(wide, ["text", "spans"], ADDED, compute).select(key, "n_bytes", "n_removed", "n_spans", "kept")
