"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items.

Words are runs of digits, ASCII letters (A-Z read as a-z) and characters beyond ASCII. A window is
``window`` consecutive words of an item; an item of fewer words, but not none, is one window. Each
text is normalised and scanned once; a hit is mapped back to the characters of the original.

Defined results: a null or wordless text has no words, no hits and is clean; an item without words or
text has no window; repeated items and windows count once per ``item_id``; a null ``item_id`` is
ignored; repeated documents are judged row by row. Columns of the input named as the added ones are
replaced.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import append_columns

WINDOW = 13
#: A document is contaminated when this many times its hit words reach its words.
RATE = 20
#: Bytes of benchmark text in one automaton; a larger benchmark is scanned in several passes.
AUTOMATON_BYTES = 16 << 20

_DELIMITERS = [*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
_LOWER = bytearray(range(256))
for _c in _DELIMITERS:
    _LOWER[_c] = 0x20
for _c in range(0x41, 0x5B):
    _LOWER[_c] = _c + 32
#: Every byte to the same place: delimiters become blanks, A-Z become a-z.
NORMAL = bytes(_LOWER)

ADDED = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
    T.StructField("hit_spans", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
])


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(NORMAL).split() if text else []


def windows_of(text: str | None, window: int) -> set[bytes]:
    words = words_of(text)
    if not words:
        return set()
    return {b" ".join(words[i:i + window]) for i in range(max(1, len(words) - window + 1))}


def automaton_of(items: list[tuple[str, str]], window: int):
    """One automaton over all windows; its values are (words, items)."""
    owners: dict[bytes, set[str]] = {}
    for item, text in items:
        for w in windows_of(text, window):
            owners.setdefault(w, set()).add(item)
    machine = ahocorasick.Automaton()
    for w, ids in owners.items():
        machine.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, sorted(ids)))
    if owners:
        machine.make_automaton()
    return machine


def scan(machine, text: str | None):
    """(words, hit words, items, spans of characters) of one text."""
    if not text:
        return 0, 0, [], []
    flat = text.encode("utf-8", "surrogatepass").translate(NORMAL)
    words = flat.split()
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    hits = list(machine.iter(line)) if len(machine) and words else []
    if not hits:
        return len(words), 0, [], []
    blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    ends = np.searchsorted(blanks, [end for end, _ in hits])
    covered = np.zeros(len(words) + 1, np.int64)
    items: set[str] = set()
    for end, (_, (length, ids)) in zip(ends, hits, strict=True):
        covered[end - length] += 1
        covered[end] -= 1
        items.update(ids)
    hit = np.cumsum(covered[:-1]) > 0
    # Normalising keeps every byte in place, so word positions hold for the original text too.
    raw = np.frombuffer(flat, np.uint8)
    inside = np.concatenate([[False], raw != 32, [False]])
    starts, stops = (np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:]))
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    edges = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    spans = [{"start": int(chars[starts[a]]), "end": int(chars[stops[b - 1]])}
             for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True)]
    return len(words), int(hit.sum()), sorted(items), spans


def _merge(a: list[dict] | None, b: list[dict]) -> list[dict]:
    merged: list[dict] = []
    for s in sorted([*(a or []), *b], key=lambda s: (s["start"], s["end"])):
        if merged and s["start"] <= merged[-1]["end"]:
            merged[-1]["end"] = max(merged[-1]["end"], s["end"])
        else:
            merged.append(dict(s))
    return merged


def _inside(text: str, spans: list[dict]) -> int:
    return sum(len(words_of(text[s["start"]:s["end"]])) for s in spans)


def find_contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                       item_text: str = "text", window: int = WINDOW,
                       automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``hit_items`` and ``hit_spans`` (characters of ``text``).

    Nothing is shuffled. The benchmark's size is checked: every ``automaton_bytes`` of it make one
    automaton, and a document passes the automata one after another in the same stage.
    """
    items = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")).where(
        "item is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(size // automaton_bytes) + 1
    out = None
    for k in range(shards):
        own = items.where(F.pmod(F.xxhash64("item"), F.lit(shards)) == k) if shards > 1 else items
        sent = docs.sparkSession.sparkContext.broadcast([(r.item, r.text) for r in own.collect()])
        out = _pass(docs if out is None else out, sent, text, window, first=out is None)
    return out


def _pass(docs: DataFrame, sent, text: str, window: int, first: bool) -> DataFrame:
    built: list = []

    def compute(texts, *before):
        if not built:
            built.append(automaton_of(sent.value, window))
        rows = []
        for i, t in enumerate(texts.to_pylist()):
            n, n_hit, ids, spans = scan(built[0], t)
            if before:
                ids = sorted({*ids, *before[0][i].as_py()})
                old = before[1][i].as_py()
                if old:
                    spans = _merge(old, spans)
                    n_hit = _inside(t, spans)
            rows.append((n, n_hit, ids, spans))
        cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        return [pa.array(c, type=t) for c, t in zip(cols, _arrow_types(), strict=True)]

    return append_columns(docs, [text] if first else [text, "hit_items", "hit_spans"], ADDED, compute)


def _arrow_types():
    from pyspark.sql.pandas.types import to_arrow_schema

    return [f.type for f in to_arrow_schema(ADDED)]


def contaminated(rate: int = RATE):
    return (F.col("n_hit") > 0) & (F.lit(rate) * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, items: DataFrame, rate: int = RATE, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with the columns of ``docs``."""
    # The text travels through the scan; the report's names must not hide columns of the input.
    clash = {f.name.lower() for f in ADDED} & {c.lower() for c in docs.columns}
    renamed = docs.withColumnsRenamed({c: f"_own_{c}" for c in docs.columns if c.lower() in clash})
    kept = find_contamination(renamed, items, **options).where(~contaminated(rate))
    return kept.select(*[F.col(f"`_own_{c}`" if c.lower() in clash else f"`{c}`").alias(c) for c in docs.columns])
