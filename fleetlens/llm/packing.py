"""Lexical retrieval packing: related documents share a training window.

Texts are tokenised where they lie and dealt to shards of about ``shard_rows`` rows by a hash. A shard
holds a BM25 inverted index over its rows. A seed's best unused neighbours fill its window in order of
their score; what doesn't fit is cut and seeds the next window, so only a shard's last sequence needs
padding. Long documents are dealt in parts, so a shard's size doesn't follow the longest text.

Defined results: a null or empty text is the end token alone; documents without shared terms follow in
the order of their ids; repeated rows are packed as often as they occur; a null id is packed like any
other; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import array
import os
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import keep, slices, tidy

WINDOW = 4096
END = 2
SHARD_ROWS = 4096
#: Tokens of a document that go to a shard together.
PART_TOKENS = 1 << 16
#: Terms of a seed that make its query, and how many neighbours one query returns.
QUERY_TERMS = 24
NEIGHBOURS = 24
K1, B = 1.2, 0.75
#: Chunks of text whose ids a task remembers, and how long they may be.
CACHE_CHUNKS, CHUNK_CHARS = 250_000, 64

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class ChunkTokenizer:
    """Token ids as packed bytes. Texts are cut at blanks, which no token of the vocabulary crosses.

    Every chunk is encoded once and remembered. Where the tokenizer lower-cases, takes a run of letters
    whole and the marks after it apart (which is tried out first), chunks are cut there too, and runs of
    Latin letters go to its model directly.
    """

    #: Letters below this code point are their own normal form.
    LATIN_END = "\u0250"
    _MARKS = re.compile(rb"([a-z])([!-/:-@\[-`{-~]+)(?=[ \n]|$)")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.special = [str(t.content).encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters: dict[str, str] = {}
        self.plain = self._takes_letters_whole()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _takes_letters_whole(self) -> bool:
        t = self.tokenizer
        if t.pre_tokenizer is None or t.normalizer is None:
            return False
        cut = [p for p, _ in t.pre_tokenizer.pre_tokenize_str("abcxyz., def")]
        return (t.normalizer.normalize_str("ABC xyz") == "abc xyz" and cut[0] == "abcxyz" and "def" in cut
                and self._ids("Abcxyz. Abc%, b'") == [i for x in ("abcxyz", ".", "abc", "%,", "b", "'") for i in self._ids(x)]
                and self._ids("abcxyz") == [x.id for x in t.model.tokenize("abcxyz")])

    def _letter(self, char: str) -> str:
        """The characters that the model reads for a letter."""
        found = self.letters.get(char)
        if found is None:
            found = self.letters[char] = "".join(p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(char))
        return found

    def _cut(self, text: str | None) -> list[str]:
        if not text:
            return []
        if self.plain:
            raw = text.encode("utf-8", "surrogatepass")
            lower = raw.lower()  # for bytes: A-Z alone
            if not any(s in lower for s in self.special):
                text = self._MARKS.sub(rb"\1 \2", lower).decode("utf-8", "surrogatepass")
        return text.replace("\n", " ").split(" ")

    def _encode_fresh(self, fresh: list[str]) -> dict[str, bytes]:
        out, rest = {}, fresh
        if self.plain:
            rest, model, pack = [], self.tokenizer.model, self.pack
            for c in fresh:
                if c.isalpha() and max(c) < self.LATIN_END:
                    low = c if c.isascii() else c.lower()
                    if low.isascii():
                        out[c] = pack([x.id for x in model.tokenize(low)])
                        continue
                    if low.isalpha():
                        out[c] = pack([x.id for x in model.tokenize("".join(map(self._letter, low)))])
                        continue
                rest.append(c)
        for at in range(0, len(rest), 4096):
            part = rest[at:at + 4096]
            for c, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                out[c] = self.pack(e.ids)
        return out

    def pack(self, ids) -> bytes:
        packed = array.array("H" if self.dtype.itemsize == 2 else "I", ids)
        if sys.byteorder == "big":
            packed.byteswap()
        return packed.tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        cut = [self._cut(t) for t in texts]
        if len(self.known) > CACHE_CHUNKS:  # what is used again comes back from the older half
            self.known, self.older = {"": b""}, self.known
        known, older = self.known, self.older
        fresh = set().union(*cut) - known.keys()
        again = fresh & older.keys()
        known.update((c, older[c]) for c in again)
        known.update(self._encode_fresh(list(fresh - again)))
        out = [b"".join(map(known.__getitem__, chunks)) for chunks in cut]
        for c in fresh:
            if len(c) > CHUNK_CHARS:
                del known[c]
        return out


def _tokenize(docs: DataFrame, tokenizer: str, end: int, shards: int) -> DataFrame:
    """``shard, doc_id, start, doc_tokens, ids``: parts of documents, ids packed."""
    schema = "hash long, doc_id long, start long, doc_tokens long, ids binary"
    name = ("tokenizer", tokenizer)

    def run(batches):
        encoder = keep(name, lambda: ChunkTokenizer(tokenizer))
        width, last = encoder.dtype.itemsize, encoder.pack([end])
        for batch in slices(batches):
            rows = []
            for key, doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                     encoder.encode(batch.column(2).to_pylist()), strict=True):
                ids += last
                for at in range(0, len(ids), PART_TOKENS * width):
                    rows.append((key, doc, at // width, len(ids) // width, ids[at:at + PART_TOKENS * width]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [*[pa.int64()] * 4, pa.binary()], strict=True)],
                ["hash", "doc_id", "start", "doc_tokens", "ids"])

    return docs.mapInArrow(tidy(run, name), schema).select(
        F.pmod(F.xxhash64("hash", "start"), F.lit(shards)).alias("shard"), "doc_id", "start", "doc_tokens", "ids")


class ShardIndex:
    """BM25 postings of a shard's rows."""

    def __init__(self, rows: list[np.ndarray]):
        self.n = len(rows)
        sizes = np.array([len(r) for r in rows], np.int64)
        docs = np.repeat(np.arange(self.n), sizes)
        terms = np.concatenate(rows).astype(np.int64) if rows else np.empty(0, np.int64)
        keys, tf = np.unique(terms * max(self.n, 1) + docs, return_counts=True)
        self.doc, term = keys % max(self.n, 1), keys // max(self.n, 1)
        self.terms, self.first, df = np.unique(term, return_index=True, return_counts=True)
        self.stop = self.first + df
        idf = np.log1p((self.n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * sizes / max(1.0, sizes.mean() if self.n else 1.0))
        self.impact = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[self.doc])
        # The same postings by row: the terms of a query with their impact there.
        order = np.lexsort((-self.impact, self.doc))
        self.row_term = np.repeat(np.arange(len(self.terms)), df)[order]
        self.row_start = np.searchsorted(self.doc[order], np.arange(self.n + 1))

    def neighbours(self, row: int, used: np.ndarray, size: int = NEIGHBOURS, terms: int = QUERY_TERMS) -> np.ndarray:
        """The best unused rows for the strongest terms of a row, best first."""
        query = self.row_term[self.row_start[row]:min(self.row_start[row + 1], self.row_start[row] + terms)]
        if not len(query):
            return np.empty(0, np.int64)
        at = np.concatenate([np.arange(self.first[t], self.stop[t]) for t in query])
        scores = np.bincount(self.doc[at], self.impact[at], self.n)
        scores[used] = 0
        found = np.argpartition(-scores, min(size, self.n - 1))[:size]
        found = found[scores[found] > 0]
        return found[np.lexsort((found, -scores[found]))]


def fill_windows(rows: list[np.ndarray], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(row, start, length, sequence, offset) of pieces that fill windows with neighbours."""
    index, used = ShardIndex(rows), np.zeros(len(rows), bool)
    pieces, sequence, offset, next_seed = [], 0, 0, 0
    waiting: list[int] = []
    seed = None

    def place(row: int) -> bool:
        """Whether the row was cut, so that its rest opens a window."""
        nonlocal sequence, offset
        used[row] = True
        at, size, cut = 0, len(rows[row]), False
        while at < size:
            if offset == window:
                sequence, offset, cut = sequence + 1, 0, at > 0
            take = min(size - at, window - offset)
            pieces.append((row, at, take, sequence, offset))
            at, offset = at + take, offset + take
        return cut

    while True:
        row = next((r for r in waiting if not used[r]), None)
        if row is None:
            row = None
            if seed is not None:
                found = index.neighbours(seed, used)
                waiting = found.tolist()
                row = waiting[0] if waiting else None
            if row is None:
                while next_seed < len(rows) and used[next_seed]:
                    next_seed += 1
                if next_seed == len(rows):
                    return pieces
                row = seed = next_seed
                waiting = []
        before = sequence
        cut = place(row)
        if sequence != before or offset == window:  # a new window has a new seed
            seed, waiting = (row if cut else None), []


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW,
                   end: int = END, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Pieces ``doc_id, start, length, doc_tokens, sequence_id, offset, ids`` (little-endian, 32 bits each).

    ``tokenizer`` is the path of a tokenizer file that every executor has.
    """
    own = docs.select(F.xxhash64(F.col(key), F.col(text)).alias("hash"), F.col(key).cast("long").alias("doc_id"),
                      F.col(text).alias("text"))
    shards = max(1, -(-docs.select(key).count() // shard_rows))
    dtype = ChunkTokenizer(tokenizer).dtype.str

    def pack(keys, table):
        table = table.sort_by([("doc_id", "ascending"), ("doc_tokens", "ascending"), ("start", "ascending"), ("ids", "ascending")])
        doc, start, total = (table.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens"))
        rows = [np.frombuffer(b, dtype) for b in table.column("ids").to_pylist()]
        first = keys[0].as_py() << 32
        pieces = fill_windows(rows, window)
        columns = {
            "doc_id": [doc[p[0]] for p in pieces], "start": [start[p[0]] + p[1] for p in pieces],
            "length": [p[2] for p in pieces], "doc_tokens": [total[p[0]] for p in pieces],
            "sequence_id": [first + p[3] for p in pieces], "offset": [p[4] for p in pieces],
            "ids": [rows[p[0]][p[1]:p[1] + p[2]].astype("<u4").tobytes() for p in pieces]}
        return pa.table([pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in columns.items()], list(columns))

    return _tokenize(own, tokenizer, end, shards).groupBy("shard").applyInArrow(pack, PIECES)
