import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fleetlens.llm import packing as P
from tests.llm.helpers import corpus, docs_of, sentence

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_chunks_give_the_tokenizers_ids(tokenizer):
    texts = [t for _, t in corpus()] + [
        "it's I'LL’s  a\tb\r\nc d <|endoftext|> x<|endoftext|>y <|startoftext|>", "é ́x Å", "1234 56!?", "x" * 300,
        " \n ", "ΣΑΣ ΣΑΣ.", "\x1c\x1da b"]
    encoder = P.ChunkTokenizer(PATH)
    for t, packed in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(packed, encoder.dtype).tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids


def check(pieces, texts, tokenizer, window):
    ids = sorted((-1 if i is None else i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (2,)) for i, t in texts)
    parts = {}
    for r in pieces:
        parts.setdefault((-1 if r.doc_id is None else r.doc_id, r.doc_tokens), {}).setdefault(r.start, []).append(r)
    got = []
    for (doc, total), by_start in parts.items():
        copies = len(by_start[0])
        for _ in range(copies):
            at, out = 0, []
            while at < total:
                r = by_start[at].pop()
                out += np.frombuffer(r.ids, "<u4").tolist()
                at += r.length
            assert at == total == len(out)
            got.append((doc, tuple(out)))
        assert not any(by_start.values())
    assert sorted(got) == ids
    sequences = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0) and r.length > 0
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) <= window
    return sequences


def test_pieces_make_up_every_document(spark, tokenizer):
    texts = corpus(seed=1)
    texts += [(None, "no id"), (700, " ".join("a" for _ in range(P.PART_TOKENS + 10)))]
    for rows, window in ((P.SHARD_ROWS, 4096), (10, 64)):
        pieces = P.pack_documents(docs_of(spark, texts), PATH, shard_rows=rows, window=window).collect()
        sequences = check(pieces, texts, tokenizer, window)
        shards = {s >> 32 for s in sequences}
        assert sum(size < window for size in sequences.values()) <= len(shards)  # a shard pads its last alone


def test_empty_tables(spark):
    assert P.pack_documents(docs_of(spark, [(1, "x")]).limit(0), PATH).count() == 0
    (r,) = P.pack_documents(docs_of(spark, [(1, None)]), PATH).collect()
    assert (r.length, r.doc_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (1, 1, [2])


def bm25(rows, seed):
    n, mean = len(rows), np.mean([len(r) for r in rows])
    df = {}
    for r in rows:
        for t in set(r.tolist()):
            df[t] = df.get(t, 0) + 1

    def weight(t, r):
        tf = r.tolist().count(t)
        return np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (P.K1 + 1) / (tf + P.K1 * (1 - P.B + P.B * len(r) / mean))

    query = sorted(set(rows[seed].tolist()), key=lambda t: -weight(t, rows[seed]))
    return query, lambda terms: [sum(weight(t, r) for t in terms) for r in rows]


def test_neighbours_are_the_best_by_bm25():
    rng = np.random.default_rng(4)
    rows = [rng.integers(0, 60, rng.integers(5, 40)) for _ in range(50)]
    index, used = P.ShardIndex(rows), np.zeros(50, bool)
    used[[3, 9]] = True
    query, score = bm25(rows, 3)
    scores = np.array(score(query))
    scores[used] = 0
    found = index.neighbours(3, used, size=8, terms=1000)
    assert np.allclose(sorted(scores)[::-1][:8], scores[found]) and not used[found].any()


def test_related_documents_share_windows():
    rng = random.Random(2)
    topics = [[sentence(rng, 1) for _ in range(40)] for _ in range(6)]
    codes = {w: i for i, w in enumerate(sorted({w for t in topics for w in t}))}
    rows = [np.array([codes[rng.choice(topics[i % 6])] for _ in range(30)]) for i in range(120)]
    pieces = P.fill_windows(rows, 300)
    together = {}
    for row, _, _, sequence, _ in pieces:
        together.setdefault(sequence, []).append(row % 6)
    same = sum(max(map(t.count, set(t))) for t in together.values()) / len(pieces)
    assert same > 0.75  # chance would be near 0.3
