import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetlens.llm import suffix_dedup as S
from tests.llm.helpers import corpus, docs_of


def brute(texts, width):
    from collections import Counter

    raw = [(t or "").encode() for _, t in texts]
    seen = Counter(b[i:i + width] for b in raw for i in range(len(b) - width + 1))
    out = []
    for (i, _), b in zip(texts, raw, strict=True):
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if seen[b[k:k + width]] > 1:
                gone[k:k + width] = b"\1" * width
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((-1 if i is None else i, len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return sorted(out)


def check(spark, texts, threshold=S.THRESHOLD):
    rows = S.remove_repeats(docs_of(spark, texts), threshold=threshold).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows) == brute(
        texts, threshold)


def test_against_brute_force(spark):
    rng = random.Random(8)
    texts = corpus(seed=3)
    passage = "".join(rng.choice("abcde ÄÖ") for _ in range(700))
    for i in range(25):  # a passage of many documents at many places, of lengths around the threshold
        cut = rng.choice([390, 399, 400, 401, 430, 700])
        at = rng.randint(0, 300)
        texts.append((200 + i, "".join(rng.choice("xyz") for _ in range(rng.randint(0, 900))) + passage[at:at + cut] + str(i)))
    texts += [(None, texts[0][1]), (5, texts[5][1]), (600, "ab" * 700), (601, "q" * 400), (602, "q" * 399), (603, "r" * 401)]
    check(spark, texts)


def test_long_text_across_segments(spark):
    rng = np.random.default_rng(2)
    long = "".join(map(chr, rng.integers(97, 123, S.SEGMENT + 5000)))
    near = long[S.SEGMENT - 300:S.SEGMENT + 300]
    rows = {r.doc_id: r for r in S.remove_repeats(docs_of(spark, [(1, long), (2, "#" + near + "#"), (3, long[:450])])).collect()}
    assert (rows[1].n_removed, rows[1].n_spans, rows[2].n_removed, rows[3].n_removed) == (1050, 2, 600, 450)
    assert rows[2].kept == b"##"


def test_empty_tables(spark):
    assert S.remove_repeats(docs_of(spark, [(1, "x")]).limit(0)).count() == 0
    check(spark, [(1, None), (2, ""), (3, "ab")])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=30, max_size=200), st.integers(20, 40))
def test_runs_cover_all_windows_with_their_first_lowest_gram(bits, width):
    raw, hashes = np.array(bits, np.uint8), S.powers()
    if len(raw) < width:
        return
    low, high, at, key, _ = S.runs_of(raw, hashes, width, gram=8)
    assert low[0] == 0 and high[-1] == len(raw) - width and (low[1:] == high[:-1] + 1).all()
    for a, z, x in zip(low, high, at, strict=True):
        assert z <= x <= a + width - 8
    same = {}
    for a, z, x, k in zip(low, high, at, key, strict=True):
        for p in range(a, z + 1):  # equal windows have equal anchors at equal distances
            assert same.setdefault(raw[p:p + width].tobytes(), (x - p, k)) == (x - p, k)
