import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import hard_negatives as H
from fleetlens.llm.queries import op13_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score string, row string"
LABEL = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"


def dot(a, b):
    return min(max(sum(x * y for x, y in zip(a, b)), -(1 << 63)), (1 << 63) - 1)


def brute(rows, n_positives=5, n_negatives=5):
    fit = []
    for vec_id, vec, label, *_ in rows:
        if label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        fit.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in vec]))

    def first(scored, n):
        return sorted(scored, key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:n]

    out = []
    for i, (anchor, label, q) in enumerate(fit):
        if anchor is None or anchor % 100:
            continue
        scores = [(dot(q, v), vec_id, own == label, j) for j, (vec_id, own, v) in enumerate(fit) if j != i]
        for p, positive, *_ in first([s for s in scores if s[2]], n_positives):
            inside = [s for s in scores if not s[2] and 80 * p <= 100 * s[0] <= 100 * p]
            out += [(anchor, positive, r, s[1], p, s[0]) for r, s in enumerate(first(inside, n_negatives), 1)]
    return sorted(out, key=str)


def vectors(rng, n, dims=24, spread=1.0, labels=4):
    centres = [[rng.gauss(0, spread) for _ in range(dims)] for _ in range(labels)]
    return [(i, [c + rng.gauss(0, 1) for c in centres[rng.randrange(labels)]], rng.randrange(labels), "s", "r") for i in range(n)]


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted((tuple(r) for r in H.mine(df, label=F.expr(LABEL), anchor=F.expr("vec_id % 100 = 0"), **options).collect()), key=str)


@pytest.mark.parametrize("spread, labels", [(1.0, 4), (0.2, 9)])
def test_against_brute_force(spark, spread, labels):
    rng = random.Random(labels)
    rows = vectors(rng, 700, spread=spread, labels=labels)
    rows += [(200, *rows[3][1:]), (200, *rows[3][1:]), (None, *rows[4][1:]), (None, *rows[4][1:]), (900, [], 1, "", ""), (901, [0.0] * 24, 1, "", ""),
             (1000, None, 1, "", ""), (1100, [1.0] * 23 + [None], 1, "", ""), (1200, [float("nan")] + [1.0] * 23, 1, "", ""),
             (1300, [float("inf")] + [1.0] * 23, 1, "", ""), (1400, rows[5][1], None, "", ""), (1500, rows[6][1][:7], 2, "", ""), (1600, [-1.0], 77, "", ""),
             (-700, rows[7][1], 3, "", "")]
    rows += [(2001 + i, rows[8][1], i % 3, "", "") for i in range(40)]  # ties
    expected = brute(rows)
    assert len(expected) > 50
    assert mined(spark, rows) == expected
    assert mined(spark, rows, anchor_bytes=500) == expected  # several passes


def test_scores_beyond_doubles(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.choice([6, 9, 30]) for _ in range(3)], i % 2, "", "") for i in range(0, 250, 5)]
    assert mined(spark, rows) == brute(rows)


def test_postings_miss_nothing():
    rng = np.random.default_rng(0)
    x = np.floor(rng.normal(0, 60, (500, 30)) / np.arange(1, 31))
    q = np.floor(rng.normal(0, 60, (9, 30)) / np.arange(1, 31))
    scores = q @ x.T
    for share in (-0.2, 0.0, 0.3, 0.8):
        floors = share * np.linalg.norm(q, axis=1) * 60
        got = sorted(zip(*[c.tolist() for c in H.pairs_above(q, H.suffix_norms(q), x, H.suffix_norms(x), floors)], strict=True))
        assert got == sorted((i, j, int(scores[i, j])) for i, j in zip(*np.nonzero(scores >= floors[:, None]), strict=True))


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = op13_hard_negatives(spark, sf)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_empty_and_nothing_to_ask(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 1, "", ""), (100, [1.0], 2, "", "")]) == []
