import re
from collections import Counter

import numpy as np

from fleetlens.llm import quality_rules as Q
from tests.llm.helpers import corpus, docs_of

LABELS = "doc_id long, quality int, toxic int"


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if wins[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit))


def test_statistics(spark):
    texts = corpus() + [(800, "a b a b a b\n\na b a b a b\n # | <x> "), (801, "a b c\x1ca b c a b c"), (802, "\n\n\n")]
    for _, t in texts:
        assert Q.statistics_of(t)[:5] == brute(t)
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (1, 0, 0), (2, None, None), (None, 1, 0), (9999, 1, 1)], LABELS)
    rows = Q.judge_documents(docs_of(spark, texts + [(3, texts[3][1]), (None, "x")]), labels).collect()
    assert len(rows) == len(texts) + 2
    own = dict(texts)
    for r in rows:
        n = brute(own[r.doc_id] if r.doc_id is not None else "x")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == n
        assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (r.kept and r.base_failed) and 0 < r.anomaly < 1


def test_repeated_words_of_many_different_words():
    words = [str(i).encode() for i in range(3000)] * 2
    assert Q.repeated_words(words) == 6000 and Q.repeated_words(words[:3005]) == 10


def test_forest_isolates_outliers_and_threshold_keeps_the_good(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *(int(x) // (10 if n == "n_repeat_words" else 1) for x, n in zip(
        rng.integers(90, 110, len(Q.STATISTICS)), Q.STATISTICS, strict=True))) for i in range(600)]
    rows += [(600 + i, 100, 100, 5000, 0, 0, 1, 400, 400, 900, 2, 90) for i in range(6)]
    stats = spark.createDataFrame(rows, "doc_id long, " + ", ".join(f"{n} long" for n in Q.STATISTICS))
    scored = Q.score_statistics(stats, Q.fit_forest(stats, "doc_id")).cache()
    anomaly = {r.doc_id: r.anomaly for r in scored.collect()}
    assert min(anomaly[600 + i] for i in range(6)) > np.quantile([anomaly[i] for i in range(600)], 0.99)
    labels = spark.createDataFrame([(i, int(i < 600), 0) for i in range(0, 606, 2)], LABELS)
    limit = Q.calibrate(scored, labels, "doc_id", max_loss=0.02)
    assert sum(anomaly[i] >= limit for i in range(0, 600, 2)) <= 6 and all(anomaly[600 + i] >= limit for i in range(6))


def test_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], LABELS)
    rows = Q.judge_documents(docs_of(spark, corpus()), labels).collect()
    assert all(r.kept == (not r.base_failed) for r in rows)
    assert Q.judge_documents(docs_of(spark, [(1, "x")]).limit(0), labels).count() == 0
