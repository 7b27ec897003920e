"""Quality rules: an isolation forest over the statistics of classic text rules.

One pass over the texts makes the statistics, which are landed as a narrow table. The forest's trees
are grown on a bounded sample of all rows (``trees * leaf_sample`` rows, those with the lowest hash of
their id), every row is scored by its mean path length over the random splits, and the verdict's
threshold is calibrated on all labelled rows: the lowest score that loses at most ``max_loss`` of the
rows labelled good.

Words are runs without ASCII white space. Defined results: a null text has no words and fails the
base rules; empty tables give no rows; without labelled good rows nothing but the base rules rejects;
repeated ids are judged row by row, and contradicting labels of an id count as good.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import append_columns, land, spread_sample

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
#: Per cent of words in repeated windows beyond which a text fails.
MAX_REPEAT = 50
REPEAT_WINDOW = 3

TREES = 100
LEAF_SAMPLE = 256
#: Share of the rows labelled good that the calibrated threshold may lose.
MAX_LOSS = 0.005
#: Scores lie between 0 and 1; the threshold is one of so many steps.
STEPS = 4096

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper",
              "n_digits", "n_marks", "n_distinct", "longest_word")
ADDED = T.StructType([T.StructField(n, T.LongType()) for n in STATISTICS])

_UPPER = bytes(range(0x41, 0x5B))
_DIGITS = bytes(range(0x30, 0x3A))
_MARKS = b".,;:!?"
_BLANKS = b" \t\n\x0b\x0c\r"


def _count(raw: bytes, chars: bytes) -> int:
    return len(raw) - len(raw.translate(None, chars))


def repeated_words(words: list[bytes], width: int = REPEAT_WINDOW) -> int:
    """Words inside a window of ``width`` words that the text has twice or more."""
    if len(words) <= width:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    n, code = len(ids) - width + 1, ids[:len(ids) - width + 1]
    for k in range(1, width):
        if int(code.max()) + 1 > (1 << 62) // len(seen):
            code = np.unique(code, return_inverse=True)[1]
        code = code * len(seen) + ids[k:k + n]
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(width):
        covered[k:k + n] |= twice
    return int(covered.sum())


def statistics_of(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * len(STATISTICS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # for bytes: ASCII white space alone
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (len(words), len(text) - _count(raw, _BLANKS), _count(raw, SYMBOLS), len(lines) - len(set(lines)),
            repeated_words(words), len(lines), _count(raw, _UPPER), _count(raw, _DIGITS), _count(raw, _MARKS),
            len(set(words)), max(map(len, words), default=0))


def rule_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    def compute(texts):
        rows = [statistics_of(t) for t in texts.to_pylist()]
        return [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(STATISTICS))]

    return append_columns(docs, [text], ADDED, compute)


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT) * F.col("n_words"))


def _features(stats: np.ndarray) -> np.ndarray:
    """Scale-free features of statistics (rows by STATISTICS)."""
    v = {n: stats[:, i].astype(np.float64) for i, n in enumerate(STATISTICS)}
    words, chars = np.maximum(v["n_words"], 1), np.maximum(v["word_chars"], 1)
    return np.stack([
        np.log1p(v["n_words"]), v["word_chars"] / words, v["n_symbols"] / words,
        v["n_dup_lines"] / np.maximum(v["n_lines"], 1), v["n_repeat_words"] / words, v["n_upper"] / chars,
        v["n_digits"] / chars, v["n_marks"] / words, np.log1p(words / np.maximum(v["n_distinct"], 1)),
        np.log1p(v["longest_word"])], axis=1)


def _mean_path(n) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 2, 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


def grow_tree(rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One tree: per node (feature, split, left, right, path length); a leaf points to itself."""
    limit, nodes = int(np.ceil(np.log2(max(len(rows), 2)))), []

    def grow(part: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([0, 0.0, at, at, depth + float(_mean_path(len(part)))])
        low, high = (part.min(0), part.max(0)) if len(part) else (np.zeros(1), np.zeros(1))
        usable = np.flatnonzero(high > low)
        if depth < limit and len(part) > 1 and len(usable):
            f = int(rng.choice(usable))
            split = float(rng.uniform(low[f], high[f]))
            left = part[:, f] < split
            nodes[at][:2] = [f, split]
            nodes[at][2] = grow(part[left], depth + 1)
            nodes[at][3] = grow(part[~left], depth + 1)
        return at

    grow(rows, 0)
    return np.array(nodes)


def fit_forest(stats: DataFrame, key: str, trees: int = TREES, leaf_sample: int = LEAF_SAMPLE, seed: int = 7):
    """Trees on a bounded sample: at most ``trees * leaf_sample`` rows, spread by the hash of their id."""
    sample = spread_sample(stats.select(key, *STATISTICS), key, trees * leaf_sample, seed).select(*STATISTICS).collect()
    rows = _features(np.array([tuple(r) for r in sample], np.int64).reshape(-1, len(STATISTICS)))
    rng = np.random.default_rng(seed)
    rng.shuffle(rows)
    parts = np.array_split(rows, max(1, min(trees, len(rows) // max(2, leaf_sample // 4) or 1)))
    return [grow_tree(p, rng) for p in parts], float(max(_mean_path(max(len(p) for p in parts)), 1.0))


def score(forest, stats: np.ndarray) -> np.ndarray:
    """Anomaly of each row, between 0 and 1: the shorter its mean path, the nearer to 1."""
    trees, norm = forest
    rows = _features(stats)
    index, total = np.arange(len(rows)), np.zeros(len(rows))
    for tree in trees:
        at = np.zeros(len(rows), np.int64)
        feature, split, left, right = tree[:, 0].astype(np.int64), tree[:, 1], *tree[:, 2:4].astype(np.int64).T
        for _ in range(64):
            step = np.where(rows[index, feature[at]] < split[at], left[at], right[at])
            if (step == at).all():
                break
            at = step
        total += tree[at, 4]
    return 2.0 ** -(total / len(trees) / norm)


def score_statistics(stats: DataFrame, forest) -> DataFrame:
    def compute(*columns):
        return [pa.array(score(forest, np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1)))]

    return append_columns(stats, list(STATISTICS), T.StructType([T.StructField("anomaly", T.DoubleType())]),
                          compute, rows=8192)


def calibrate(scored: DataFrame, labels: DataFrame, key: str, max_loss: float = MAX_LOSS) -> float:
    """The lowest threshold that loses at most ``max_loss`` of the good rows which the base rules keep."""
    judged = labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull()).groupBy(key).agg(
        F.max("quality").alias("_good"))
    steps = scored.join(judged, key).where((F.col("_good") == 1) & ~base_failed()).groupBy(
        F.floor(F.col("anomaly") * STEPS).cast("int").alias("step")).count().collect()
    left, allowed = 0, max_loss * sum(r["count"] for r in steps)
    threshold = 1.0 + 1.0 / STEPS
    for r in sorted(steps, key=lambda r: -r["step"]):
        left += r["count"]
        if left > allowed:
            return (r["step"] + 1) / STEPS
        threshold = r["step"] / STEPS
    return threshold if not steps else 1.0 + 1.0 / STEPS


def judge_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                    max_loss: float = MAX_LOSS, **forest_options) -> DataFrame:
    """``key``, the statistics, ``anomaly``, ``base_failed`` and ``kept`` of every row of ``docs``."""
    stats = land(rule_statistics(docs.select(F.col(key), F.col(text).alias("_text")), "_text").drop("_text"))
    forest = fit_forest(stats, key, **forest_options)
    scored = score_statistics(stats, forest)
    threshold = calibrate(scored, labels, key, max_loss)
    return scored.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & (F.col("anomaly") < threshold))
