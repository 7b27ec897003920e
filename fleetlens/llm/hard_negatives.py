"""Hard negatives by threshold joins in the manner of L2AP: an inverted index that norm bounds keep small, and pruning by remaining norms.

A score is the integer inner product of the quantised vectors (each component ``floor(256 * x)``). Every anchor asks for the
rows of its label that score at or above a threshold, and the threshold is lowered until its window of positives is full;
then each positive opens a window of scores, from which its negatives are taken, again from a high threshold downwards to the
window's end. Rows are indexed where they lie, in shards of one Arrow batch: dimensions are taken in order of their energy, and a row
is left out of the postings from the dimension on where the norm of its suffix times that of any query's suffix stays
below the threshold. Partial scores are accumulated over the postings; what can't reach the threshold with the remaining norms is
pruned, then the remaining dimensions are added with further pruning. The bounds are exact, so no row is missed.

Anchors go to the tasks in passes of at most ``ANCHOR_BYTES`` of vectors; a pass and its windows are all that the driver and a task hold.
Rows never move; a task sends its best rows of each window.

Defined results: rows with a null label or vector, or a null or non-finite component, take no part. A component that a shorter
vector lacks counts as zero; an empty vector scores 0. Each row is a row of its own: one that repeats an id is another row, and a repeated anchor
repeats its results. Rows without an id are never anchors and come last among ties. Scores outside 64 bits
are held at its ends. A window of a negative score is empty by its own bounds. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import discard, land, shared_folder

ANCHOR_BYTES = 16 << 20
N_POSITIVES = N_NEGATIVES = 5
LOW, HIGH = 80, 100
SCALE = 256
#: Thresholds of positives, as cosines with a row of median length; below the last one every row counts.
COSINES = (0.5, 0.35, 0.25, 0.15, 0.0)
#: Thresholds of negatives, as shares of the way from the top of a window to its end.
STEPS = (0.25, 0.5, 1.0)
#: Queries that pass the postings together, and dimensions that they take at a time.
QUERIES, DIMENSIONS = 64, 8
#: Products of norms below this are exact as doubles.
EXACT = float(1 << 53)

FOUND = T.StructType([T.StructField(n, T.LongType()) for n in ("window", "row", "id", "score")] + [T.StructField("has_id", T.BooleanType())])
NEGATIVES = T.StructType([
    T.StructField("anchor_id", T.LongType()), T.StructField("positive_id", T.LongType()), T.StructField("rank", T.IntegerType()),
    T.StructField("negative_id", T.LongType()), T.StructField("positive_score", T.LongType()), T.StructField("negative_score", T.LongType())])


def quantised(rows: DataFrame, vec_id: str, vector: str, label: Column, anchor: Column) -> DataFrame:
    """``(row, id, label, vec, anchor)`` of the rows that take part; landed, so that ``row`` stays the same."""
    # NaN sorts above infinity.
    fit = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return land(rows.select(
        F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"),
        F.when(fit, F.transform(vector, _floor)).alias("vec"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"))
        .where("label is not null and vec is not null")
        .withColumn("row", F.monotonically_increasing_id()))


def _floor(x: Column) -> Column:
    """``floor(SCALE * x)`` as a double; beyond 2^52 every double is whole."""
    v = x.cast("double") * SCALE
    return F.when(F.abs(v) < float(1 << 52), F.floor(v).cast("double")).otherwise(v)


# ---------------------------------------------------------------- search in one shard

def suffix_norms(m: np.ndarray) -> np.ndarray:
    """Norm of every row from each dimension on; the last column is zero."""
    out = np.zeros((m.shape[0], m.shape[1] + 1))
    with np.errstate(over="ignore"):
        out[:, :-1] = np.sqrt(np.cumsum((m * m)[:, ::-1], axis=1)[:, ::-1])
    return out


class Queries:
    """Anchors of a pass with their windows; each window is a range of scores in rows of the same or of other labels."""

    def __init__(self, vecs, labels, rows, of, low, high, same):
        self.vecs, self.labels, self.rows, self.same = vecs, labels, rows, same
        self.of, self.low, self.high = of, low.astype(float), high.astype(float)
        self.norms = suffix_norms(vecs)
        self.order = np.argsort(of, kind="stable")  # windows by anchor
        self.first = np.searchsorted(of[self.order], np.arange(len(labels) + 1))

    def floors(self, windows_low):
        """The lowest threshold among the windows of every anchor; infinite where it has none."""
        floors = np.full(len(self.labels), np.inf)
        np.minimum.at(floors, self.of, windows_low)
        return floors


def pairs_above(q, q_norms, x, x_norms, floors):
    """``(query, row, score)`` of all pairs that score at least the query's floor, by the postings of one shard."""
    dims = x.shape[1]
    if not q_norms[:, 0].max(initial=0.0) * x_norms[:, 0].max(initial=0.0) < EXACT:
        exact = np.array([[sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for v in x] for u in q], dtype=object)
        qi, xi = np.nonzero((exact >= floors[:, None]).astype(bool))
        ends = np.iinfo(np.int64)
        return qi, xi, np.array([min(max(s, ends.min), ends.max) for s in exact[qi, xi]], np.int64)
    slack = 1 + 1e-9
    # The index: a row's suffix is left out where its norm keeps every query of this group below its floor.
    lengths = np.where(q_norms[:, 0] > 0, q_norms[:, 0], 1.0)
    least = np.min(np.where(q_norms[:, 0] > 0, floors / lengths, -np.inf))
    share = (q_norms / lengths[:, None]).max(axis=0)
    cut = np.minimum((x_norms * share * slack + 1e-9 >= least).sum(axis=1), dims)
    cut = -(-cut // DIMENSIONS) * DIMENSIONS
    order = np.argsort(-cut, kind="stable")
    order = order[cut[order] > 0]
    cut, held = np.minimum(cut[order], dims), x[order]
    scores = np.zeros((len(q), len(order)))
    for d in range(0, dims, DIMENSIONS):
        stop = np.searchsorted(-cut, -d)  # the posting lists of these dimensions hold the rows before it
        if stop == 0:
            break
        scores[:, :stop] += q[:, d:d + DIMENSIONS] @ held[:stop, d:d + DIMENSIONS].T
    rest = q_norms[:, cut] * x_norms[order, cut] * slack + 1e-6
    qi, xi = np.nonzero(scores + rest >= floors[:, None])
    found, cuts, rows = scores[qi, xi], cut[xi], order[xi]
    for d in range(0, dims, DIMENSIONS):
        if not len(qi):
            break
        open_ = np.flatnonzero(cuts <= d)
        if not len(open_):
            continue
        found[open_] += np.einsum("ij,ij->i", q[qi[open_], d:d + DIMENSIONS], x[rows[open_], d:d + DIMENSIONS])
        end = min(d + DIMENSIONS, dims)
        reach = found + np.where(cuts <= d, q_norms[qi, end] * x_norms[rows, end] * slack + 1e-6, np.inf)
        stay = reach >= floors[qi]
        qi, found, cuts, rows = qi[stay], found[stay], cuts[stay], rows[stay]
    stay = found >= floors[qi]
    return qi[stay], rows[stay], np.rint(found[stay]).astype(np.int64)


def best(window, row, ids, score, has_id, size):
    """The first ``size`` entries of every window, by score downwards and id upwards."""
    # The row settles equal ids, so that every task keeps the same ones.
    order = np.lexsort((row, ids, ~has_id, ~score, window))
    window = window[order]
    starts = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]])) if len(window) else np.zeros(0, np.int64)
    place = np.arange(len(window)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(window)]])))
    order = order[place < size]
    return window[place < size], row[order], ids[order], score[order], has_id[order]


def search(shards, queries: Queries, dims: int, order: np.ndarray, size: int):
    """The best rows of every window among all rows of a task; ``shards`` yields (row, id, label, vec) as arrays."""
    held = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, bool))
    low = queries.low.copy()
    for batch in shards:
        rows, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("row", "label"))
        has_id = np.asarray(batch.column("id").is_valid())
        ids = np.asarray(batch.column("id").fill_null(0))
        x = padded(batch.column("vec"), dims)[:, order]
        x_norms = suffix_norms(x)
        floors = queries.floors(low)
        asking = np.flatnonzero(floors < np.inf)
        asking = asking[np.argsort(floors[asking] / np.maximum(queries.norms[asking, 0], 1e-9), kind="stable")]
        parts = [held]
        for at in range(0, len(asking), QUERIES):
            own = asking[at:at + QUERIES]
            qi, xi, scores = pairs_above(queries.vecs[own], queries.norms[own], x, x_norms, floors[own])
            anchors = own[qi]
            equal = queries.labels[anchors] == labels[xi]
            fit = (equal & (queries.rows[anchors] != rows[xi])) if queries.same else ~equal
            anchors, xi, scores = anchors[fit], xi[fit], scores[fit]
            # Every pair meets each window of its anchor.
            n = queries.first[anchors + 1] - queries.first[anchors]
            pair = np.repeat(np.arange(len(anchors)), n)
            window = queries.order[np.repeat(queries.first[anchors] - (np.cumsum(n) - n), n) + np.arange(len(pair))]
            inside = (scores[pair] >= low[window]) & (scores[pair] <= queries.high[window])
            window, pair = window[inside], pair[inside]
            parts.append((window, rows[xi[pair]], ids[xi[pair]], scores[pair], has_id[xi[pair]]))
        held = best(*[np.concatenate(c) for c in zip(*parts, strict=True)], size)
        # A full window takes no row below its last one.
        last = np.flatnonzero(np.bincount(held[0], minlength=len(low)) >= size)
        if len(last):
            ends = np.searchsorted(held[0], last, side="right") - 1
            low[last] = np.maximum(low[last], held[3][ends])
    return held


def padded(vecs, dims: int) -> np.ndarray:
    """A list column as a matrix, short rows filled with zeros."""
    counts = np.asarray(vecs.value_lengths().fill_null(0))
    flat = np.asarray(vecs.flatten(), dtype=float)
    if len(counts) and (counts == dims).all():
        return flat.reshape(len(counts), dims)
    out = np.zeros((len(counts), dims))
    starts = np.cumsum(counts) - counts
    out[np.repeat(np.arange(len(counts)), counts), np.arange(len(flat)) - np.repeat(starts, counts)] = flat
    return out


# ---------------------------------------------------------------- rounds

def _round(rows: DataFrame, queries: Queries, dims: int, order: np.ndarray, size: int) -> DataFrame:
    """``FOUND`` of the best rows of every window, landed."""
    sent = rows.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(FOUND)
        window, row, ids, score, has_id = search(batches, sent.value, dims, order, size)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, type=f.type) for c, f in zip((window, row, ids, score, has_id), schema, strict=True)], schema=schema)

    found = rows.select("row", "id", "label", "vec").mapInArrow(run, FOUND)
    place = Window.partitionBy("window").orderBy(F.desc("score"), F.desc("has_id"), "id", "row")
    kept = land(found.withColumn("place", F.row_number().over(place)).where(F.col("place") <= size))
    sent.unpersist()
    return kept


def _filled(found: DataFrame, n: int) -> np.ndarray:
    """Rows found for each of ``n`` windows of a pass."""
    counts = found.groupBy("window").count().toArrow()
    out = np.zeros(n, np.int64)
    out[np.asarray(counts["window"], dtype=np.int64)] = np.asarray(counts["count"], dtype=np.int64)
    return out


def _lowered(rows, anchors, of, floors_of_round, high, same, dims, order, size):
    """Rounds of falling thresholds; tables of ``FOUND`` whose windows number ``of``, each window in one of them."""
    active = np.arange(len(of))
    tables = []
    for k, floors in enumerate(floors_of_round):
        if not len(active):
            break
        last = k == len(floors_of_round) - 1
        queries = Queries(*anchors, of[active], floors[active], high[active], same)
        found = _round(rows, queries, dims, order, size)
        counts = _filled(found, len(active))
        done = counts >= size
        done |= last | (floors_of_round[-1][active] >= floors[active])
        names = found.sparkSession.createDataFrame(
            pa.table({"window": np.flatnonzero(done), "_own": active[done]}), "window long, _own long")
        tables.append((found, found.join(F.broadcast(names), "window").drop("window").withColumnRenamed("_own", "window")))
        active = active[~done]
    return tables


def mine(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: Column | str = "label",
         anchor: Column | None = None, n_positives: int = N_POSITIVES, n_negatives: int = N_NEGATIVES, low: int = LOW, high: int = HIGH,
         anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """``NEGATIVES``: for every anchor and each of its positives the highest rows of other labels with scores of ``low`` to
    ``high`` hundredths of the positive's."""
    spark = rows.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    anchor = F.lit(True) if anchor is None else anchor
    table = quantised(rows, vec_id, vector, label, anchor)
    sizes = table.agg(F.max(F.size("vec")).alias("dims"), F.count_if("anchor").alias("anchors"),
                      F.percentile_approx(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v)), 0.5).alias("norm")).first()
    dims = max(sizes.dims or 0, 1)
    path = f"{shared_folder(spark).rstrip('/')}/negatives-{uuid.uuid4().hex}"
    spark.createDataFrame([], NEGATIVES).write.parquet(path)
    energy = np.zeros(dims)
    for r in table.select(F.posexplode("vec")).groupBy("pos").agg(F.sum(F.col("col") * F.col("col")).alias("e")).collect():
        energy[r.pos] = r.e
    order = np.argsort(-energy, kind="stable")
    passes = -(-sizes.anchors // max(1, anchor_bytes // (8 * dims)))
    for k in range(passes):
        own = table.where(F.col("anchor") & (F.pmod(F.xxhash64("row"), F.lit(passes)) == k)).select("row", "id", "label", "vec").toArrow()
        if own.num_rows:
            negatives, used = _one_pass(table, own, dims, order, sizes.norm, n_positives, n_negatives, low, high)
            if negatives is not None:
                negatives.write.mode("append").parquet(path)
            discard(spark, *used)
    discard(spark, table)
    return spark.read.schema(NEGATIVES).parquet(path)


def _one_pass(table, own, dims, order, norm, n_positives, n_negatives, low, high):
    """The negatives of the anchors ``own`` (None where there are none) and the tables that they are read from."""
    spark = table.sparkSession
    vec = own["vec"].combine_chunks()
    anchors = (padded(vec, dims)[:, order], np.asarray(own["label"], dtype=np.int64), np.asarray(own["row"], dtype=np.int64))
    n = len(anchors[1])
    lengths = np.nan_to_num(suffix_norms(anchors[0])[:, 0] * norm, nan=0.0, posinf=0.0)
    floors = [*[np.ceil(lengths * c) for c in COSINES], np.full(n, -np.inf)]
    tables = _lowered(table, anchors, np.arange(n), floors, np.full(n, np.inf), True, dims, order, n_positives)
    # At most n_positives rows for each anchor of the pass.
    found = pa.concat_tables([t.select("window", "id", "score", "has_id", "place").toArrow() for _, t in tables])
    discard(spark, *[t for t, _ in tables])
    of, score = (np.asarray(found[c], dtype=np.int64) for c in ("window", "score"))
    bottom, top = -((-low * score.astype(object)) // 100), (high * score.astype(object)) // 100
    bottom, top = bottom.astype(float), top.astype(float)
    ids = own["id"].to_pylist()
    found_ids = np.where(np.asarray(found["has_id"]), np.asarray(found["id"]).astype(object), None)
    asked = np.flatnonzero(bottom <= top)
    if not len(asked):
        return None, []
    floors = [np.ceil(top[asked] - (top[asked] - bottom[asked]) * s) for s in STEPS[:-1]] + [bottom[asked]]
    tables = _lowered(table, anchors, of[asked], floors, top[asked], False, dims, order, n_negatives)
    windows = spark.createDataFrame(pa.table({
        "window": pa.array(np.arange(len(asked))), "anchor_id": pa.array([ids[a] for a in of[asked]], pa.int64()),
        "positive_id": pa.array(found_ids[asked].tolist(), pa.int64()), "positive_score": pa.array(score[asked])}),
        "window long, anchor_id long, positive_id long, positive_score long")
    out = None
    for _, t in tables:
        out = t if out is None else out.unionByName(t)
    return out.join(F.broadcast(windows), "window").select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.when(F.col("has_id"), F.col("id")).alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score")), [t for t, _ in tables]
