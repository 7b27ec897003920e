"""LM scoring: the masked pseudo-likelihood of a text under a bidirectional window network.

The network reads ``SIDE`` words on either side of a masked word through shared embeddings and a hidden
layer, and predicts the word in two steps: its class, then the word within the class. A document's score
is the sum of the log probabilities of its words, each given the words on both sides.

The vocabulary grows with the corpus: all words are counted over all documents, in a table that stays
sharded. The network predicts ids. The most frequent words have ids of their own (of equally frequent ones
those of the lowest hash), all others share hashed ids; such a word has the probability of its id times its
share of the id's occurrences. The counts of the most frequent shared words are sent to the tasks, those of
all others are joined; how many are sent doesn't change a score. The words scored are those counted, so none
is unseen. Training runs where the data lie: in each round every partition trains a copy of the
network on its documents, one word in ``ROUNDS`` of every document, the next one each round, so every word
is a target once; the copies are averaged by their number of words, block of weights by block. What a round
shuffles grows with the number of partitions; only the averaged network, of fixed size, passes through the
driver.

Defined results: a text without words has no words, a log probability of 0 and no mean; a corpus without
words leaves the network untrained; repeated rows are scored row by row; a null id is scored like others;
columns of the input named as the added ones are replaced.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import append_columns, discard, highest, land, most_frequent, slices

SIDE = 2
CLASSES, PER_CLASS = 64, 64
#: Ids of frequent words; the rest of the ``CLASSES * PER_CLASS`` ids is shared by hash.
OWN_IDS = 3072
IDS = CLASSES * PER_CLASS
#: Words with a shared id whose counts are sent to the tasks, at most; the rest is joined.
SENT = 500_000
EMBEDDING, HIDDEN = 16, 24
ROUNDS = 3
BATCH, RATE = 2048, 0.1
#: Words that are scored at a time.
SCORE_WORDS = 1 << 16
#: Rows of a layer, and weights, that are computed at a time, so that they stay in a processor's cache.
CACHED_ROWS = 1024
CACHED_WEIGHTS = 16_384
#: Weights that travel in one row.
BLOCK = 8192


#: The places of the embedding of every id.
_CELLS = np.arange((IDS + 1) * EMBEDDING).reshape(-1, EMBEDDING)


def _hash(word: str) -> int:
    value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >> 63 else value


class Ids(dict):
    """Word to id, kept for the words of a task."""

    LIMIT = 500_000

    def __init__(self, frequent: dict[int, int]):
        super().__init__()
        self.frequent = frequent

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        code = _hash(word)
        found = self.frequent.get(code)
        value = self[word] = OWN_IDS + code % (IDS - OWN_IDS) if found is None else found
        return value


class Words(dict):
    """Word to its place in arrays of what is known of the words of a task.

    ``ids`` are their ids, ``codes`` their hashes, ``logs`` the logs of their shares of their ids: 0 with an id of
    its own, nan if its count isn't here.
    """

    def __init__(self, frequent: dict[int, int], codes: np.ndarray, logs: np.ndarray):
        super().__init__()
        own = np.array(sorted(frequent), np.int64)
        self.own = own, np.array([frequent[c] for c in own.tolist()], np.int64)
        self.sent = codes, logs
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.fresh: list[int] = []
        self.ids, self.codes, self.logs = np.empty(0, np.uint16), np.empty(0, np.int64), np.empty(0)

    def __missing__(self, word: str) -> int:
        value = self[word] = len(self)
        self.fresh.append(_hash(word))
        return value

    def places(self, texts: list[list[str]], size: int) -> np.ndarray:
        """The places of all ``size`` words of the texts, one after the other."""
        if len(self) >= Ids.LIMIT:
            self.forget()
        found = np.fromiter(map(self.__getitem__, itertools.chain.from_iterable(texts)), np.int64, size)
        if self.fresh:
            fresh = np.array(self.fresh, np.int64)
            self.fresh = []
            ids, logs = OWN_IDS + fresh % (IDS - OWN_IDS), np.full(len(fresh), np.nan)
            at, known = _looked_up(self.sent[0], fresh)
            logs[known] = self.sent[1][at[known]]
            at, known = _looked_up(self.own[0], fresh)
            ids[known], logs[known] = self.own[1][at[known]], 0.0
            self.ids = np.concatenate([self.ids, ids.astype(np.uint16)])
            self.codes, self.logs = np.concatenate([self.codes, fresh]), np.concatenate([self.logs, logs])
        return found


def _looked_up(ordered: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each code in the ordered ones, and whether it is there."""
    at = np.searchsorted(ordered, codes)
    known = at < len(ordered)
    known[known] = ordered[at[known]] == codes[known]
    return at, known


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``code, n``: occurrences of every word of the corpus by its hash."""
    def run(batches):
        from collections import Counter

        known: dict[str, int] = {}
        for batch in slices(batches, 2048):
            found: Counter = Counter()
            for t in batch.column(0).to_pylist():
                if t:
                    found.update(t.lower().split())
            if len(known) > 500_000:
                known.clear()
            codes = []
            for w in found:
                code = known.get(w)
                if code is None:
                    code = known[w] = _hash(w)
                codes.append(code)
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(list(found.values()), pa.int64())], ["code", "n"])

    return docs.select(text).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


class Network:
    """Weights as one flat vector of float32 with named views; the last row of ``W``, ``C`` and of every class of ``O`` is the bias."""

    SHAPES = {"E": (IDS + 1, EMBEDDING), "W": (2 * SIDE * EMBEDDING + 1, HIDDEN), "C": (HIDDEN + 1, CLASSES),
              "O": (CLASSES, HIDDEN + 1, PER_CLASS)}
    SIZE = sum(int(np.prod(s)) for s in SHAPES.values())

    def __init__(self, flat: np.ndarray | None = None, seed: int = 3):
        start = flat is None
        if start:
            rng = np.random.default_rng(seed)
            flat = (rng.standard_normal(self.SIZE) * 0.1).astype(np.float32)
        self.flat, self.p, at = np.array(flat, np.float32), {}, 0
        for name, shape in self.SHAPES.items():
            size = int(np.prod(shape))
            self.p[name] = self.flat[at:at + size].reshape(shape)
            at += size
        if start:  # drawn are the weights of all classes, then their biases
            drawn = self.p["O"].reshape(-1).copy()
            self.p["O"][:, :HIDDEN] = drawn[:CLASSES * HIDDEN * PER_CLASS].reshape(CLASSES, HIDDEN, PER_CLASS)
            self.p["O"][:, HIDDEN] = drawn[CLASSES * HIDDEN * PER_CLASS:].reshape(CLASSES, PER_CLASS)
        self._spare: dict[str, np.ndarray] = {}

    def _room(self, name: str, rows: int, columns: int) -> np.ndarray:
        """An array that the steps use again; it starts with ones, and the last column of ``h`` stays so for the bias."""
        held = self._spare.get(name)
        if held is None or len(held) < rows:
            held = self._spare[name] = np.ones((rows, columns), np.float32)
        return held[:rows]

    def _forward(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The embeddings, and the hidden layer with a column of ones."""
        n = len(context)
        x, h = self._room("x", n, 2 * SIDE * EMBEDDING), self._room("h", n, HIDDEN + 1)
        self.p["E"].take(context.reshape(-1), axis=0, out=x.reshape(-1, EMBEDDING), mode="clip")
        z = x @ self.p["W"][:-1]
        z += self.p["W"][-1]
        _tanh(z, h[:, :HIDDEN])
        return x, h

    def _bound(self, name: str) -> float:
        """No output of the layer is larger: all its inputs are between -1 and 1."""
        return float(np.abs(self.p[name]).sum(axis=-2).max())

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        of, within = np.divmod(target.astype(np.int64), PER_CLASS)
        order, parts = _by_class(of)
        context, of, within = context[order], of[order], within[order]
        hidden, ordered = np.ones((len(order), HIDDEN + 1), np.float32), np.empty(len(order), np.float32)
        weights = self.p["W"]
        # What a word adds to the hidden layer from each of its places.
        adds = [self.p["E"] @ weights[k * EMBEDDING:(k + 1) * EMBEDDING] for k in range(2 * SIDE)]
        adds[0] += weights[-1]
        bound, inner = self._bound("C"), self._bound("O")
        for at in range(0, len(order), CACHED_ROWS):
            part = slice(at, at + CACHED_ROWS)
            z = adds[0].take(context[part, 0], axis=0)
            for k in range(1, 2 * SIDE):
                z += adds[k].take(context[part, k], axis=0)
            _tanh(z, hidden[part, :HIDDEN])
            ordered[part] = _chosen(hidden[part] @ self.p["C"], of[part], bound)
        for k, first, end in parts:
            for at in range(first, end, CACHED_ROWS):
                part = slice(at, min(at + CACHED_ROWS, end))
                ordered[part] += _chosen(hidden[part] @ self.p["O"][k], within[part], inner)
        out = np.empty_like(ordered)
        out[order] = ordered
        return out

    def step(self, context: np.ndarray, target: np.ndarray, squares: np.ndarray, rate: float) -> None:
        """One step of adaptive gradient descent on the mean log loss."""
        of, within = np.divmod(target.astype(np.int64), PER_CLASS)
        order, parts = _by_class(of)
        context, of, within, n = context[order], of[order], within[order], len(target)
        x, h = self._forward(context)
        every = np.arange(n)
        if "grad" not in self._spare:
            self._spare["grad"] = Network(np.zeros(self.SIZE, np.float32))
        grad = self._spare["grad"]
        d = _softmax(np.dot(h, self.p["C"], self._room("d", n, CLASSES)), n, self._bound("C"))
        d[every, of] -= np.float32(1 / n)
        np.dot(h.T, d, grad.p["C"])
        e = self._room("e", n, PER_CLASS)
        for k, at, end in parts:
            np.dot(h[at:end], self.p["O"][k], e[at:end])
        _softmax(e, n, self._bound("O"))[every, within] -= np.float32(1 / n)
        back = self._room("back", n, HIDDEN + 1)
        grad.p["O"][:] = 0
        for k, at, end in parts:
            np.dot(h[at:end].T, e[at:end], grad.p["O"][k])
            np.dot(e[at:end], self.p["O"][k].T, back[at:end])
        inner = h[:, :HIDDEN]
        dz = (d @ self.p["C"][:HIDDEN].T + back[:, :HIDDEN]) * (1 - inner * inner)
        np.dot(x.T, dz, grad.p["W"][:-1])
        grad.p["W"][-1] = dz.sum(0)
        grad.p["E"][:] = 0
        if "cells" not in self._spare or self._spare["cells"].size != context.size * EMBEDDING:
            self._spare["cells"] = np.empty((context.size, EMBEDDING), np.int64)
        cells = _CELLS.take(context.reshape(-1), axis=0, out=self._spare["cells"], mode="clip")
        np.add.at(grad.p["E"].reshape(-1), cells.reshape(-1), (dz @ self.p["W"][:-1].T).reshape(-1))
        change = self._room("change", 1, CACHED_WEIGHTS)[0]
        for at in range(0, self.SIZE, CACHED_WEIGHTS):
            part = slice(at, min(at + CACHED_WEIGHTS, self.SIZE))
            own, held, to = grad.flat[part], squares[part], change[:part.stop - at]
            held += np.multiply(own, own, out=to)
            np.sqrt(held, out=to)
            to += np.float32(1e-6)
            np.divide(own, to, out=to)
            to *= np.float32(rate)
            self.flat[part] -= to


#: Logits up to this size need no shift before the exponential of a float32.
SAFE = 60.0


def _tanh(z: np.ndarray, out: np.ndarray) -> None:
    """The hyperbolic tangent by the exponential, which is faster on arrays of float32; ``z`` is overwritten."""
    np.clip(z, -15, 15, out=z)
    z *= -2
    np.exp(z, out=z)
    z += 1
    np.divide(2, z, out=z)
    np.subtract(z, 1, out=out)


def _row_sums(z: np.ndarray) -> np.ndarray:
    return z @ np.ones(z.shape[1], np.float32)


def _chosen(z: np.ndarray, column: np.ndarray, bound: float) -> np.ndarray:
    """The log of the softmax of every row at its column; no value of ``z`` is beyond ``bound``."""
    if not bound <= SAFE:
        z -= z.max(1, keepdims=True)
    picked = z[np.arange(len(z)), column]
    return picked - np.log(_row_sums(np.exp(z, out=z)))


def _softmax(z: np.ndarray, n: int, bound: float) -> np.ndarray:
    """The softmax of every row over ``n``, in place; no value of ``z`` is beyond ``bound``."""
    for at in range(0, len(z), CACHED_ROWS):
        part = z[at:at + CACHED_ROWS]
        if not bound <= SAFE:
            part -= part.max(1, keepdims=True)
        np.exp(part, out=part)
        part *= (1 / (_row_sums(part) * np.float32(n)))[:, None]
    return z


def _by_class(of: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The rows ordered by class, and (class, start, stop) of each."""
    order = np.argsort(of.astype(np.uint16), kind="stable")
    ends = np.cumsum(np.bincount(of, minlength=CLASSES)).tolist()
    return order, [(k, at, end) for k, (at, end) in enumerate(zip([0, *ends], ends, strict=False)) if at < end]


def turns(texts: list[np.ndarray], offset: int, stride: int) -> np.ndarray:
    """Which words of the texts are targets of a round: every ``stride``-th of each text."""
    return np.concatenate([np.arange(len(t)) % stride == offset for t in texts] or [np.zeros(0, bool)])


def windows(texts: list[np.ndarray], now: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, context, target) of every word, or of those that ``now`` marks; beyond a text's ends stands the id ``IDS``."""
    sizes = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(owner)) + SIDE * (owner + 1)
    line = np.full(len(owner) + SIDE * (len(texts) + 1), IDS, np.int64)
    line[at] = np.concatenate([np.empty(0, np.int64), *texts])
    if now is not None:
        owner, at = owner[now], at[now]
    steps = [k for k in range(-SIDE, SIDE + 1) if k]
    return owner, line[at[:, None] + np.array(steps)], line[at]


def encode_documents(docs: DataFrame, frequent: dict[int, int], text: str = "text",
                     shares: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """``docs`` with the ids of its words, packed, instead of the text.

    ``_within`` sums the logs of the shares that ``shares`` (codes, logs) has, ``_far`` are the other shared words.
    """
    codes, logs = shares or (np.empty(0, np.int64), np.empty(0))
    sent = docs.sparkSession.sparkContext.broadcast((frequent, codes, logs))
    held: list[Words] = []

    def compute(texts):
        if not held:
            held.append(Words(*sent.value))
        words = [t.lower().split() if t else [] for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, words)])
        places = held[0].places(words, int(ends[-1]))
        ids, logs = held[0].ids[places], held[0].logs[places]
        away = np.isnan(logs)
        logs[away] = 0
        within = [float(logs[at:end].sum()) for at, end in itertools.pairwise(ends.tolist())]
        parts = [ids[at:end].tobytes() for at, end in itertools.pairwise(ends.tolist())]
        far = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(away)])[ends], pa.int32()), pa.array(held[0].codes[places[away]]))
        return [pa.array(parts, pa.binary()), pa.array(within, pa.float64()), far]

    return append_columns(docs, [text], T.StructType([
        T.StructField("ids", T.BinaryType()), T.StructField("_within", T.DoubleType()),
        T.StructField("_far", T.ArrayType(T.LongType()))]), compute)


def _train_round(encoded: DataFrame, network: Network, offset: int, rate: float, stride: int,
                 batch_words: int) -> np.ndarray | None:
    """The average of the copies that the partitions train, weighted by their words."""
    sent = encoded.sparkSession.sparkContext.broadcast(network.flat)

    def train(batches):
        from pyspark import TaskContext

        own, squares, seen = Network(sent.value), np.full(Network.SIZE, 1e-4, np.float32), 0
        contexts, targets, waiting = [], [], 0

        def run(last: bool):
            nonlocal contexts, targets, waiting, seen
            c, t = np.concatenate(contexts), np.concatenate(targets)
            stop = len(t) if last else len(t) - len(t) % batch_words
            for at in range(0, stop, batch_words):
                own.step(c[at:at + batch_words], t[at:at + batch_words], squares, rate)
            seen += stop
            contexts, targets, waiting = [c[stop:]], [t[stop:]], len(t) - stop

        for batch in slices(batches):
            texts = [np.frombuffer(b, np.uint16) for b in batch.column(0).to_pylist()]
            _, context, target = windows(texts, turns(texts, offset, stride))
            contexts.append(context)
            targets.append(target)
            waiting += len(targets[-1])
            if waiting >= 4 * batch_words:
                run(False)
        if contexts:
            run(True)
        if seen:
            part = TaskContext.get().partitionId()
            for k, at in enumerate(range(0, Network.SIZE, BLOCK)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int64()), pa.array([part], pa.int64()), pa.array([seen], pa.int64()),
                     pa.array([own.flat[at:at + BLOCK].tobytes()], pa.binary())], ["block", "part", "n", "weights"])

    def average(batches):
        block, total, n = None, None, 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([(total / n).astype(np.float32).tobytes()],
                                                                                        pa.binary())], ["block", "weights"])

        for batch in slices(batches, 64):
            for k, _, count, weights in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != block:
                    if block is not None:
                        yield row()
                    block, total, n = k, 0.0, 0
                total, n = total + np.frombuffer(weights, np.float32).astype(np.float64) * count, n + count
        if block is not None:
            yield row()

    copies = encoded.select("ids").mapInArrow(train, "block long, part long, n long, weights binary")
    # The copies of a block are summed as a stream, in the order of their partitions.
    mean = copies.repartition("block").sortWithinPartitions("block", "part").mapInArrow(
        average, "block long, weights binary").collect()
    if not mean:
        return None
    return np.concatenate([np.frombuffer(r.weights, np.float32) for r in sorted(mean, key=lambda r: r.block)])


def frequent_words(docs: DataFrame, text: str = "text") -> dict[int, int]:
    return _frequent(land(word_counts(docs, text)))


def _frequent(counts: DataFrame) -> dict[int, int]:
    rows = highest(counts, "n", "code", OWN_IDS).collect()
    return {r.code: i for i, r in enumerate(sorted(rows, key=lambda r: (-r.n, r.code)))}


def _slot(code):
    return F.pmod(code, F.lit(IDS - OWN_IDS))


def shared_totals(counts: DataFrame, frequent: dict[int, int]) -> np.ndarray:
    """Occurrences of each shared id."""
    spark, totals = counts.sparkSession, np.zeros(IDS - OWN_IDS, np.int64)
    own = spark.createDataFrame([(c,) for c in frequent], "code long")
    for r in counts.join(F.broadcast(own), "code", "left_anti").groupBy(_slot(F.col("code")).alias("slot")).agg(
            F.sum("n").alias("n")).collect():
        totals[r.slot] = r.n
    return totals


def sent_shares(counts: DataFrame, totals: np.ndarray, limit: int = SENT) -> tuple[np.ndarray, np.ndarray]:
    """Codes, in order, and logs of the shares of the most frequent words."""
    rows = most_frequent(counts, "n", limit + OWN_IDS).toArrow()
    codes, n = rows.column("code").to_numpy(), rows.column("n").to_numpy()
    order = np.argsort(codes)
    codes, n = codes[order], n[order]
    # Where a word has an id of its own, its share isn't asked for.
    return codes, np.log(n / np.maximum(totals[codes % (IDS - OWN_IDS)], 1))


def train(encoded: DataFrame, rounds: int = ROUNDS, stride: int | None = None, rate: float = RATE,
          batch_words: int = BATCH) -> Network:
    """Trained on every word once, unless a smaller ``stride`` than ``rounds`` repeats words."""
    network, stride = Network(), stride or rounds
    for k in range(rounds):
        mean = _train_round(encoded, network, k * stride // rounds, rate / (k + 1), stride, batch_words)
        if mean is not None:
            network = Network(mean)
    return network


ADDED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("log_prob", T.DoubleType()),
                      T.StructField("mean_log_prob", T.DoubleType())])


def score_encoded(encoded: DataFrame, network: Network) -> DataFrame:
    sent = encoded.sparkSession.sparkContext.broadcast(network.flat)
    held: list[Network] = []

    def compute(column):
        if not held:
            held.append(Network(sent.value))
        texts = [np.frombuffer(b, np.uint16) if b else np.empty(0, np.uint16) for b in column.to_pylist()]
        sizes = np.array([len(t) for t in texts], np.int64)
        sums = np.zeros(len(texts))
        owner, context, target = windows(texts)
        for at in range(0, len(target), SCORE_WORDS):
            part = slice(at, at + SCORE_WORDS)
            sums += np.bincount(owner[part], held[0].log_probabilities(context[part], target[part]), len(texts))
        mean = pa.array(sums / np.maximum(sizes, 1), mask=sizes == 0)
        return [pa.array(sizes), pa.array(sums), mean]

    return append_columns(encoded, ["ids"], ADDED, compute, rows=256).drop("ids")


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", sent: int = SENT, **options) -> DataFrame:
    """``key, n_words, log_prob, mean_log_prob`` of every row of ``docs``, by a network trained on them."""
    spark = docs.sparkSession
    own = docs.select(F.col(key), F.col(text).alias("_text"))
    counts = land(word_counts(own, "_text"))
    frequent = _frequent(counts)
    totals = shared_totals(counts, frequent)
    encoded = land(encode_documents(own, frequent, "_text", sent_shares(counts, totals, sent)).drop("_text").withColumn(
        "_row", F.monotonically_increasing_id()))
    sums = spark.createDataFrame([(i, int(n)) for i, n in enumerate(totals) if n], "_slot long, _total long")
    # The words whose counts were not sent: their rows meet the table of counts.
    far = encoded.select("_row", F.explode("_far").alias("code")).groupBy("_row", "code").agg(F.count("*").alias("_times"))
    logs = land(far.join(counts, "code").withColumn("_slot", _slot(F.col("code"))).join(F.broadcast(sums), "_slot").groupBy(
        "_row").agg(F.sum(F.col("_times") * F.log(F.col("n") / F.col("_total"))).alias("_rest")))
    scored = score_encoded(encoded.drop("_far"), train(encoded, **options)).join(logs, "_row", "left")
    whole = F.col("log_prob") + F.col("_within") + F.coalesce("_rest", F.lit(0.0))
    discard(spark, counts)
    return scored.select(key, "n_words", whole.alias("log_prob"),
                         F.when(F.col("n_words") > 0, whole / F.col("n_words")).alias("mean_log_prob"))
