"""Quality classifier: interpolated modified Kneser-Ney n-grams of characters, trained on trusted text.

A word is read as its characters between marks of start and end. The counts, the continuation counts,
the discounts and the interpolated probabilities are grouped and joined tables, sharded by language
and n-gram. There is a model per language and one over all (``*``) for every other language. The model
is fitted on every trusted document of fold 0. A model of at most ``SENT_ROWS`` entries is sent to the tasks as sorted arrays
of numbers and the texts are scored where they lie; for a larger one, or one of more characters than fit a number,
the words of the texts are joined with the sharded tables. Both give the same scores, and neither shortens the model.

A document gets its perplexity per character and the surprisal of its most surprising word (in units
of the spread that a word of that length has). Both are held against quantiles of the trusted rows of
its language that the model was not fitted on; these cover all such rows.

Defined results: a text without words has no perplexity and is kept; a null or unknown language uses
the model over all; without trusted rows every document is kept; repeated ids are judged row by row;
an id with contradicting labels is not trusted; columns of the input named as the added ones are
replaced by them.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import append_columns, land, slices, tidy

ORDER = 5
#: n-grams and contexts that are sent to the tasks, at most; a larger model stays in its tables and is joined.
SENT_ROWS = 6_000_000
#: Share of the trusted documents of a language below the thresholds.
PERPLEXITY_QUANTILE = 0.995
PEAK_QUANTILE = 0.98
#: A language with fewer trusted rows uses the thresholds over all.
LEAST_ROWS = 20
ALL = "*"
_START, _END = "\x02", "\x03"
#: Words whose score a task remembers.
CACHE_WORDS = 200_000
#: Words that are scored at a time; the arrays of a word take about 1 KB.
SCORED_WORDS = 8_192
#: Different words whose n-grams a task counts at a time.
COUNTED_WORDS = 100_000

ADDED = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("log_likelihood", T.DoubleType()),
    T.StructField("perplexity", T.DoubleType()), T.StructField("peak", T.DoubleType())])


def trusted_rows(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, fold`` of the ids labelled good and not toxic: fold 0 is for fitting, fold 1 for thresholds."""
    agreed = labels.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    return agreed.where("q = 1 and t = 0").select(key, _fold(key).alias("fold"))


def _fold(key: str):
    return F.pmod(F.xxhash64(key), F.lit(2))


def ngram_counts(docs: DataFrame, order: int, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, gram, c``: occurrences of the n-grams of the highest order, by language and over all."""
    def counted(words):
        grams: Counter = Counter()
        for code, found in words.items():
            for w, c in found.items():
                padded = _START * (order - 1) + w + _END
                for i in range(len(w) + 1):
                    grams[code, padded[i:i + order]] += c
        return pa.RecordBatch.from_pydict(
            {"lang": [k[0] for k in grams], "gram": [k[1] for k in grams], "c": list(grams.values())},
            schema=pa.schema([("lang", pa.string()), ("gram", pa.string()), ("c", pa.int64())]))

    def count(batches):
        words: dict[str, Counter] = {}
        for batch in slices(batches):
            for t, code in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if t:
                    words.setdefault(code, Counter()).update(t.split())
            if sum(map(len, words.values())) >= COUNTED_WORDS:
                yield counted(words)
                words = {}
        yield counted(words)

    found = docs.select(F.col(text), F.coalesce(F.col(lang), F.lit(ALL)).alias("lang")).mapInArrow(
        tidy(count), "lang string, gram string, c long")
    return found.select(F.explode(F.array_distinct(F.array("lang", F.lit(ALL)))).alias("lang"), "gram", "c").groupBy(
        "lang", "gram").agg(F.sum("c").alias("c"))


def continuation_counts(higher: DataFrame) -> DataFrame:
    """How many different characters stand before each n-gram; ``higher`` has a row per longer n-gram."""
    return higher.groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("c"))


def discounts(counts: DataFrame) -> DataFrame:
    """``lang, d1, d2, d3``: what is taken from n-grams that occur once, twice, and more often."""
    def n(k):
        return F.sum((F.col("c") == k).cast("double"))

    y = F.expr("CASE WHEN n1 > 0 AND n2 > 0 THEN n1 / (n1 + 2 * n2) ELSE 0.5 END")

    def d(k):
        fresh = F.lit(float(k)) - F.lit(k + 1.0) * y * F.col(f"n{k + 1}") / F.greatest(f"n{k}", F.lit(1.0))
        return F.greatest(F.lit(0.1), F.least(fresh, F.lit(k - 0.1))).alias(f"d{k}")

    return counts.groupBy("lang").agg(*[n(k).alias(f"n{k}") for k in range(1, 5)]).select("lang", d(1), d(2), d(3))


def probabilities(counts: DataFrame, lower: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """``(lang, gram, p)`` of one order and ``(lang, context, weight)`` for what it hasn't seen.

    ``lower`` has the probabilities of the next lower order; below the lowest all characters are equal.
    """
    taken = F.expr("CASE WHEN c = 1 THEN d1 WHEN c = 2 THEN d2 ELSE d3 END")
    rows = counts.join(discounts(counts), "lang").select(
        "lang", "gram", F.expr("substring(gram, 1, length(gram) - 1)").alias("context"), "c", taken.alias("d"))
    contexts = rows.groupBy("lang", "context").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("weight"))
    if lower is None:
        uniform = counts.groupBy("lang").agg((1.0 / (F.count("*") + 1)).alias("p_low"))
        based = rows.join(uniform, "lang")
    else:
        based = rows.withColumn("suffix", F.expr("substring(gram, 2)")).join(
            lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("p_low")), ["lang", "suffix"])
    p = based.join(contexts, ["lang", "context"]).select(
        "lang", "gram", (F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total")
                         + F.col("weight") * F.col("p_low")).alias("p"))
    return p, contexts.select("lang", "context", "weight")


class _Entries:
    """Values of strings of characters, in sorted arrays by length; a string's number has ``bits`` bits a character."""

    def __init__(self, alphabet: np.ndarray, bits: int):
        self.alphabet, self.bits, self.tables = alphabet, bits, {}

    def numbers(self, text: str) -> np.ndarray:
        """The characters of a text as numbers from 1; 0 is a character that the model doesn't know."""
        points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.int64)
        at = np.searchsorted(self.alphabet, points)
        at[at == len(self.alphabet)] = 0
        return np.where(self.alphabet[at] == points, at + 1, 0)

    def add(self, length: int, texts: list[str], values: np.ndarray) -> None:
        ids = self.numbers("".join(texts)).reshape(len(texts), length)
        keys = reduce(lambda k, i: (k << self.bits) | ids[:, i], range(length), np.zeros(len(texts), np.int64))
        order = np.argsort(keys)
        self.tables[length] = keys[order], values[order]

    def look_up(self, length: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each number is there, and its value."""
        known, values = self.tables.get(length, (np.zeros(0, np.int64), np.zeros(0)))
        if not len(known):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return known[at] == keys, values[at]

    def get(self, text: str, default=None):
        key = reduce(lambda k, i: (k << self.bits) | int(i), self.numbers(text), 0)
        found, value = self.look_up(len(text), np.array([key], np.int64))
        return float(value[0]) if found[0] else default

    def __iter__(self):
        mask = (1 << self.bits) - 1
        for length, (keys, _) in self.tables.items():
            for key in keys.tolist():
                yield "".join(chr(self.alphabet[((key >> (self.bits * i)) & mask) - 1]) for i in reversed(range(length)))

    def __len__(self):
        return sum(len(keys) for keys, _ in self.tables.values())


class Model:
    """Log probabilities by language; a word costs the sum over its characters and its end.

    ``grams`` and ``contexts`` are empty where ``tables`` are to be joined instead.
    """

    def __init__(self, order: int, grams: dict, contexts: dict, unseen: dict, entropy: dict):
        self.order, self.grams, self.contexts, self.unseen, self.entropy = order, grams, contexts, unseen, entropy

    def code(self, lang: str | None) -> str:
        return lang if lang in self.unseen else ALL

    def words(self, code: str, words: list[str]) -> np.ndarray:
        """The log probability of each word."""
        grams, contexts, order = self.grams[code], self.contexts[code], self.order
        ids = grams.numbers("".join([_START * (order - 1) + w + _END for w in words]))
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        starts = np.cumsum(lengths) - lengths
        # Where each character and each end stands among the padded words.
        at = np.arange(lengths.sum()) + np.repeat((order - 1) * np.arange(1, len(words) + 1), lengths)
        keys = [np.zeros(len(at), np.int64)]
        before = [np.zeros(len(at), np.int64)]
        for k in range(order):
            keys.append(keys[-1] | (ids[at - k] << (grams.bits * k)))
            if k + 1 < order:
                before.append(before[-1] | (ids[at - 1 - k] << (grams.bits * k)))
        total, waiting = np.zeros(len(at)), np.arange(len(at))
        for k in range(order, 0, -1):
            found, p = grams.look_up(k, keys[k][waiting])
            total[waiting[found]] += p[found]
            waiting = waiting[~found]
            known, weight = contexts.look_up(k - 1, before[k - 1][waiting])
            total[waiting[known]] += weight[known]
        total[waiting] += self.unseen[code]
        return np.add.reduceat(total, starts)

    def texts(self, codes: list[str], texts: list[str | None], cache: dict) -> list[tuple]:
        """(words, log likelihood, perplexity per character, peak) of each text."""
        found = [Counter(t.split()) if t else Counter() for t in texts]
        wanted: dict[str, set] = {}
        for code, words in zip(codes, found, strict=True):
            if code in self.unseen:
                wanted.setdefault(code, set()).update(words)
        if sum(map(len, cache.values())) + sum(map(len, wanted.values())) > CACHE_WORDS:
            cache.clear()
        for code, words in wanted.items():
            known = cache.setdefault(code, {})
            fresh = [w for w in words if w not in known]
            for at in range(0, len(fresh), SCORED_WORDS):
                part = fresh[at:at + SCORED_WORDS]
                known.update(zip(part, self.words(code, part).tolist(), strict=True))
        return [self._text(code, words, cache) for code, words in zip(codes, found, strict=True)]

    def _text(self, code: str, found: Counter, cache: dict):
        if not found or code not in self.unseen:
            return sum(found.values()), 0.0, None, None
        known, mean, total, chars, n, peak = cache[code], self.entropy[code], 0.0, 0, 0, -math.inf
        for w, c in found.items():
            v, m = known[w], len(w) + 1
            total, chars, n = total + v * c, chars + m * c, n + c
            peak = max(peak, (-v - mean * m) / math.sqrt(m))
        return n, total, math.exp(-total / chars), peak


def _store(rows: DataFrame, length: int, out: dict[str, _Entries], fresh) -> None:
    """Rows (language, text, value) of one length into the entries by language; the bound on the model holds for them."""
    table = rows.toArrow().combine_chunks()
    langs, texts, values = (table.column(i) for i in range(3))
    codes = langs.to_numpy(zero_copy_only=False)
    for code in set(codes):
        mine = np.flatnonzero(codes == code)
        out.setdefault(code, fresh()).add(length, texts.take(pa.array(mine)).to_pylist(), values.to_numpy()[mine])


def fit(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
        order: int = ORDER, model_rows: int | None = None, sent_rows: int = SENT_ROWS) -> Model:
    """A model of all trusted documents of fold 0. Only where ``model_rows`` is given, a larger model falls in its order."""
    # The fold follows from the id, so that half of the texts need not meet the labels.
    chosen = docs.select(key, text, lang).where(_fold(key) == 0).join(trusted.where("fold = 0").select(key), key)
    top = land(ngram_counts(chosen, order, text, lang))
    while True:
        tables = [top]
        for _ in range(order - 1):
            tables.insert(0, land(continuation_counts(tables[0])))
        rows = sum(t.count() for t in tables) * 2
        if order == 1 or model_rows is None or rows <= model_rows:
            break
        # A shorter history: the n-grams of the next lower order by their occurrences.
        top = land(top.groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.sum("c").alias("c")))
        order -= 1
    levels, lower = [], None
    for counts in tables:
        lower, weights = probabilities(counts, lower)
        lower = land(lower)
        levels.append((lower, land(weights)))
    entropy = {r.lang: r.h for r in top.join(lower, ["lang", "gram"]).groupBy("lang").agg(
        (-F.sum(F.col("c") * F.log("p")) / F.sum("c")).alias("h")).collect()}
    unseen = {r.lang: -math.log(r["count"] + 1) for r in tables[0].groupBy("lang").count().collect()}
    model = Model(order, {}, {}, unseen, entropy)
    model.tables = levels
    characters = tables[0].where(F.col("lang") == ALL).select("gram").distinct()
    bits = (characters.count() + 2).bit_length()
    if rows > sent_rows or bits * order > 63:
        return model
    alphabet = np.array(sorted({ord(_START), *(ord(r.gram) for r in characters.collect())}), np.int64)
    for k, (probs, weights) in enumerate(levels, 1):
        _store(probs.select("lang", "gram", F.log("p")), k, model.grams, lambda: _Entries(alphabet, bits))
        _store(weights.select("lang", "context", F.log("weight")), k - 1, model.contexts, lambda: _Entries(alphabet, bits))
    return model


def _joined_scores(docs: DataFrame, model: Model, text: str, lang: str) -> DataFrame:
    """:func:`score_documents` by joins of the words with the tables of the model, whatever its size."""
    order, codes = model.order, list(model.unseen)

    def count(batches):
        for batch in slices(batches, 64):
            rows = [(d, code, w, c) for d, code, t in zip(*(col.to_pylist() for col in batch.columns), strict=True)
                    for w, c in Counter(t.split()).items()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:3]), pa.array(cols[3], pa.int64())],
                                             names=["_digest", "lang", "word", "c"])

    coded = docs.withColumns({"_digest": F.sha2(F.col(f"`{text}`"), 256),
                              "_code": F.when(F.col(f"`{lang}`").isin(codes), F.col(f"`{lang}`")).otherwise(F.lit(ALL))})
    # Equal texts of a language have equal scores, so a text is known by its digest.
    words = land(coded.where(F.col(f"`{text}`").isNotNull()).select("_digest", "_code", F.col(f"`{text}`")).mapInArrow(
        tidy(count), "_digest string, lang string, word string, c long").groupBy("_digest", "lang", "word").agg(F.max("c").alias("c")))
    padded = F.concat(F.lit(_START * (order - 1)), "word", F.lit(_END))
    places = land(words.select("lang", "word").distinct().select("lang", "word", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substring(padded, i, F.lit(order)))).alias("gram")))
    wanted = [places.select("lang", "gram").distinct()]
    for _ in range(order - 1):
        wanted.insert(0, wanted[0].select("lang", F.expr("substring(gram, 2)").alias("gram")).distinct())
    below = docs.sparkSession.createDataFrame([(c, "", v) for c, v in model.unseen.items()], "lang string, suffix string, v double")
    for grams, (probs, weights) in zip(wanted, model.tables, strict=True):
        rows = grams.select("lang", "gram", F.expr("substring(gram, 2)").alias("suffix"),
                            F.expr("substring(gram, 1, length(gram) - 1)").alias("context"))
        rows = rows.join(below, ["lang", "suffix"]).join(probs, ["lang", "gram"], "left").join(weights, ["lang", "context"], "left")
        value = F.coalesce(F.log("p"), F.coalesce(F.log("weight"), F.lit(0.0)) + F.col("v"))
        below = land(rows.select("lang", F.col("gram").alias("suffix"), value.alias("v")))
    scores = places.join(below.withColumnRenamed("suffix", "gram"), ["lang", "gram"]).groupBy("lang", "word").agg(F.sum("v").alias("v"))
    mean = reduce(lambda out, e: F.when(F.col("lang") == e[0], F.lit(e[1])).otherwise(out), model.entropy.items(), F.lit(0.0))
    m = F.length("word") + 1
    found = words.join(scores, ["lang", "word"]).groupBy("_digest", F.col("lang").alias("_code")).agg(
        F.sum("c").alias("_n"), F.sum(F.col("v") * F.col("c")).alias("_total"), F.sum(m * F.col("c")).alias("_chars"),
        F.max((-F.col("v") - mean * m) / F.sqrt(m)).alias("_peak"))
    added = {f.name for f in ADDED}
    return coded.join(found, ["_digest", "_code"], "left").select(
        *[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added],
        F.coalesce("_n", F.lit(0)).alias("n_words"), F.coalesce("_total", F.lit(0.0)).alias("log_likelihood"),
        F.exp(-F.col("_total") / F.col("_chars")).alias("perplexity"), F.col("_peak").alias("peak"))


def score_documents(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang") -> DataFrame:
    """``docs`` with ``n_words, log_likelihood, perplexity, peak``."""
    if model.unseen and not model.grams:
        return _joined_scores(docs, model, text, lang)
    sent = docs.sparkSession.sparkContext.broadcast(
        Model(model.order, model.grams, model.contexts, model.unseen, model.entropy))
    cache: dict = {}

    def compute(texts, langs):
        m = sent.value
        rows = m.texts([m.code(code) for code in langs.to_pylist()], texts.to_pylist(), cache)
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return [pa.array(cols[0], pa.int64()), *[pa.array(c, pa.float64()) for c in cols[1:]]]

    return append_columns(docs, [text, lang], ADDED, compute)


def thresholds(scored: DataFrame, trusted: DataFrame, model: Model, key: str = "doc_id", lang: str = "lang",
               perplexity_quantile: float = PERPLEXITY_QUANTILE, peak_quantile: float = PEAK_QUANTILE) -> dict:
    """language: (perplexity, peak) that the given shares of all its trusted rows of fold 1 stay below."""
    known = F.col(lang).isin([c for c in model.unseen if c != ALL])
    rows = scored.where(F.col("perplexity").isNotNull()).join(trusted.where("fold = 1").select(key), key).select(
        F.explode(F.array_distinct(F.array(F.when(known, F.col(lang)).otherwise(F.lit(ALL)), F.lit(ALL)))).alias("code"),
        "perplexity", "peak")
    found = rows.groupBy("code").agg(
        F.count("*").alias("n"), F.percentile_approx("perplexity", perplexity_quantile, 10_000).alias("perplexity"),
        F.percentile_approx("peak", peak_quantile, 10_000).alias("peak")).collect()
    return {r.code: (r.perplexity, r.peak) for r in found if r.n >= LEAST_ROWS or r.code == ALL}


def accepted(limits: dict, lang: str = "lang"):
    """Whether a scored row stays below the thresholds of its language."""
    def limit(i: int):
        out = F.lit(limits[ALL][i] if ALL in limits else math.inf)
        for code, values in limits.items():
            if code != ALL:
                out = F.when(F.col(lang) == code, F.lit(values[i])).otherwise(out)
        return out

    return F.coalesce((F.col("perplexity") <= limit(0)) & (F.col("peak") <= limit(1)), F.lit(True))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
             **fit_options) -> tuple[DataFrame, Model, dict]:
    """``key, lang``, the scores and ``kept`` of every row; the model and the thresholds."""
    trusted = land(trusted_rows(labels, key))
    model = fit(docs, trusted, key, text, lang, **fit_options)
    scored = land(score_documents(docs.select(key, lang, F.col(text).alias("_text")), model, "_text", lang).drop("_text"))
    limits = thresholds(scored, trusted, model, key, lang)
    return scored.withColumn("kept", accepted(limits, lang)), model, limits


def keep_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                   lang: str = "lang", **fit_options) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with the columns of ``docs``.

    The texts are scored where they lie, once for the thresholds and once to filter; they are not shuffled.
    """
    _, model, limits = classify(docs, labels, key, text, lang, **fit_options)
    clash = {f.name.lower() for f in ADDED} & {c.lower() for c in docs.columns}
    renamed = docs.withColumnsRenamed({c: f"_own_{c}" for c in docs.columns if c.lower() in clash})
    kept = score_documents(renamed, model, text, lang).where(accepted(limits, lang))
    return kept.select(*[F.col(f"`_own_{c}`" if c.lower() in clash else f"`{c}`").alias(c) for c in docs.columns])
