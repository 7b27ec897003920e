import math
import random

import pytest

from fleetlens.llm import kneser_ney as K
from tests.llm.helpers import corpus, docs_of

LABELS = "doc_id long, quality int, toxic int"
SYLLABLES = {"en": "the and ing er tion at on re".split(), "de": "sch ein ung lich ber ver".split()}


def prose(rng, lang, words=120):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(words))


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        lang, bad = ("en", "de")[i % 2], i % 10 == 9
        text = prose(rng, lang)
        if bad:
            words = text.split(" ")
            words[rng.randrange(len(words))] = "xqzvwk"
            text = " ".join(words)
        rows.append((i, text, lang))
        if i % 4 != 3:
            labels.append((i, 1, int(bad)))
    rows += [(900, None, "en"), (901, "", "en"), (902, prose(rng, "en"), None), (903, prose(rng, "de"), "xx"), (None, prose(rng, "en"), "en"),
             (904, "qqq " * 3000, "en"), (0, rows[0][1], "en")]
    labels += [(0, 1, 0), (2, 0, 0), (2, 1, 0), (None, 1, 0), (4, None, None)]
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, lang string, n_words long, kept string").repartition(3)
    return docs, spark.createDataFrame(labels, LABELS)


def test_trusted_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 0), (4, 1, 0), (4, 0, 0), (5, 1, None), (None, 1, 0), (6, None, 0)], LABELS)
    assert sorted(r.doc_id for r in K.trusted_rows(labels).collect()) == [1, 5]


def test_probabilities_sum_to_one_after_every_history(spark, world):
    docs, labels = world
    model = K.fit(docs, K.trusted_rows(labels), order=3)
    for code in ("en", "de", K.ALL):
        grams, contexts = model.grams[code], model.contexts[code]
        chars = [g for g in grams if len(g) == 1]
        for history in sorted(c for c in contexts if len(c) == 2)[:25]:
            total = 0.0
            for c in [*chars, "unseen"]:
                gram, weight = (history + c, 0.0) if c != "unseen" else (history + "\x00", 0.0)
                p = grams.get(gram)
                while p is None:
                    weight += contexts.get(gram[:-1], 0.0)
                    gram = gram[1:]
                    p = grams.get(gram) if gram else model.unseen[code]
                total += math.exp(weight + p)
            assert abs(total - 1) < 1e-6


def test_counts_and_continuations(spark):
    docs = spark.createDataFrame([("ab ab", "x"), ("b", "x"), (None, "x")], "text string, lang string")
    counts = {(r.lang, r.gram): r.c for r in K.ngram_counts(docs, 2).collect()}
    assert counts == {(g, k): n for g in ("x", "*") for k, n in {"\x02a": 2, "ab": 2, "b\x03": 3, "\x02b": 1}.items()}
    higher = spark.createDataFrame([(*k, n) for k, n in counts.items()], "lang string, gram string, c long")
    assert {(r.lang, r.gram): r.c for r in K.continuation_counts(higher).collect() if r.lang == "x"} == {
        ("x", "a"): 1, ("x", "b"): 2, ("x", "\x03"): 1}


def test_catches_strange_words_and_keeps_the_rest(spark, world):
    docs, labels = world
    judged, _, limits = K.classify(docs, labels)
    rows = {r.doc_id: r for r in judged.collect()}
    assert set(limits) == {"en", "de", K.ALL}
    bad = [i for i in range(400) if i % 10 == 9]
    good = [i for i in range(400) if i % 10 != 9]
    assert sum(not rows[i].kept for i in bad) >= 0.95 * len(bad)
    assert sum(rows[i].kept for i in good) >= 0.93 * len(good)
    assert rows[900].kept and rows[900].perplexity is None and rows[901].kept and rows[901].n_words == 0
    assert not rows[904].kept and rows[902].perplexity > 1 and rows[903].perplexity > 1


def test_filter_keeps_columns(spark, world):
    docs, labels = world
    kept = K.keep_documents(docs, labels)
    assert kept.columns == docs.columns and {r.n_words for r in kept.select("n_words").distinct().collect()} == {5}
    judged, _, _ = K.classify(docs, labels)
    assert kept.count() == judged.where("kept").count()


def test_a_bound_on_the_model_lowers_its_order(spark, world):
    docs, labels = world
    model = K.fit(docs, K.trusted_rows(labels), model_rows=300)
    assert model.order < K.ORDER and model.grams["en"]


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], LABELS)
    judged, _, _ = K.classify(docs_of(spark, corpus()), none)
    assert all(r.kept for r in judged.collect())
    assert K.classify(docs_of(spark, [(1, "x")]).limit(0), none)[0].count() == 0


def test_every_trusted_document_is_counted(spark):
    """Each of more trusted documents than an earlier form read has a word of its own, so it leaves an n-gram of its own."""
    n = 9_000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('ab ', lpad(hex(id), 4, '0')) AS text", "'en' AS lang")
    labels = spark.range(n).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    trusted = K.trusted_rows(labels)
    fitted = docs.join(trusted.where("fold = 0"), "doc_id")
    model = K.fit(docs, trusted, order=5)
    own = {r.text[3:] + "\x03" for r in fitted.collect()}
    assert len(own) > 4_000 and own <= set(model.grams["en"])


def test_a_model_too_large_to_send_scores_the_same(spark, world):
    docs, labels = world
    trusted = K.trusted_rows(labels)
    sent, joined = K.fit(docs, trusted), K.fit(docs, trusted, sent_rows=0)
    assert sent.grams and not joined.grams and sent.order == joined.order == K.ORDER
    columns = ["doc_id", "lang", "kept", "n_words", "log_likelihood", "perplexity", "peak"]
    order = lambda r: (r.doc_id is None, r.doc_id or 0)
    a, b = (sorted(K.score_documents(docs, m).select(columns).collect(), key=order) for m in (sent, joined))
    assert len(a) == len(b) == docs.count()
    for x, y in zip(a, b, strict=True):
        assert tuple(x)[:4] == tuple(y)[:4]
        assert all(u == v or math.isclose(u, v, rel_tol=1e-9) for u, v in zip(tuple(x)[4:], tuple(y)[4:], strict=True))


def test_words_cost_what_their_characters_cost(spark, world):
    docs, labels = world
    model = K.fit(docs, K.trusted_rows(labels))
    words = ["the", "schung", "xqzvwk", "ü", "a\x00b", "\x02\x03"]
    for code in ("en", K.ALL):
        for word, found in zip(words, model.words(code, words), strict=True):
            padded, total = "\x02" * (model.order - 1) + word + "\x03", 0.0
            for i in range(len(word) + 1):
                gram = padded[i:i + model.order]
                p = model.grams[code].get(gram)
                while p is None:
                    total += model.contexts[code].get(gram[:-1], 0.0)
                    gram = gram[1:]
                    p = model.grams[code].get(gram) if gram else model.unseen[code]
                total += p
            assert math.isclose(total, found, rel_tol=1e-12)
