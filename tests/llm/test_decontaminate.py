import re

from fleetlens.llm import decontaminate as D
from tests.llm.helpers import corpus, docs_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, body in items:
        b = words(body)
        if not b or item is None:
            continue
        k = min(13, len(b))
        wins = {tuple(b[i:i + k]) for i in range(len(b) - k + 1)}
        for i in range(len(w) - k + 1):
            if tuple(w[i:i + k]) in wins:
                found.add(str(item))
                hit.update(range(i, i + k))
    return len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)


def test_against_brute_force(spark):
    texts = corpus()
    long = texts[3][1].upper()
    items = [(1, texts[0][1][:200]), (2, "Changed!"), (3, None), (4, ""), (5, long), (5, long), (None, "x"), (10, "テキスト")]
    texts += [(900, "before -- " + long + " after"), (901, "a changed,b"), (900, "before -- " + long + " after"), (None, "changed")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    size = sum(len((t or "").encode()) for _, t in items)
    expected = sorted((i is None, i or 0, *brute(t, items)) for i, t in texts)
    for limit in (D.AUTOMATON_BYTES, size // 3):  # one automaton, and several passes
        found = D.find_contamination(docs_of(spark, texts), bench, automaton_bytes=limit).withColumn("bad", D.contaminated())
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r.hit_items, r.bad)
                      for r in found.collect()) == expected


def test_spans_are_of_the_original(spark):
    text = "Ünd: (ALPHA,beta;; gamma) – ende ALPHA beta-gamma."  # the dash is a word
    bench = spark.createDataFrame([(1, "alpha BETA gamma")], "item_id long, text string")
    row = D.find_contamination(docs_of(spark, [(1, text)]), bench).first()
    assert [text[s.start:s.end] for s in row.hit_spans] == ["ALPHA,beta;; gamma", "ALPHA beta-gamma"]
    assert row.n_hit == 6 and row.n_words == 9


def test_filter_keeps_columns_and_clean_rows(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = docs_of(spark, [(1, "alpha beta gamma"), (2, "alpha beta"), (3, None), (4, "alpha beta gamma " + "w " * 100)])
    kept = D.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4] and {r.n_words for r in kept.collect()} == {7}


def test_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in D.find_contamination(docs_of(spark, [(1, "a b")]), bench).collect()] == [0]
    assert D.find_contamination(docs_of(spark, [(1, "a")]).limit(0), bench).count() == 0
