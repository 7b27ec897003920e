import random
import re

import pytest

from fleetlens.llm import license_scan as L
from tests.llm.helpers import corpus, docs_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text):
    w = words(text)
    places = [(i, label) for phrase, label in L.BASE.items() for i in range(len(w))
              if w[i:i + phrase.count(" ") + 1] == phrase.split()]
    at = [i for i, _ in places]
    return (len(w), len(places), min(at, default=None), max(at, default=None), sorted({x for _, x in places}))


def notices(rng):
    return " ".join(rng.choice(["CC", "by", "cc BY-nc", "General", "Public", "License", "all rights reserved", "All", "MIT license", "or", "é"])
                    for _ in range(rng.randint(1, 60)))


def test_base_against_brute_force(spark):
    rng = random.Random(5)
    texts = corpus() + [(700 + i, notices(rng)) for i in range(60)] + [(990, "cc by " * 30_000), (None, "CC-BY"), (700, "cc by")]
    rows = L.scan_licenses(docs_of(spark, texts)).collect()
    assert len(rows) == len(texts)

    def key(r):
        return str(r)

    assert sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows), key=key) == \
        sorted(((i, *brute(t)) for i, t in texts), key=key)
    for r in rows:
        assert set(r.base_labels) <= set(r.labels) and r.labels == sorted(set(r.labels)) and 0 <= r.score <= 1
        assert r.comp == 8 and r.node == 9  # other columns pass


def value(expression):
    term, valid = L.evaluate(re.findall(r"[()]|[^\s()]+", expression))
    return (sorted(term.labels), sorted(term.effective), round(term.weight, 6), valid) if term else (None, valid)


def test_expressions_bind_in_order():
    assert value("MIT OR GPL-2.0-only AND Apache-2.0") == (["apache", "gpl", "mit"], ["mit"], 0.2, True)
    assert value("(MIT OR GPL-2.0+) AND AGPL-3.0-or-later") == (["agpl", "gpl", "mit"], ["agpl", "mit"], 0.8, True)
    assert value("GPL-2.0-only WITH Classpath-exception-2.0 OR Foo") == (["gpl", "other"], ["gpl"], 0.5, True)
    assert value("((MIT") == (["mit"], ["mit"], 0.2, False)
    assert value("MIT OR") == (["mit"], ["mit"], 0.2, False)
    assert value("MIT AND (") == (["mit"], ["mit"], 0.2, False)
    assert value("OR MIT") == (None, False) and value("") == (None, False)
    assert value("MIT ) OR GPL") == (["mit"], ["mit"], 0.2, False)
    assert value("(" * 5000 + "MIT" + ")" * 5000) == (["mit"], ["mit"], 0.2, True)


def test_evaluation_against_the_grammar():
    """Random trees, written out with brackets, have the value that the tree has."""
    rng = random.Random(2)
    ids = ["MIT", "GPL-3.0", "LGPL-2.1", "CC-BY-NC-4.0", "Apache-2.0"]

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            name = rng.choice(ids)
            label = L.label_of(name)
            return name, (frozenset([label]), frozenset([label]), L.WEIGHTS[label])
        (a, x), (b, y) = tree(depth - 1), tree(depth - 1)
        if rng.random() < 0.5:
            return f"( {a} ) AND ( {b} )", (x[0] | y[0], x[1] | y[1], max(x[2], y[2]))
        low = min((x, y), key=lambda t: (t[2], sorted(t[1])))
        return f"( {a} ) OR ( {b} )", (x[0] | y[0], low[1], low[2])

    for _ in range(300):
        text, (labels, effective, weight) = tree(4)
        assert value(text) == (sorted(labels), sorted(effective), round(weight, 6), True)


@pytest.mark.parametrize("text, labels, score, found", [
    ("# SPDX-License-Identifier: MIT OR Apache-2.0\ncode", ["apache", "mit"], 0.2, ["MIT OR Apache-2.0"]),
    ("/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) AND MIT */", ["gpl", "mit"], 0.5,
     ["( GPL-2.0-only WITH Linux-syscall-note ) AND MIT"]),
    ('{"license": "MIT", "x": 1}', ["mit"], 0.2, ["MIT"]),
    ("License: see the file", [], 0.0, []),
    ("Licensed under the MIT License or the GNU General Public License, version 3.", ["gpl", "mit"], 0.2, ["mit or gpl"]),
    ("Released under the MIT License.", ["mit"], 0.2, []),
    ("Licensed under CC BY-NC 4.0.", ["cc-by", "cc-by-nc"], 0.9, []),
    ("GNU Affero General Public License", ["agpl", "gpl"], 0.8, []),
    ("é SPDX-License-Identifier: LicenseRef-Mine", ["other"], 1.0, ["LicenseRef-Mine"]),
])
def test_notices_and_tags(text, labels, score, found):
    row = dict(zip(L.ADDED.names, L.scan(text), strict=True))
    assert (row["labels"], [e["expression"] for e in row["expressions"]]) == (labels, found)
    assert row["score"] == pytest.approx(score)


def test_spans_are_of_the_original():
    text = "ñ – (MIT   License), then\nALL-rights RESERVED."
    row = dict(zip(L.ADDED.names, L.scan(text), strict=True))
    assert [(n["label"], text[n["start"]:n["end"]]) for n in row["notices"]] == [
        ("mit", "MIT   License"), ("reserved", "ALL-rights RESERVED")]


def test_empty_table(spark):
    assert L.scan_licenses(docs_of(spark, [(1, "a")]).limit(0)).count() == 0
