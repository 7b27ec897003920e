import random

import numpy as np

from fleetlens.llm import line_dedup as L
from tests.llm.helpers import corpus, docs_of, link


def brute(texts):
    """(id, line numbers removed) by comparing all pairs of lines."""
    places = {}
    for i, t in texts:
        for k, raw in enumerate((t or "").split("\n")):
            line = " ".join(raw.split()).lower()
            if i is not None and len(line) >= L.SHINGLE:
                places.setdefault(line, []).append((i, k))
    sets = {x: {x[j:j + L.SHINGLE] for j in range(len(x) - L.SHINGLE + 1)} for x in places}
    lines = list(places)
    pairs = [(a, b) for i, a in enumerate(lines) for b in lines[:i] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    group = link(pairs, lines)
    gone = {}
    for root in set(group.values()):
        for i, k in sorted({p for x in lines if group[x] == root for p in places[x]})[1:]:
            gone.setdefault(i, set()).add(k)
    return gone


def test_against_brute_force(spark):
    rng = random.Random(5)
    texts = corpus(seed=2)
    base = texts[1][1].split("\n")[0]
    for i in range(30):  # a large group of near copies of one line
        words = base.split(" ")
        words[rng.randrange(len(words))] = f"v{i}"
        texts.append((500 + i, " ".join(words) + "\nshort\n\n" + base.upper()))
    texts += [(None, base), (510, None)]
    gone = brute([(i, t) for i, t in texts if (i, t) != (510, None)])
    rows = L.dedup_lines(docs_of(spark, texts)).collect()
    assert len(rows) == len(texts)
    own = dict(texts[:-1])
    for r in rows:
        if r.doc_id is not None and (r.text is not None or r.doc_id != 510):
            lines = (own[r.doc_id] or "").split("\n")
            away = gone.get(r.doc_id, set())
            assert (r.kept_text or "") == "\n".join(x for k, x in enumerate(lines) if k not in away), r.doc_id
            assert r.n_lines == sum(1 for x in lines if x.strip())
        elif r.doc_id is None:
            assert r.kept_text == base and r.n_removed == 0


def test_recall_of_bands():
    rng = random.Random(3)
    for low, least in ((0.8, 0.97), (0.86, 0.995)):
        hits = n = 0
        while n < 250:
            a = "".join(rng.choice("abcdefgh ") for _ in range(rng.choice([40, 120, 400])))
            b = list(a)
            for _ in range(rng.randint(1, max(1, len(a) // 40))):
                b[rng.randrange(len(b))] = "#"
            b = "".join(b)
            x, y = L.shingle_set(a), L.shingle_set(b)
            both = len(np.intersect1d(x, y))
            if low <= both / (len(x) + len(y) - both) < low + 0.05:
                keys = L.band_keys(L.signatures([a, b]))
                n, hits = n + 1, hits + bool((keys[0] == keys[1]).any())
        assert hits / n >= least


def test_signatures_do_not_depend_on_neighbours():
    lines = ["abcdefgh", "the quick brown fox jumps", "abcdefghi" * 50, "日本語のテキストです。長い"]
    alone = np.concatenate([L.signatures([x]) for x in lines])
    assert (L.signatures(lines) == alone).all() and (alone < 1 << 32).all()


def test_empty_table(spark):
    assert L.dedup_lines(docs_of(spark, [(1, "x")]).limit(0)).count() == 0


def test_equal_short_lines(spark):
    texts = [(1, "Menu\n\n-----\na whole line of text"), (2, "menu \nother\n\n-----"), (3, "Next\n \nMENU"), (None, "Menu")]
    kept = {r.doc_id: (r.n_removed, r.kept_text) for r in L.dedup_lines(docs_of(spark, texts), short_lines=True).collect()}
    assert kept == {1: (0, texts[0][1]), 2: (2, "other\n"), 3: (1, "Next\n "), None: (0, "Menu")}


def test_different_texts_of_one_id_keep_their_own_lines(spark):
    first, second = "a line that stands in both of them", "a line of the second text alone"
    texts = [(1, first + "\nother words of the first row"), (1, second + "\n" + first), (1, second + "\n" + first), (2, first)]
    rows = L.dedup_lines(docs_of(spark, texts)).collect()
    by_text = {}
    for r in rows:
        by_text.setdefault((r.doc_id, r.text), set()).add(r.kept_text)
    assert len(rows) == 4 and all(len(kept) == 1 for kept in by_text.values())
    kept = {k: next(iter(v)) for k, v in by_text.items()}
    assert sorted(x for t in kept.values() for x in t.split("\n") if x) == sorted([first, second, "other words of the first row"])
    # Nothing that stands once is lost, whichever row keeps the shared line.
    assert second in kept[texts[1]] and "other words" in kept[texts[0]]


def test_signatures_of_many_lines_take_bounded_memory():
    import tracemalloc

    lines = [f"{i:>40} {i * 7919:>40}" for i in range(20_000)]
    L.signatures(lines[:10])
    tracemalloc.start()
    made = L.signatures(lines)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * made.nbytes
    assert (made[[0, 9_999, 19_999]] == L.signatures([lines[i] for i in (0, 9_999, 19_999)])).all()
