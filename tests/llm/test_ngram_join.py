import random
import re

import numpy as np

from fleetlens.llm import ngram_join as J
from tests.llm.helpers import corpus, docs_of, link, sentence


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    sets = [shingles(t) for _, t in texts]
    ids = [i for i, _ in texts]
    pairs = [(ids[a], ids[b]) for a in range(len(ids)) for b in range(a) if ids[a] is not None and ids[b] is not None
             and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    group = link(pairs, {i for i in ids if i is not None})
    return sorted((-1 if i is None else i, len(s), group.get(i, -1)) for i, s in zip(ids, sets, strict=True))


def test_against_brute_force(spark):
    rng = random.Random(9)
    texts = corpus(seed=4)
    base = sentence(rng, 200).split(" ")
    for i in range(60):  # a large group of near copies: some link only through others
        words = list(base)
        for _ in range(rng.randint(0, 8)):
            words[rng.randrange(len(words))] = f"w{rng.randint(0, 30)}"
        texts.append((300 + i, " ".join(words)))
    chain = list(base[:100])
    for i in range(12):  # a chain whose ends have nothing in common
        chain[i * 8:i * 8 + 3] = [f"c{i}", f"d{i}", f"e{i}"]
        texts.append((400 + i, " ".join(chain)))
    texts += [(None, texts[0][1]), (7, texts[7][1]), (450, "one two\tTHREE"), (451, "One  two three")]
    rows = J.link_documents(docs_of(spark, texts)).collect()
    assert sorted((-1 if r.id is None else r.id, r.n_shingles, -1 if r.component_id is None else r.component_id)
                  for r in rows) == brute(texts)


def test_few_frequent_tokens_give_the_same(spark):
    texts = corpus(seed=6)
    for frequent in (0, 5):
        rows = J.link_documents(docs_of(spark, texts), frequent=frequent).collect()
        assert sorted((r.id, r.n_shingles, r.component_id) for r in rows) == brute(texts)


def test_empty_table(spark):
    assert J.link_documents(docs_of(spark, [(1, "x")]).limit(0)).count() == 0
    assert [r.component_id for r in J.link_documents(docs_of(spark, [(1, None)])).collect()] == [1]


def test_components_of_hubs_and_paths(spark):
    from fleetlens.llm.linking import components

    rng = random.Random(1)
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(90)] + [(5000, 5000)]
    edges += [(rng.randint(2000, 2300), rng.randint(2000, 2300)) for _ in range(200)]
    rng.shuffle(edges)
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == link(edges, nodes | {5000}) | {5000: 5000} if 5000 in got else got == {
        n: c for n, c in link(edges, nodes | {5000}).items() if n != 5000}


def test_components_of_long_paths(spark):
    from fleetlens.llm.linking import components

    rng = random.Random(2)
    mixed = rng.sample(range(2000, 2300), 300)
    comb = [n for i in range(150) for n in (4000 + i, 5000 + i)]  # every second node is smaller than its neighbours
    edges = [(i, i + 1) for i in range(999)] + list(zip(mixed, mixed[1:], strict=False)) + list(zip(comb, comb[1:], strict=False))
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == link(edges, {n for e in edges for n in e})


def test_buckets_larger_than_a_block(spark):
    """A token that all sets share, near copies beyond a block, and sets just short of a link."""
    import numpy as np

    from fleetlens.llm.linking import buckets, link_buckets, parity_bits

    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 60).astype(np.uint64)
    sets = []
    for k in range(260):
        changed = int(rng.integers(0, 12)) if k % 2 else 3
        own = base.copy()
        own[rng.choice(np.arange(1, 60), changed, replace=False)] = rng.integers(0, 1 << 62, changed).astype(np.uint64)
        sets.append(np.unique(own[:int(rng.integers(30, 61))] if k % 5 == 0 else own))
    sets += [np.unique(np.append(base[:1], rng.integers(0, 1 << 62, 20).astype(np.uint64))) for _ in range(60)]
    rows = [(int(t.view(np.int64)), k, len(s), len(s) - i) for k, s in enumerate(sets) for i, t in enumerate(s)]
    bits = {k: parity_bits(s, 256) for k, s in enumerate(sets)}
    found = buckets(spark.createDataFrame(rows, "token long, node long, n long, left long").repartition(5))
    assert found.count() == sum(len(s) for s in sets) - sum(
        1 for c in np.unique(np.concatenate(sets), return_counts=True)[1] if c == 1)
    members = found.join(spark.createDataFrame([(k, bytearray(b)) for k, b in bits.items()], "node long, bits binary"), "node").select(
        "token", "node", "n", "left", "bits")
    pairs = [(b, a) for a in range(len(sets)) for b in range(a) if J.linked(sets[a], sets[b])]
    true = spark.createDataFrame(pairs, "a long, b long")
    asked = []

    def confirm(candidates):
        asked.append(candidates.count())
        return candidates.join(true, ["a", "b"], "left_semi")

    for block in (16, 2048):
        asked.clear()
        got = {r.node: r.comp for r in link_buckets(members, confirm, 80, block=block).collect()}
        expected = link(pairs, range(len(sets)))
        assert {k: got.get(k, k) for k in range(len(sets))} == expected
        assert sum(asked) < len(pairs) / 2  # a group of near copies doesn't become pairs


def test_sets_of_many_texts_are_those_of_each(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"W{i}" for i in rng.integers(0, 30, n)) for n in (0, 1, 4, 5, 6, 90, 3, 0, 5, 200, 2)] + [None, " \t\n", "a a a a a a a a"]

    def plain(text):
        words = text.lower().split() if text else []
        size = min(J.WIDTH, len(words))
        return len({tuple(words[i:i + size]) for i in range(len(words) - size + 1)}) if words else 0

    alone = [next(J.shingle_sets([t])) for t in texts]
    for at_once in (J.HASHED_WORDS, 7, 1):
        monkeypatch.setattr(J, "HASHED_WORDS", at_once)
        found = list(J.shingle_sets(iter(texts)))
        assert all(np.array_equal(x, y) for x, y in zip(found, alone, strict=True))
    assert [len(x) for x in alone] == [plain(t) for t in texts]
    assert all((x[1:] > x[:-1]).all() for x in alone)
    # The ranks are looked up once for all orders, which hold the same tokens where all are wanted.
    ranks = np.sort(alone[9][::3]), np.arange(len(alone[9][::3])) % 4
    ranked = J._ranked(alone[9], ranks)
    for factor in J.ORDERS:
        whole = J._ordered(*ranked, factor, len(alone[9]))
        assert np.array_equal(np.sort(whole), alone[9])
        level = [int(ranks[1][np.searchsorted(ranks[0], t)]) if t in ranks[0] else -1 for t in whole]
        assert level == sorted(level)
        for size in (1, 5, len(ranked[0]), len(ranked[0]) + 3):
            assert np.array_equal(J._ordered(*ranked, factor, size), whole[:size])
