import numpy as np

from fleetlens.llm import pseudo_likelihood as P
from tests.llm.helpers import corpus, docs_of


def test_windows():
    owner, context, target = P.windows([np.array([1, 2, 3]), np.array([], int), np.array([4])])
    e = P.IDS
    assert owner.tolist() == [0, 0, 0, 2] and target.tolist() == [1, 2, 3, 4]
    assert context.tolist() == [[e, e, 2, 3], [e, 1, 3, e], [1, 2, e, e], [e, e, e, e]]


def test_probabilities_sum_to_one():
    net = P.Network()
    total = np.exp(net.log_probabilities(np.tile([[5, 9, 100, P.IDS]], (P.IDS, 1)), np.arange(P.IDS)).astype(np.float64)).sum()
    assert abs(total - 1) < 1e-3


def test_a_step_goes_down_the_loss():
    rng = np.random.default_rng(1)
    context, target = rng.integers(0, P.IDS, (64, 2 * P.SIDE)), rng.integers(0, P.IDS, 64)
    net, squares = P.Network(), np.full(P.Network.SIZE, 1e-4, np.float32)
    before = net.log_probabilities(context, target).mean()
    for _ in range(5):
        net.step(context, target, squares, 0.1)
    assert net.log_probabilities(context, target).mean() > before + 0.5


def test_learns_both_sides_and_scores_like_the_whole(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)]
    texts = []
    for i in range(300):  # each word follows from its neighbours
        at = int(rng.integers(40))
        texts.append((i, " ".join(words[(at + k) % 40] for k in range(60))))
    docs = docs_of(spark, texts)
    frequent = P.frequent_words(docs)
    assert len(frequent) == 40
    encoded = P.encode_documents(docs.select("doc_id", "text"), frequent).drop("text").cache()
    net = P.train(encoded, rounds=4, stride=1, batch_words=64)
    rows = [np.frombuffer(r.ids, np.uint16) for r in encoded.orderBy("doc_id").limit(20).collect()]
    score = lambda rs: net.log_probabilities(*P.windows(rs)[1:]).mean()
    assert score(rows) > score([rng.permutation(r) for r in rows]) + 0.3
    assert score(rows) > -np.log(40) + 0.3  # better than word counts
    scored = {r.doc_id: r for r in P.score_encoded(encoded, net).collect()}
    for i, r in enumerate(rows):
        own = net.log_probabilities(*P.windows([r])[1:])
        assert scored[i].n_words == 60 and abs(scored[i].log_prob - own.sum()) < 1e-2
        assert abs(scored[i].mean_log_prob - own.mean()) < 1e-3


def test_odd_rows(spark):
    texts = corpus() + [(None, "x y"), (3, "again")]
    rows = P.score_documents(docs_of(spark, texts), rounds=1).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.mean_log_prob is None) == (r.n_words == 0) and r.log_prob <= 0
    assert P.score_documents(docs_of(spark, [(1, "x")]).limit(0), rounds=1).count() == 0
    assert [r.n_words for r in P.score_documents(docs_of(spark, [(1, None)]), rounds=1).collect()] == [0]


def test_every_word_is_a_target_once(spark):
    texts = [np.arange(n) for n in (1, 2, 3, 0, 31, 700)]
    times = sum(P.turns(texts, k, P.ROUNDS).astype(int) for k in range(P.ROUNDS))
    assert (times == 1).all() and len(times) == 737


def test_production_parameters_learn_short_texts(spark):
    # The pair of a text stands at its end, which rounds of one word in 32 of a slice seldom reach.
    texts = [(i, "a b" if i % 2 else "c d") for i in range(4000)]
    docs = docs_of(spark, texts)
    encoded = P.encode_documents(docs.select("doc_id", "text"), P.frequent_words(docs)).drop("text").cache()
    net = P.train(encoded)
    _, context, target = P.windows([np.frombuffer(r.ids, np.uint16) for r in encoded.limit(10).collect()])
    start = P.Network().log_probabilities(context, target).mean()
    assert net.log_probabilities(context, target).mean() > start + 3


def test_ties_fill_the_vocabulary(spark):
    texts = [(i, " ".join(f"w{j}" for j in range(i, 5000, 50))) for i in range(50)] + [(50, "often often more more")]
    frequent = P.frequent_words(docs_of(spark, texts))
    rest = sorted(P._hash(f"w{j}") for j in range(5000))
    assert len(frequent) == P.OWN_IDS
    assert list(frequent) == sorted([P._hash("often"), P._hash("more")]) + rest[:P.OWN_IDS - 2]


def test_shared_ids_score_each_word_by_its_counts(spark):
    common = " ".join(f"w{j}" for j in range(P.OWN_IDS))
    rare = [f"rare{j}" for j in range(3000)]
    texts = [(0, common), (1, common), (2, common)] + [(10 + i, " ".join(rare[i::30])) for i in range(30)]
    texts += [(50, "rare7 rare7"), (51, None), (52, "rare7 rare8"), (52, "rare7 rare8")]
    docs, n = docs_of(spark, texts), {w: 1 for w in rare} | {"rare7": 5, "rare8": 3}
    frequent = P.frequent_words(docs)
    slot = lambda w: P._hash(w) % (P.IDS - P.OWN_IDS)
    shared = [w for w in [*n, *common.split()] if P._hash(w) not in frequent]
    count = lambda w: n.get(w, 3)
    total = {}
    for w in shared:
        total[slot(w)] = total.get(slot(w), 0) + count(w)
    net = P.Network()  # nothing is learnt in rounds=0
    ids = P.Ids(frequent)
    for sent in (0, 100_000):  # joined or sent: the same scores
        got = {r.doc_id: r for r in P.score_documents(docs, rounds=0, sent=sent).collect()}
        for i, t in texts:
            words = (t or "").split()
            if words:
                own = net.log_probabilities(*P.windows([np.array([ids[w] for w in words])])[1:]).sum()
                own += sum(np.log(count(w) / total[slot(w)]) for w in words if w in shared)
                assert got[i].n_words == len(words) and abs(got[i].log_prob - own) < 1e-2 + 1e-5 * abs(own)
                assert abs(got[i].mean_log_prob - own / len(words)) < 1e-3
            else:
                assert got[i].n_words == 0 and got[i].mean_log_prob is None


def test_a_word_is_looked_up_once_a_task(monkeypatch):
    hashed = []
    plain = P._hash
    monkeypatch.setattr(P, "_hash", lambda w: hashed.append(w) or plain(w))
    frequent = {plain("a"): 0, plain("b"): 7}
    codes = np.array(sorted(map(plain, ["a", "c", "d"])))
    logs = np.log(np.array([0.5, 0.25, 0.125]))
    words = P.Words(frequent, codes, logs)
    texts = [["a", "c", "x", "a"], [], ["b", "d", "x", "c"], ["c"]]
    for k in range(2):
        at = words.places(texts, 9)
        share = [0, logs[codes == plain("c")][0], np.nan, 0, 0, logs[codes == plain("d")][0], np.nan] + [logs[codes == plain("c")][0]] * 2
        own = len(hashed)
        ids = P.Ids(frequent)
        assert words.ids[at].tolist() == [ids[w] for t in texts for w in t]
        assert words.codes[at].tolist() == [plain(w) for t in texts for w in t]
        assert np.array_equal(words.logs[at], share, equal_nan=True)
        if k == 0:
            assert own == 5
            monkeypatch.setattr(P.Ids, "LIMIT", 3)  # what is known goes, and comes back the same
    none = P.Words({}, np.empty(0, np.int64), np.empty(0))
    assert none.places([], 0).tolist() == [] and none.places([["a"]], 1).tolist() == [0] and np.isnan(none.logs).all()


def test_a_step_is_the_descent_of_the_plain_network():
    rng = np.random.default_rng(5)
    for scale in (1, 300):  # logits that need no shift, and such that do
        context, target = rng.integers(0, P.IDS + 1, (300, 2 * P.SIDE)), np.minimum(rng.geometric(0.01, 300), P.IDS - 1)
        net = P.Network(seed=4)
        net.flat *= scale
        old = P.Network(net.flat)
        p = {k: v.astype(np.float64) for k, v in old.p.items()}

        def loss(p):
            x = np.concatenate([p["E"][context].reshape(300, -1), np.ones((300, 1))], axis=1)
            h = np.concatenate([np.tanh(x @ p["W"]), np.ones((300, 1))], axis=1)
            of, within = np.divmod(target, P.PER_CLASS)
            out = 0
            for z, at in ((h @ p["C"], of), (np.einsum("nh,nhk->nk", h, p["O"][of]), within)):
                z = z - z.max(1, keepdims=True)
                out = out + z[np.arange(300), at] - np.log(np.exp(z).sum(1))
            return out

        whole = loss(p)
        assert np.allclose(net.log_probabilities(context, target), whole, rtol=1e-4, atol=1e-3 * scale)
        if scale > 1:
            continue
        net.step(context, target, np.zeros(P.Network.SIZE, np.float32), 0.0)
        grad = net._spare["grad"].p
        for name, at in (("E", (context[3, 1], 2)), ("W", (5, 3)), ("W", (-1, 3)), ("C", (2, 1)), ("C", (-1, 1)), ("O", (0, 4, 9)), ("O", (1, -1, 7))):
            moved = {k: v.copy() for k, v in p.items()}
            moved[name][at] += 1e-5
            slope = -(loss(moved).mean() - whole.mean()) / 1e-5
            assert abs(grad[name][at] - slope) < 1e-5 + 1e-3 * abs(slope)
