import numpy as np
import pytest

from fleetlens.llm import html_extract as H

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def pages(spark):
    return [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect()]


@pytest.fixture(scope="module")
def labeller(pages):
    return H.train_labeller(pages[:100], composed=500, epochs=10)


def text(page):
    return [b.text for b in H.blocks_of(page)]


def test_blocks():
    assert text("<p>a &amp; b<br>c<p><b>d  <i>e</i>\n f<div>g</div>h&nbsp;&#x41;") == ["a & b c", "d e f", "g", "h A"]
    assert text("<!-- x <p> --><script>var a='<p>no</p>'</script><style>p{}</style><title>t</title><li>1<li>2<ul><li>3</ul>") == ["1", "2", "3"]
    assert text("1 < 2 <a href='x>y'>link</a> <b") == ["1 < 2 link"]
    assert text(None) == text("") == text("<p> \n</p>") == []
    assert text("<script>never closed <p>x") == [] and text("<p>kept<!-- open") == ["kept"]
    (block,) = H.blocks_of("<article id=main class='a  B-c'><p>x</article>")
    assert block.path == ("article main a b c", "p")
    assert H.blocks_of("<nav><a>all</a></nav>")[0].linked == 1.0
    assert len(H.blocks_of("<div>" * 3000 + "deep")) == 1


def test_silent_elements_end():
    assert text("<p>a<svg class='i'/>b<p>c<svg><g/></svg>d") == ["a b", "c d"]
    assert text("<p>a<svg><title/><svg><path></svg>no<style>x</style></svg>b<script>no</script><p>c") == ["a b", "c"]
    assert text("<div><p>a<object><object>no</object>no</object>b</p></div>c") == ["a b", "c"]
    assert text("<div><p>a<button>no</p><p>b</p></div>c") == ["a", "b", "c"]
    assert text("<div>a<select><option>no<option>no</div>b<div>c<object><p>no</div>d") == ["a", "b", "c", "d"]
    assert text("<p>a<button><div>no</div></button>b<noscript><p>no</noscript>") == ["a b"]
    assert [b.path for b in H.blocks_of("<div><p>a<video>no")] == [("div", "p")]


def test_features_read_whole_blocks():
    words = [f"w{i}" for i in range(64)]
    same, other = (H.features([H.Block((), " ".join([*words, *tail]), 0.0)]) for tail in (["end"] * 40, ["last"] * 40))
    assert (same != other).any()
    few, many = (H.features([H.Block((), "a" * 200 + tail, 0.0)]) for tail in ("b" * 100, "7" * 100))
    assert (few != many).any()


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = H.Labeller(5, hidden=3, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = H._padded([rng.standard_normal((n, 5)).astype(np.float32) for n in (4, 2)])
    y = rng.integers(0, 2, mask.shape[:2]).astype(np.float64)
    w = mask[:, :, 0].astype(np.float64)

    def loss():
        z = net.logits(x, mask)
        return float((w * (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z)).sum() / w.sum())

    grads = net.gradients(x, mask, y, w)
    for name, value in net.p.items():
        for at in list(np.ndindex(value.shape))[::7]:
            old = value[at]
            value[at] = old + 1e-4
            up = loss()
            value[at] = old - 1e-4
            down = loss()
            value[at] = old
            assert abs((up - down) / 2e-4 - grads[name][at]) < 1e-3, (name, at)


def test_held_out_pages(pages, labeller):
    blocks = [H.blocks_of(p) for p in pages[100:]]
    wrong = sum(bool((got != [H.marked(b) is True for b in page]).any())
                for page, got in zip(blocks, labeller.label(blocks), strict=True))
    assert wrong == 0


def test_held_out_layouts(pages, labeller):
    rng, n, right = np.random.default_rng(77), 0, 0
    pool = [b for p in pages[:100] for b in H.blocks_of(p)]
    for _ in range(200):
        blocks, labels = H.compose(pool, rng)
        n, right = n + len(blocks), right + int((labeller.label([blocks])[0] == (labels > 0)).sum())
    assert right / n > 0.95


def test_labels_do_not_depend_on_the_batch(pages, labeller):
    some = [H.blocks_of(p) for p in pages[100:130]] + [[]]
    alone = [labeller.label([b])[0] for b in some]
    assert all((a == b).all() for a, b in zip(labeller.label(some), alone, strict=True))


def test_rows(spark, labeller):
    page = "<body><nav><a>Home</a></nav><article><h1>T &lt; U</h1><p>First  line.</p></article><footer>&copy; x</footer>"
    df = spark.createDataFrame([(1, "u", page, "old"), (1, "u", page, "old"), (None, None, None, None), (2, "v", "", "old"),
                                (3, "w", "<article>" + "<p>Some words here.</p>" * 4000 + "</article>", "x")],
                               "page_id long, url string, html string, text string")
    rows = H.extract_text(df, labeller).collect()
    assert sorted((r.page_id or 0, r.text[:30], r.n_chars) for r in rows) == [
        (0, "", 0), (1, "T < U\nFirst line.", 17), (1, "T < U\nFirst line.", 17), (2, "", 0),
        (3, "Some words here.\nSome words he", 17 * 4000 - 1)]
    assert H.extract_text(df.limit(0), labeller).count() == 0


def test_training_without_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    labeller = H.fit_labeller(empty, composed=20, epochs=1)
    assert labeller.label([[]])[0].size == 0
