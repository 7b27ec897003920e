"""HTML extraction: a recurrent labeller decides for every text block whether it is main text.

A page is cut into leaf blocks. Each block is read as its tag path (tags, classes, ids and roles,
hashed), its hashed words and a few figures; a bidirectional LSTM in numpy reads the whole sequence, so
every decision sees the whole page. It is trained on a bounded sample of the pages: where a page marks
its article by HTML's own elements, these give the labels; further pages of many layouts are composed
from the same blocks.

Character references are decoded, white space inside a block becomes one space, blocks are joined by a
line feed. Defined results: a null or empty page has an empty text; markup that isn't closed ends where
HTML lets it end, or with the page; repeated pages are extracted row by row; without any page that
marks its article the labeller learns from the composed layouts alone; columns of the input named
``text`` and ``n_chars`` are replaced.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import append_columns

#: Pages that the labeller is trained on, at most, and how long they may be.
TRAIN_PAGES = 300
TRAIN_CHARS = 100_000
COMPOSED = 900
EPOCHS = 14
BATCH = 32
#: Blocks that are labelled at a time, or one page.
BATCH_BLOCKS = 20_000
HIDDEN = 20
PATH_DIM, WORD_DIM, FIGURES = 96, 32, 8

#: Elements that never have content, end a block, or hold no text to read; as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table
tbody td tfoot th thead tr ul""".split()) - {"br"}
RAW = "script|style|textarea|title|iframe"
SILENT = frozenset("noscript template svg object select canvas audio video button".split())
#: Opening one of these ends an open element of the same set, up to the nearest container.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}}
SCOPES = frozenset("ul ol dl table tbody thead tfoot article section div main body nav aside".split())

_TOKEN = (
    r"""(?is)<!--.*?(?:-->|\Z)|<(%s)\b[^>]*>.*?(?:</\1\s*>|\Z)"""
    r"""|</?([a-z][a-z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/a-z][^>]*(?:>|\Z)|([^<]+|<)""")
TOKEN = re.compile(_TOKEN % RAW)
#: Inside of svg no element is raw text, so the first choice never matches.
FOREIGN = re.compile(_TOKEN % "(?!)")
NAMES = re.compile(r"""(?i)\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")

#: Elements whose text is or isn't the article where pages mark it, and names of other parts.
MAIN_TAGS = frozenset({"article", "main"})
OTHER_TAGS = frozenset({"nav", "header", "footer", "aside", "form", "fieldset", "dialog", "menu"})
OTHER_NAMES = frozenset("""ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie consent
footer form header login menu modal nav navbar navigation newsletter notice pagination popup promo related share
sharing sidebar signup social sponsor sponsored subscribe toolbar widget""".split())


class Block(NamedTuple):
    path: tuple[str, ...]
    text: str
    linked: float


def _names(attributes: str) -> list[str]:
    return [n for found in NAMES.findall(attributes) for n in re.split(r"[^a-z0-9]+", "".join(found).lower()) if n]


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    links = 0  # characters inside links of the open block
    silent = None  # where on the stack the outermost silent element stands
    tokens = TOKEN.finditer(page or "")

    def flush():
        nonlocal links
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(tuple(x for _, x in stack), text, min(1.0, links / len(text))))
        parts.clear()
        links = 0

    def leave(tags) -> None:
        for at in range(len(stack) - 1, -1, -1):
            if stack[at][0] in tags:
                del stack[at:]
                return
            if stack[at][0] in SCOPES:
                return

    while m := next(tokens, None):
        tag, attributes, text = m[2], m[3], m[4]
        if silent is not None:
            if tag is None:
                continue
            tag = tag.lower()
            if not m[0].startswith("</"):
                if tag not in VOID and not attributes.endswith("/"):
                    stack.append((tag, tag))
                continue
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if at is None:
                continue
            if at > silent:
                del stack[at:]
                continue
            # Its own end, or that of an element around it where it isn't closed.
            if stack[silent][0] == "svg":
                tokens = TOKEN.finditer(page, m.end())
            own = at == silent
            del stack[silent:]
            silent = None
            if own:
                continue
        if text is not None:
            text = entities.unescape(text)
            parts.append(text)
            if any(t == "a" for t, _ in stack):
                links += len(text.strip())
        elif m[1] is not None:
            if m[1].lower() == "title":
                continue
            parts.append(" ")
        elif tag is not None:
            tag = tag.lower()
            closing = m[0].startswith("</")
            if tag in BLOCK:
                flush()
            elif tag == "br":
                parts.append(" ")
            if closing:
                if any(t == tag for t, _ in stack):
                    while stack.pop()[0] != tag:
                        pass
                continue
            if tag in BLOCK:
                leave({"p", *CLOSES.get(tag, ())})
            if tag in SILENT:
                parts.append(" ")
            if tag not in VOID and not attributes.endswith("/"):
                if tag in SILENT:
                    silent = len(stack)
                    if tag == "svg":
                        tokens = FOREIGN.finditer(page, m.end())
                stack.append((tag, " ".join([tag, *_names(attributes)])))
    if silent is not None:
        del stack[silent:]
    flush()
    return out


def marked(block: Block) -> bool | None:
    """Whether a page's own elements mark the block as its article; null where they don't say."""
    inside = None
    for element in block.path:
        tag, *names = element.split(" ")
        if tag in MAIN_TAGS:
            inside = True
        elif tag in OTHER_TAGS or OTHER_NAMES.intersection(names):
            return False
    return inside


# ---- features -------------------------------------------------------------------------------------

def _slot(name: str, size: int) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % size


class _Slots(dict):
    """Word to slot, kept for the words of a task."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 500_000:
            self.clear()
        value = self[word] = _slot(word, WORD_DIM)
        return value


_WORD_SLOTS = _Slots()


def features(blocks: list[Block]) -> np.ndarray:
    x = np.zeros((len(blocks), PATH_DIM + WORD_DIM + FIGURES), np.float32)
    seen: dict[tuple, np.ndarray] = {}
    for i, b in enumerate(blocks):
        row = seen.get(b.path)
        if row is None:
            row = seen[b.path] = np.zeros(PATH_DIM, np.float32)
            for element in b.path:
                tag, *names = element.split(" ")
                row[_slot("<" + tag, PATH_DIM)] = 1
                for n in names:
                    row[_slot("." + n, PATH_DIM)] = 1
        x[i, :PATH_DIM] = row
        words = b.text.lower().split(" ")  # a fingerprint of the wording
        x[i, PATH_DIM:PATH_DIM + WORD_DIM] = np.bincount(
            [_WORD_SLOTS[w] for w in words], minlength=WORD_DIM) / (np.sqrt(len(words)) * 2)
        x[i, PATH_DIM + WORD_DIM:] = (
            np.log1p(len(b.text)) / 6, np.log1p(len(words)) / 4, b.linked, b.text[-1] in ".!?:;…\"'”»)",
            "©" in b.text, sum(map(str.isdigit, b.text)) / len(b.text),
            i / len(blocks), 1 / (1 + i))
    return x


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences as (time, row, feature) and a mask (time, row, 1)."""
    longest = max(map(len, rows))
    x = np.zeros((longest, len(rows), rows[0].shape[1]), np.float32)
    mask = np.zeros((longest, len(rows), 1), np.float32)
    for i, r in enumerate(rows):
        x[:len(r), i], mask[:len(r), i] = r, 1
    return x, mask


# ---- network --------------------------------------------------------------------------------------

def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Labeller:
    """A bidirectional LSTM with one output per block."""

    def __init__(self, inputs: int, hidden: int = HIDDEN, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p["W" + d] = (rng.standard_normal((inputs, 4 * hidden)) / np.sqrt(inputs / 4)).astype(np.float32)
            self.p["U" + d] = (rng.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            self.p["c" + d] = np.zeros(4 * hidden, np.float32)
            self.p["c" + d][hidden:2 * hidden] = 1  # remember at first
        self.p["V"] = (rng.standard_normal((2 * hidden, 1)) / np.sqrt(2 * hidden)).astype(np.float32)
        self.p["v"] = np.zeros(1, np.float32)

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        n = self.hidden
        steps = range(len(x)) if d == "f" else range(len(x) - 1, -1, -1)
        inputs = x @ self.p["W" + d] + self.p["c" + d]
        h = c = np.zeros((x.shape[1], n), np.float32)
        out, trace = np.zeros((len(x), x.shape[1], n), np.float32), {}
        for t in steps:
            z = inputs[t] + h @ self.p["U" + d]
            i, f, o, g = _sigmoid(z[:, :n]), _sigmoid(z[:, n:2 * n]), _sigmoid(z[:, 2 * n:3 * n]), np.tanh(z[:, 3 * n:])
            fresh = f * c + i * g
            m = mask[t]
            if keep:
                trace[t] = (h, c, i, f, o, g, np.tanh(fresh))
            h, c = m * (o * np.tanh(fresh)) + (1 - m) * h, m * fresh + (1 - m) * c
            out[t] = h
        return out, trace

    def logits(self, x, mask):
        both = np.concatenate([self._run(d, x, mask, False)[0] for d in "fb"], axis=2)
        return (both @ self.p["V"] + self.p["v"])[:, :, 0]

    def gradients(self, x, mask, target, weight):
        """Of the mean cross entropy; ``weight`` is zero where there is no label."""
        n, grads = self.hidden, {k: np.zeros_like(v) for k, v in self.p.items()}
        runs = {d: self._run(d, x, mask, True) for d in "fb"}
        both = np.concatenate([runs[d][0] for d in "fb"], axis=2)
        p = _sigmoid((both @ self.p["V"] + self.p["v"])[:, :, 0])
        scale = weight / max(1.0, float(weight.sum()))
        dz = ((p - target) * scale)[:, :, None]
        grads["V"] = np.einsum("tbk,tbo->ko", both, dz)
        grads["v"] = dz.sum((0, 1))
        back = dz @ self.p["V"].T
        for d, part in (("f", back[:, :, :n]), ("b", back[:, :, n:])):
            trace, dh, dc = runs[d][1], np.zeros_like(part[0]), np.zeros_like(part[0])
            gates = np.zeros((len(x), x.shape[1], 4 * n), np.float32)
            for t in range(len(x) - 1, -1, -1) if d == "f" else range(len(x)):
                h, c, i, f, o, g, tc = trace[t]
                m = mask[t]
                dh = dh + part[t]
                live, dc_live = dh * m, dc * m
                dc_live = dc_live + live * o * (1 - tc * tc)
                dg = np.concatenate([dc_live * g * i * (1 - i), dc_live * c * f * (1 - f), live * tc * o * (1 - o),
                                     dc_live * i * (1 - g * g)], axis=1)
                gates[t] = dg
                grads["U" + d] += h.T @ dg
                dh = dh * (1 - m) + dg @ self.p["U" + d].T
                dc = dc * (1 - m) + dc_live * f
            grads["W" + d] = np.einsum("tbi,tbk->ik", x, gates, optimize=True)
            grads["c" + d] = gates.sum((0, 1))
        return grads

    def train(self, rows, targets, weights, epochs: int = EPOCHS, batch: int = BATCH, rate: float = 0.01, seed: int = 0):
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            # Sequences of like length share a batch; the batches come in random order.
            order = sorted(range(len(rows)), key=lambda i: len(rows[i]) * rng.uniform(0.8, 1.25))
            groups = [order[i:i + batch] for i in range(0, len(order), batch)]
            rng.shuffle(groups)
            for group in groups:
                x, mask = _padded([rows[i] for i in group])
                y, w = np.zeros(mask.shape[:2], np.float32), np.zeros(mask.shape[:2], np.float32)
                for k, i in enumerate(group):
                    y[:len(rows[i]), k], w[:len(rows[i]), k] = targets[i], weights[i]
                step += 1
                pace = rate * (1 - epoch / epochs)
                for k, g in self.gradients(x, mask, y, w).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.p[k] -= pace * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8)
        return self

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Main text or not, for each block of each page."""
        out = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, b in enumerate(pages) if b), key=lambda i: len(pages[i]))
        while order:
            # Longest first; fewer pages beside it the longer it is.
            size = max(1, min(64, BATCH_BLOCKS // len(pages[order[-1]])))
            order, group = order[:-size], order[-size:]
            x, mask = _padded([features(pages[i]) for i in group])
            z = self.logits(x, mask)
            for k, i in enumerate(group):
                out[i] = z[:len(pages[i]), k] > 0
        return out


# ---- training pages -------------------------------------------------------------------------------

_BEFORE = (("nav", ""), ("nav", "menu"), ("header", ""), ("header", "site header"), ("div", "navbar"), ("div", "menu"),
           ("ul", "breadcrumbs"), ("div", "ad"), ("div", "advert banner"), ("div", "cookie notice"), ("div", "consent popup"),
           ("form", "search"), ("form", "login"), ("div", "header"), ("div", "promo"))
_AFTER = (("footer", ""), ("footer", "site footer"), ("div", "footer"), ("aside", ""), ("aside", "sidebar"), ("div", "sidebar"),
          ("div", "related"), ("section", "comments"), ("div", "comments"), ("ol", "comment list"), ("form", "comment form"),
          ("form", "newsletter"), ("div", "share social"), ("div", "ad"), ("div", "widget"), ("div", "pagination"))
_AMID = (("div", "ad"), ("aside", ""), ("aside", "related"), ("div", "share"), ("div", "newsletter signup"), ("nav", "toc"),
         ("form", "subscribe"), ("div", "promo"), ("section", "comments"), ("div", "notice"))
_MAIN = (("article", ""), ("main", ""), ("article", "post"), ("main", "content"), ("div", "content"), ("div", "article body"),
         ("div", "post"), ("div", "entry content"), ("section", "story"), ("div", "text"), ("div", ""), ("div", "main"))
_LEAVES = ("p", "p", "p", "p", "p", "h2", "h3", "li", "blockquote", "pre", "td", "figcaption", "dd", "div")


def compose(pool: list[Block], rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """A page of some layout, made of sentences and words of ``pool``, with its labels."""
    out: list[Block] = []
    labels: list[int] = []

    def words(least: int, most: int) -> str:
        w = pool[rng.integers(len(pool))].text.split(" ")
        at = int(rng.integers(max(1, len(w))))
        return " ".join(w[at:at + int(rng.integers(least, most + 1))]) or w[0]

    def element(tag: str, names: str) -> str:
        return f"{tag} {names}".strip()

    def part(around: tuple[str, ...], choice) -> None:
        tag, names = choice[rng.integers(len(choice))]
        inner = (*around, element(tag, names))
        linked = tag in ("nav", "ul") or names in ("navbar", "menu", "breadcrumbs", "related", "pagination")
        for _ in range(int(rng.integers(1, 9 if linked else 5))):
            long = not linked and rng.random() < 0.5
            leaf = (("ul", "li", "a") if linked else [("p",), ("div",), (), ("span",), ("label",), ("ul", "li", "a")][rng.integers(6)])
            text = words(8, 60) if long else words(1, 8)
            if "footer" in inner[-1] and rng.random() < 0.5:
                text = "© " + text
            out.append(Block((*inner, *leaf), text, 1.0 if "a" in leaf else 0.0))
            labels.append(0)

    shell = [("html", "body"), ("html", "body", "div wrapper"), ("html", "body", "div page"), ("html", "body", "div", "div row")][rng.integers(4)]
    for _ in range(int(rng.integers(0, 4))):
        part(shell, _BEFORE)
    main = (*shell, element(*_MAIN[rng.integers(len(_MAIN))]))
    if rng.random() < 0.8:
        out.append(Block((*main, *([("header",), ()][int(rng.random() < 0.9)]), "h1"), words(1, 14), 0.0))
        labels.append(1)
    for _ in range(int(rng.integers(1, 14))):
        leaf = _LEAVES[rng.integers(len(_LEAVES))]
        wrap = {"li": ("ul", "li"), "td": ("table", "tr", "td"), "dd": ("dl", "dd"), "figcaption": ("figure", "figcaption")}.get(leaf, (leaf,))
        text = pool[rng.integers(len(pool))].text if rng.random() < 0.5 else words(1, 12 if leaf[0] == "h" else 90)
        out.append(Block((*main, *wrap, *([("b",), ("a",), ("span",)][rng.integers(3)] if rng.random() < 0.15 else ())), text,
                         float(rng.random() * 0.3 * (rng.random() < 0.2))))
        labels.append(1)
        if rng.random() < 0.08:
            part(main, _AMID)
    for _ in range(int(rng.integers(0, 4))):
        part(shell if rng.random() < 0.85 else main, _AFTER)
    return out, np.array(labels, np.float32)


def fit_labeller(pages: DataFrame, key: str = "page_id", html: str = "html", train_pages: int = TRAIN_PAGES,
                 train_chars: int = TRAIN_CHARS, composed: int = COMPOSED, epochs: int = EPOCHS, seed: int = 5) -> Labeller:
    """Trained on at most ``train_pages`` pages of at most ``train_chars`` characters each."""
    usable = pages.where(F.length(html) <= train_chars).select(F.col(key).alias("id"), F.col(html).alias("html"))
    chosen = usable.where("id is not null").select("id", F.xxhash64("id", F.lit(seed)).alias("h")).distinct().orderBy(
        "h", "id").limit(train_pages).select("id")
    # At most train_pages ids; of repeated ids one page each is read.
    sample = usable.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("html").alias("html")).orderBy("id").collect()
    return train_labeller([r.html for r in sample], composed, epochs, seed)


def train_labeller(sample: list[str], composed: int = COMPOSED, epochs: int = EPOCHS, seed: int = 5) -> Labeller:
    rng = np.random.default_rng(seed)
    pages = [b for b in map(blocks_of, sample) if b]
    rows, targets, weights = [], [], []
    for blocks in pages:
        known = [marked(b) for b in blocks]
        if True in known:  # outside of a marked article, all else is not the article
            rows.append(features(blocks))
            targets.append(np.array([k is True for k in known], np.float32))
            weights.append(np.ones(len(blocks), np.float32))
    pool = [b for blocks in pages for b in blocks] or [Block((), w, 0.0) for w in ("a b c d e f g h.", "one", "two three")]
    for _ in range(composed):
        blocks, labels = compose(pool, rng)
        rows.append(features(blocks))
        targets.append(labels)
        weights.append(np.ones(len(blocks), np.float32))
    return Labeller(PATH_DIM + WORD_DIM + FIGURES, seed=seed).train(rows, targets, weights, epochs, seed=seed)


ADDED = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract_text(pages: DataFrame, labeller: Labeller, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``; every page is read whole, in its own task."""
    sent = pages.sparkSession.sparkContext.broadcast(labeller)

    def compute(column):
        parsed = [blocks_of(h) for h in column.to_pylist()]
        texts = ["\n".join(b.text for b, main in zip(blocks, labels, strict=True) if main)
                 for blocks, labels in zip(parsed, sent.value.label(parsed), strict=True)]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return append_columns(pages, [html], ADDED, compute)
