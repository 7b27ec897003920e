"""Fixtures with the odd cases that every operator must take."""

import random

DOCS = ("doc_id long, text string, lang string, source string, n_chars long, n_words long, comp long, "
        "spans string, ids string, node long, rows string")


def docs_of(spark, texts, lang="en"):
    """Documents with further columns that are named like those inside operators."""
    rows = [(i, t, lang, "s", len(t or ""), 7, 8, "x", "y", 9, "z") for i, t in texts]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def sentence(rng, words=12):
    return " ".join("".join(rng.choice("abcdefghijklmnoprstuvwé") for _ in range(rng.randint(2, 9))) for _ in range(words))


def corpus(seed=0, n=40):
    """(id, text): copies, near copies, shared lines and passages, empty, null and odd texts."""
    rng = random.Random(seed)
    texts = ["\n".join(sentence(rng, rng.randint(5, 60)) for _ in range(rng.randint(1, 5))) for _ in range(n)]
    for i in range(0, n, 8):
        words = texts[i].split(" ")
        for _ in range(max(1, len(words) // 30)):
            words[rng.randrange(len(words))] = "changed"
        texts += [texts[i], " ".join(words)]
    passage = sentence(rng, 70)
    texts += [sentence(rng) + "\n" + passage + "\n" + sentence(rng) for _ in range(6)]
    texts += [None, "", " \n\t ", "one two", "One TWO", "x", "word " * 500, sentence(rng, 9000), "日本語 テキスト x y"]
    return list(enumerate(texts))


def link(pairs, nodes):
    """The smallest node that links reach, for every node."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
