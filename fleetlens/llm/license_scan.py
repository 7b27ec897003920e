"""Licence scan: an automaton finds identifier tags and notice phrases, a shunting-yard parser evaluates expressions.

Words are runs of digits, ASCII letters (A-Z read as a-z) and characters beyond ASCII. One Aho-Corasick automaton over
the phrases reads each whole text once. A phrase is a notice (``mit license``) or a tag (``SPDX-License-Identifier``,
``License:``), behind which an expression stands in the original text. Notices that only ``and``, ``or`` and filler words
part form an expression too. ``with`` binds before ``and``, ``and`` before ``or``; of an ``or`` the reader takes the side that
restricts least, an ``and`` binds by all its sides, and an exception lightens what it is granted for.

Defined results: a null, empty or wordless text has no words, no labels (empty arrays), a score of 0 and null places. Repeated
documents and ids are read row by row, texts of any length whole; one row at a time is turned into words. The first words that
fit no expression end it; a missing operand or bracket leaves what was read, marked ``valid = false``. Of the notices at
one place each counts. Columns of the input named as the added ones are replaced, all others pass. Nothing is shuffled, and the phrase
table is a constant.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fleetlens.llm.common import append_columns
from fleetlens.llm.decontaminate import NORMAL

#: How far a licence restricts use, from 0 (not at all) to 1 (no use granted).
WEIGHTS = {
    "cc0": 0.1, "public-domain": 0.1, "unlicense": 0.1, "mit": 0.2, "bsd": 0.2, "isc": 0.2, "zlib": 0.2, "apache": 0.2,
    "cc-by": 0.3, "mpl": 0.5, "epl": 0.5, "lgpl": 0.5, "cc-by-sa": 0.6, "gpl": 0.7, "agpl": 0.8, "cc-by-nd": 0.9,
    "cc-by-nc": 0.9, "reserved": 1.0, "proprietary": 1.0, "other": 1.0,
}
#: What an exception takes off, and the least that stays.
EXCEPTION, LEAST = 0.2, 0.2
#: Beginnings of licence identifiers; the longest that fits names the label.
IDENTIFIERS = {
    "0bsd": "bsd", "agpl": "agpl", "apache": "apache", "bsd": "bsd", "cc-by": "cc-by", "cc-by-nc": "cc-by-nc", "cc-by-nd": "cc-by-nd",
    "cc-by-sa": "cc-by-sa", "cc0": "cc0", "epl": "epl", "gpl": "gpl", "isc": "isc", "lgpl": "lgpl", "mit": "mit", "mpl": "mpl",
    "unlicense": "unlicense", "zlib": "zlib",
}
#: The phrases whose places are counted.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICES = {
    "affero general public license": "agpl", "apache license": "apache", "apache software license": "apache",
    "berkeley software distribution": "bsd", "bsd license": "bsd", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa", "cc0": "cc0", "creative commons attribution": "cc-by", "creative commons zero": "cc0",
    "dedicated to the public domain": "public-domain", "eclipse public license": "epl", "gnu gpl": "gpl", "gnu lgpl": "lgpl",
    "in the public domain": "public-domain", "isc license": "isc", "lesser general public license": "lgpl",
    "mit license": "mit", "mozilla public license": "mpl", "permission is hereby granted free of charge": "mit",
    "proprietary and confidential": "proprietary", "redistribution and use in source and binary forms": "bsd",
    "this is free and unencumbered software": "unlicense", "zlib license": "zlib",
}
#: Tags and whether what stands behind them is an expression in any case.
TAGS = {"spdx license identifier": True, "license": False, "licence": False, "licenses": False}
#: Words that may stand between two notices of one expression.
FILLER = frozenset("a either gnu license licence or-later the terms of under version v".split())
GAP_WORDS = 8

_BINDS = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_LEAD = re.compile(r"[ \t\"'`]*[:=][ \t\"'`]*")

_SPAN = [T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
ADDED = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.ArrayType(T.StringType())),
    T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("score", T.DoubleType()),
    T.StructField("notices", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), *_SPAN]))),
    T.StructField("expressions", T.ArrayType(T.StructType([
        T.StructField("expression", T.StringType()), T.StructField("valid", T.BooleanType()),
        T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("effective", T.ArrayType(T.StringType())),
        T.StructField("weight", T.DoubleType())]))),
])


@cache
def automaton():
    """The automaton over all phrases; values are (words, kind, label)."""
    machine = ahocorasick.Automaton()
    found: dict[str, list] = {}
    for kind, table in (("base", BASE), ("notice", NOTICES), ("tag", TAGS)):
        for phrase, label in table.items():
            found.setdefault(phrase, []).append((phrase.count(" ") + 1, kind, label))
    for phrase, values in found.items():
        machine.add_word(f" {phrase} ", values)
    machine.make_automaton()
    return machine


def label_of(identifier: str) -> str | None:
    """The label of a licence identifier, None when it begins like none."""
    name = identifier.lower()
    parts = name.split("-")
    for n in range(len(parts), 0, -1):
        head = "-".join(parts[:n])
        for key in (head, head.rstrip("+"), re.sub(r"[0-9.]+\+?$", "", head)):
            if key in IDENTIFIERS:
                return IDENTIFIERS[key]
    return None


class Term:
    """What a part of an expression names, which of it binds the reader, and how much."""

    __slots__ = ("labels", "effective", "weight")

    def __init__(self, labels, effective, weight):
        self.labels, self.effective, self.weight = labels, effective, weight


def _apply(operator: str, a: Term, b: Term) -> Term:
    if operator == "with":
        return Term(a.labels, a.effective, min(a.weight, max(LEAST, a.weight - EXCEPTION)))
    named = a.labels | b.labels
    if operator == "and":
        return Term(named, a.effective | b.effective, max(a.weight, b.weight))
    light = min((a, b), key=lambda t: (t.weight, sorted(t.effective)))
    return Term(named, light.effective, light.weight)


def evaluate(tokens: list[str]) -> tuple[Term | None, bool]:
    """The value of an expression by Dijkstra's shunting yard, and whether it is whole.

    Tokens are brackets, ``and``, ``or``, ``with`` and anything else, an operand. A trailing operator is dropped, an open
    bracket is closed at the end.
    """
    values: list[Term] = []
    operators: list[str] = []
    valid, operand_next, exception = True, True, False

    def reduce_to(bound):
        while operators and operators[-1] != "(" and _BINDS[operators[-1]] >= bound:
            b, a = values.pop(), values.pop()
            values.append(_apply(operators.pop(), a, b))

    for token in tokens:
        low = token.lower()
        if operand_next:
            if low == "(" and not exception:
                operators.append("(")
            elif low in _BINDS or low in "()":
                valid = False
                break
            else:
                label = "" if exception else label_of(token) or (low if low in WEIGHTS else "other")
                held = frozenset([label] if label else [])
                values.append(Term(held, held, WEIGHTS.get(label, 0.0)))
                operand_next = exception = False
        elif low == ")":
            reduce_to(1)
            if not operators:
                valid = False
                break
            operators.pop()
        elif low in _BINDS:
            reduce_to(_BINDS[low])
            operators.append(low)
            operand_next, exception = True, low == "with"
        else:
            valid = False
            break
    while operand_next and operators:
        operand_next = operators.pop() == "("  # nothing stands behind it
        valid = False
    while operators:
        if operators[-1] == "(":
            operators.pop()
            valid = False
        else:
            reduce_to(1)
    return (values[-1] if values else None), valid and bool(values)


def expression_at(text: str, at: int, any_name: bool) -> tuple[list[str], int]:
    """The tokens of the expression that begins at ``at``, up to the end of its line, and where it ends.

    Without ``any_name`` only known identifiers are operands, so that prose behind ``License:`` isn't read as one.
    """
    lead = _LEAD.match(text, at)
    if not lead:
        return [], at
    at = lead.end()
    tokens: list[str] = []
    operand_next, exception, depth = True, False, 0
    while m := _TOKEN.match(text, at):
        token = m[1]
        if len(token) > 1:
            token = token.rstrip(".:-")
        low = token.lower()
        if operand_next:
            if low == "(":
                depth += 1
            elif low == ")" or low in _BINDS or not (any_name or exception or label_of(token)):
                break
            else:
                operand_next = exception = False
        elif low == ")" and depth:
            depth -= 1
        elif low in _BINDS:
            operand_next, exception = True, low == "with"
        else:
            break
        tokens.append(token)
        at = m.end()
    return tokens, at


def _joined(names: list[tuple[int, int, str]], words: list[bytes]):
    """Expressions of notices (first word, end, label) that stand beside each other."""
    tokens: list[str] = []
    end = None
    for first, stop, label in names:
        gap = [w.decode("utf-8", "replace") for w in words[end:first]] if end is not None and end <= first <= end + GAP_WORDS else None
        links = [w for w in gap or [] if w in ("and", "or")]
        if gap is not None and len(links) == 1 and all(
                w in FILLER or w in ("and", "or") or w[:1].isdigit() for w in gap):
            tokens += [links[0], label]
        else:
            if len(tokens) > 1:
                yield tokens
            tokens = [label]
        end = stop
    if len(tokens) > 1:
        yield tokens


def scan(text: str | None) -> tuple:
    """The values of ``ADDED`` for one text."""
    none = (0, None, None, [], [], 0.0, [], [])
    if not text:
        return (0, *none)
    flat = text.encode("utf-8", "surrogatepass").translate(NORMAL)
    words = flat.split()
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    hits = list(automaton().iter(line)) if words else []
    if not hits:
        return (len(words), *none)
    blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    ends = np.searchsorted(blanks, [end for end, _ in hits])
    # Normalising keeps every byte in place, so word positions hold for the original text too.
    raw = np.frombuffer(flat, np.uint8)
    inside = np.concatenate([[False], raw != 32, [False]])
    starts, stops = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    base, names, expressions = [], set(), []
    for end, (_, values) in zip(ends.tolist(), hits, strict=True):
        for length, kind, label in values:
            if kind == "tag":
                tokens, at = expression_at(text, int(chars[stops[end - 1]]), label)
                if tokens:
                    expressions.append(tokens)
                continue
            if kind == "base":
                base.append((end - length, label))
            names.add((end - length, end, label))
    # A phrase inside a longer one of the same place names no licence of its own; base labels stay all the same.
    outer, reach = [], -1
    for first, stop, label in sorted(names, key=lambda n: (n[0], -n[1])):
        if stop > reach:
            outer.append((first, stop, label))
            reach = stop
    found = []
    for tokens in [*expressions, *_joined(outer, words)]:
        term, valid = evaluate(tokens)
        if term is not None:
            found.append({"expression": " ".join(tokens), "valid": valid, "labels": sorted(term.labels),
                          "effective": sorted(term.effective), "weight": term.weight})
    base_labels = sorted({label for _, label in base})
    labels = sorted({*base_labels, *(n[2] for n in outer), *(label for f in found for label in f["labels"])})
    # A licence that an expression offers as one of several doesn't bind by being named there.
    offered = {label for f in found for label in f["labels"]}
    score = max([f["weight"] for f in found] + [WEIGHTS[n[2]] for n in outer if n[2] not in offered], default=0.0)
    places = [p for p, _ in base]
    notices = [{"label": label, "start": int(chars[starts[first]]), "end": int(chars[stops[stop - 1]])} for first, stop, label in outer]
    return (len(words), len(base), min(places, default=None), max(places, default=None), base_labels, labels, score, notices, found)


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with counts of words and base places, labels, ``score``, ``notices`` with their characters, and ``expressions``."""
    def compute(texts):
        from pyspark.sql.pandas.types import to_arrow_schema

        rows = [scan(t.as_py()) for t in texts]
        cols = zip(*rows, strict=True) if rows else [[] for _ in ADDED]
        return [pa.array(c, type=f.type) for c, f in zip(cols, to_arrow_schema(ADDED), strict=True)]

    return append_columns(docs, [text], ADDED, compute)
