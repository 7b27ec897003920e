"""Chat formatting with DataFrame functions only.

A finite-state machine over roles checks the order of the turns, and a declarative template turns each
turn into text segments with a loss flag. Control strings inside texts are escaped reversibly: ``[``,
``]`` and ``<`` never stand in a formatted text except in the template's own marks.

A conversation is one record of the result, so its turns meet in one row; nothing else is grouped.
Defined results: a null text or role reads as empty; a role that the template doesn't name is marked
with its escaped name and makes the order invalid; a null conversation id is a conversation of its
own; turns are ordered by (turn, role, text), null first, and repeated rows are repeated turns; an
empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: role: (mark before, mark after, whether its text is learnt)
TEMPLATE = {
    "system": ("[SYS] ", " [/SYS]", False),
    "user": ("[INST] ", " [/INST]", False),
    "assistant": ("[REPLY] ", "</s>", True),
    "tool": ("[TOOL] ", " [/TOOL]", False),
}
OPENING = "<s>"
#: Marks of a role outside the template; its name stands between the first two.
OTHER = ("[ROLE ", "] ", " [/ROLE]")

#: state: {role: next state}
MACHINE = {
    "start": {"system": "instructed", "user": "asked"},
    "instructed": {"user": "asked"},
    "asked": {"assistant": "answered"},
    "answered": {"user": "asked", "tool": "called"},
    "called": {"tool": "called", "assistant": "answered"},
}
ACCEPTING = ("answered",)

#: Characters of marks and the escape character itself, with what stands for them.
ESCAPES = (("~", "~0"), ("[", "~1"), ("]", "~2"), ("<", "~3"))


def escape(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _by_role(role: Column, values: dict, other: Column) -> Column:
    out = other
    for name, value in values.items():
        out = F.when(role == name, F.lit(value)).otherwise(out)
    return out


def _segments(turn: Column, template: dict) -> Column:
    role = turn["role"]
    before = _by_role(role, {r: t[0] for r, t in template.items()},
                      F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1])))
    after = _by_role(role, {r: t[1] for r, t in template.items()}, F.lit(OTHER[2]))
    learnt = _by_role(role, {r: t[2] for r, t in template.items()}, F.lit(False))

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    return F.array(piece(before, F.lit(False)), piece(escape(turn["text"]), learnt),
                   piece(after, F.lit(False)))


def final_state(roles: Column, machine: dict) -> Column:
    """The state of the machine after ``roles``; null once a role is not allowed."""
    steps = F.create_map(*[F.lit(x) for state, nexts in machine.items() for role, to in nexts.items()
                           for x in (f"{state} {role}", to)])
    return F.aggregate(roles, F.lit("start").cast("string"),
                       lambda state, role: F.try_element_at(steps, F.concat(state, F.lit(" "), role)))


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text", template: dict = TEMPLATE, machine: dict = MACHINE) -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, is_valid, segments, formatted``.

    ``segments`` holds ``(text, loss)`` in order; ``formatted`` is their concatenation after the opening.
    """
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                   F.coalesce(F.col(text), F.lit("")).alias("text"))
    chats = turns.select(F.col(conv_id).alias("conv_id"), one.alias("t")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("t")).alias("turns"))
    state = final_state(F.transform("turns", lambda t: t["role"]), machine)
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.coalesce(state.isin(*ACCEPTING), F.lit(False)).alias("is_valid"),
        F.flatten(F.transform("turns", lambda t: _segments(t, template))).alias("segments"),
    ).withColumn("formatted", F.concat(
        F.lit(OPENING), F.array_join(F.transform("segments", lambda s: s["text"]), "")))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, as it was before escaping."""
    return unescape(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), ""))


def parse_chat(formatted: Column, template: dict = TEMPLATE) -> Column:
    """The turns ``(role, text)`` of a formatted conversation; the inverse of the template."""
    by_mark = {t[0].strip()[1:-1]: r for r, t in template.items()}
    pieces = F.filter(F.split(formatted, r"(?=\[[A-Z])"), lambda p: p.startswith("["))

    def turn_of(piece: Column) -> Column:
        mark = F.regexp_extract(piece, r"^\[([A-Z]+)", 1)
        named = unescape(F.regexp_extract(piece, r"(?s)^\[ROLE ([^\]]*)\]", 1))
        # Marks around a text begin with one of the escaped characters, so a text ends at the first.
        body = F.regexp_extract(piece, r"(?s)^\[[^\]]*\] ([^\[<]*)", 1)
        closed = F.regexp_extract(piece, r"(?s)^\[[^\]]*\] [^\[<]*([\[<])", 1)
        body = F.when(closed == "[", F.substring(body, F.lit(1), F.length(body) - 1)).otherwise(body)
        return F.struct(_by_role(mark, by_mark, named).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn_of)
