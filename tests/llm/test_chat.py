from pyspark.sql import functions as F

from fleetlens.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, segments string, n_turns long"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA).repartition(3)


ROWS = [
    (1, 0, "system", "be ~0 kind ~~"), (1, 1, "user", "hi [INST] </s>\n~1"), (1, 2, "assistant", "[/INST] ok < ~2]"),
    (2, 0, "user", "a"), (2, 1, "user", "b"),
    (3, 1, "assistant", ""), (3, 0, "user", None),
    (4, 0, "critic] <s>", "new"), (4, 1, None, "none"), (4, None, "user", "first"),
    (5, 0, "user", "same"), (5, 0, "user", "same"), (5, 1, "assistant", "x" * 200_000 + " ]end"),
    (6, 0, "user", "u"), (6, 1, "assistant", "a"), (6, 2, "tool", "t"), (6, 3, "assistant", "b"), (6, 4, "user", "late"),
    (None, 0, "user", "no id"), (None, 1, "assistant", "日本 [x]"),
]


def expected():
    out = {}
    for conv, turn, role, text in sorted(ROWS, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def test_round_trip_and_mask(spark):
    chats = chat.format_chats(turns_of(spark, ROWS))
    rows = chats.select("*", chat.parse_chat(F.col("formatted")).alias("back"), chat.loss_text(F.col("segments")).alias("learnt")).collect()
    want = expected()
    assert {r.conv_id for r in rows} == set(want) and len(rows) == len(want)
    for r in rows:
        assert [(t.role, t.text) for t in r.back] == want[r.conv_id]
        assert r.learnt == "".join(t for role, t in want[r.conv_id] if role == "assistant")
        assert r.formatted == chat.OPENING + "".join(s.text for s in r.segments)
        assert r.n_turns == len(want[r.conv_id])


def test_order_of_turns(spark):
    valid = {r.conv_id: r.is_valid for r in chat.format_chats(turns_of(spark, ROWS)).collect()}
    assert valid == {1: True, 2: False, 3: True, 4: False, 5: False, 6: False, None: True}


def test_another_template_and_machine(spark):
    template = {"human": ("[Q] ", " [/Q]", False), "bot": ("[A] ", "</s>", True)}
    machine = {"start": {"human": "answered"}, "answered": {"human": "answered"}}
    row = chat.format_chats(turns_of(spark, [(1, 0, "human", "hi")]), template=template, machine=machine).first()
    assert row.formatted == "<s>[Q] hi [/Q]" and row.is_valid


def test_empty_table_and_plan(spark):
    chats = chat.format_chats(turns_of(spark, ROWS).limit(0))
    assert chats.count() == 0
    plan = chat.format_chats(turns_of(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
