import functools
import hashlib
import random
import zlib
from itertools import pairwise

import pytest

from fleetlens.llm import turn_repair as R
from fleetlens.llm.queries import op12_turn_repair

SCHEMA = "conv_id long, turn long, role string, text string, audit string, gone int"


def cheapest(initials, faults):
    """Least (cost, audit) over every length, by plain recursion."""
    best = None
    for m in [0, *range(2, 2 * len(initials) + 6)]:
        wanted = R.target(m)

        @functools.cache
        def rest(i, j, wanted=wanted, m=m):
            if i == len(initials) and j == m:
                return 0, ""
            found = [(1 << 40, "")]
            if i < len(initials):
                c, a = rest(i + 1, j)
                found.append((c + 3, "D" + a))
            if j < m and wanted[j] != "s":
                c, a = rest(i, j + 1)
                found.append((c + 2, "I" + a))
            if i < len(initials) and j < m and faults[i] < R.BLANK:
                c, a = rest(i + 1, j + 1)
                c += faults[i] == R.TRUNCATED
                if initials[i] == wanted[j]:
                    found.append((c, "K" + a))
                if wanted[j] != "s":
                    found.append((c + 2, "R" + a))
            return min(found)

        best = min(best or rest(0, 0), rest(0, 0))
    return best


def test_alignments_against_recursion():
    rng = random.Random(1)
    for _ in range(700):
        n = rng.randint(0, 9)
        initials = "".join(rng.choice("uuuaaast-") for _ in range(n))
        faults = bytes(rng.choice([0, 0, 0, 0, 1, 1, 2, 3]) for _ in range(n))
        expected = cheapest(initials, faults)
        assert R.align_by_length(initials, faults) == expected
        assert R.align_folded(initials, faults) == expected


def test_folded_columns_are_the_tables():
    rng = random.Random(4)
    for n in (40, 90, 128):
        initials = "".join("ua"[i % 2] if rng.random() < 0.9 else rng.choice("uas") for i in range(n))
        faults = bytes(rng.choice([0] * 8 + [1, 2, 3]) for _ in range(n))
        assert R.align_by_length(initials, faults) == R.align_folded(initials, faults)


def brute(rows):
    conversations = {}
    for conv, turn, role, text, *_ in rows:
        role, text = (" " if v is None else v for v in (role, text))
        out = conversations.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, own in conversations.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faults = set(), []
        for _, role, text in own:
            core = text.rstrip(R.SPACE)
            faults.append(R.BLANK if not core else R.DUPLICATE if (role, text) in seen else R.NONE if core[-1] in ".!?" else R.TRUNCATED)
            seen.add((role, text))
        initials = [r[1][:1] for r in own]
        cost, audit = (cheapest if len(own) < 30 else R.align_folded)([c or "-" for c in initials], bytes(faults))
        length = len(audit.replace("D", ""))
        lines, row, put = [], 0, 0
        for edit in audit:
            put += edit != "D"
            if edit != "D":
                role = own[row][1] if edit == "K" else ("user", "assistant")[(length - put) % 2 == 0]
                lines.append(f"{role}:{'' if edit == 'I' else own[row][2]}")
            row += edit != "I"
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        yield (conv, gaps, faults.count(R.BLANK), faults.count(R.DUPLICATE), faults.count(R.TRUNCATED),
               sum(a + b not in ("su", "ua", "au") for a, b in pairwise(initials)), cost, audit,
               hashlib.sha256("\n".join(lines).encode()).hexdigest())


def odd_turns():
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
             rng.choice(["Hi.", "Yes!", "cut off", "", " \t\n", None, "é? ", f"own {c} {t}.", " "]), "a", 1)
            for c in [*range(40), None, -5] for t in [*range(rng.randint(1, 9)), None] if rng.random() < 0.9]
    rows += [(77, t // 2, ("user", "assistant")[t % 2 ^ (t % 50 == 0)], f"turn {t % 190}.", "a", 1) for t in range(400)]  # a long one
    rows += [(78, 4, "user", "x" * 3_000_000, "a", 1), (78, -9, "user", "same", "a", 1), (78, 4, "user", "same", "a", 1)]
    return rows


@pytest.mark.parametrize("text_bytes", [R.TEXT_BYTES, 20])
def test_against_brute_force(spark, text_bytes):
    rows = odd_turns()
    got = R.repair_turns(R.damaged(spark.createDataFrame(rows, SCHEMA).repartition(5)), text_bytes=text_bytes)

    def key(r):
        return str(r[0])

    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(brute(rows), key=key)


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(tuple(r) for r in op12_turn_repair(spark, sf).collect()) == sorted(brute(rows))


def test_empty_and_all_dropped(spark):
    turns = spark.createDataFrame([], SCHEMA)
    assert R.repair_turns(R.damaged(turns)).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row = R.repair_turns(R.damaged(spark.createDataFrame([(gone, 0, "user", "a.", "", 1)], SCHEMA))).first()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
