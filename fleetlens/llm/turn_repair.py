"""Repair of conversation structure by alignment with the alternating grammar ``(s?(ua)+)?``.

A row's first fault counts: blank (no character but white space), duplicate (its role and text were seen earlier in the
conversation) or truncated (the last character that isn't white space ends no sentence). The initials of the roles are
aligned, by Wagner and Fischer's table, with the grammar's string of each feasible length: Keep costs 0, Rerole to user or
assistant 2, Delete 3 (blank and duplicate rows must go), Insert of an empty user or assistant turn 2; a truncated row that
stays adds 1. Lengths are taken by their least possible cost; the cost of the best alignment so far bounds the band of the next
table (Ukkonen). The cheapest alignments are traced back to audits, the edits' initials in order, and the audit that sorts
first wins.

Conversations travel as sorted rows and are read as a stream: a task holds two bytes and one 128-bit digest a turn, and texts
up to ``TEXT_BYTES`` of one conversation. The texts of a longer one are read again, in order, to hash its repair. A
conversation of more than ``TABLE_TURNS`` turns is aligned with all lengths at once: columns of one remaining parity
have the same future, so they are folded into one; its costs and audits are those of the tables.

Defined results: a null role, text, turn or id of a row reads as one space where text is made of it; rows without a ``conv_id`` are one
conversation. Rows are in order of turn (nulls first), role and text; equal rows are duplicates. A conversation none of whose rows
are left has zeros and an empty audit. ``gaps`` is held within 64 bits. An empty table gives no rows; columns besides the four named ones are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import land

#: Turns of a conversation that are aligned length by length.
TABLE_TURNS = 128
#: Characters of text that a task holds of one conversation.
TEXT_BYTES = 32 << 20
#: Rows of one batch of results.
OUT_ROWS = 2048
#: Turns or characters of results that make a batch full.
OUT_BYTES = 8 << 20

REROLE, DELETE, INSERT, STAYS_TRUNCATED = 2, 3, 2, 1
NONE, TRUNCATED, BLANK, DUPLICATE = 0, 1, 2, 3
SPACE = " \t\n\x0b\x0c\r"
_FAR = 1 << 60

REPAIRED = T.StructType([
    T.StructField("conv_id", T.LongType()),
    *[T.StructField(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
    T.StructField("audit", T.StringType()),
    T.StructField("repaired_sha256", T.StringType()),
])


# ---------------------------------------------------------------- alignment of one conversation

def target(length: int) -> str:
    return "s" * (length % 2) + "ua" * (length // 2)


def _table(initials: str, faults: bytes, wanted: str, bound: int):
    """Wagner and Fischer's costs from every cell to the end, within Ukkonen's band of ``bound``; rows as (first column, costs)."""
    n, m = len(initials), len(wanted)
    # A path through (i, j) costs at least what its distance from both ends' diagonals needs.
    low = -(bound // DELETE)
    high = bound // INSERT
    rows: list = [None] * (n + 1)
    after_first, after = 0, []
    for i in range(n, -1, -1):
        first = max(0, i + low, m - (n - i) - high)
        last = min(m, i + high, m - (n - i) - low)
        costs = [_FAR] * max(0, last - first + 1)
        stays = i < n and faults[i] < BLANK
        added = STAYS_TRUNCATED if i < n and faults[i] == TRUNCATED else 0
        for j in range(last, first - 1, -1):
            best = 0 if i == n and j == m else _FAR
            if i < n:
                k = j - after_first
                if 0 <= k < len(after):
                    best = min(best, after[k] + DELETE)
                if stays and j < m and 0 <= k + 1 < len(after):
                    here = initials[i] == wanted[j]
                    if here or wanted[j] != "s":
                        best = min(best, after[k + 1] + added + (0 if here else REROLE))
            if j < last and wanted[j] != "s":
                best = min(best, costs[j + 1 - first] + INSERT)
            costs[j - first] = best
        rows[i] = (first, costs)
        after_first, after = first, costs
    return rows


def _cell(rows, i: int, j: int) -> int:
    first, costs = rows[i]
    return costs[j - first] if 0 <= j - first < len(costs) else _FAR


def _trace(rows, initials: str, faults: bytes, wanted: str) -> str:
    """The audit that sorts first among the cheapest paths."""
    n, m = len(initials), len(wanted)
    i = j = 0
    audit = []
    while (i, j) != (n, m):
        cost = _cell(rows, i, j)
        stays = i < n and faults[i] < BLANK
        added = STAYS_TRUNCATED if i < n and faults[i] == TRUNCATED else 0
        if i < n and _cell(rows, i + 1, j) + DELETE == cost:
            audit.append("D")
            i += 1
        elif j < m and wanted[j] != "s" and _cell(rows, i, j + 1) + INSERT == cost:
            audit.append("I")
            j += 1
        else:
            kept = stays and j < m and initials[i] == wanted[j] and _cell(rows, i + 1, j + 1) + added == cost
            audit.append("K" if kept else "R")
            i, j = i + 1, j + 1
    return "".join(audit)


def align_by_length(initials: str, faults: bytes) -> tuple[int, str]:
    """The cheapest cost over all lengths of the grammar's string, and its first audit."""
    n = len(initials)
    gone = sum(f >= BLANK for f in faults)
    stay = n - gone

    def least(length):
        return DELETE * gone + INSERT * max(0, length - stay) + DELETE * max(0, stay - length)

    best = DELETE * n  # everything goes: the string of length 0
    audits = ["D" * n]
    # Beyond this length inserts alone cost more than the incumbent.
    lengths = [m for m in range(2, stay + best // INSERT + 1)]
    for m in sorted(lengths, key=lambda m: (least(m), m)):
        if least(m) > best:
            break
        if m % 2 and "s" not in initials:
            continue
        wanted = target(m)
        rows = _table(initials, faults, wanted, best)
        cost = _cell(rows, 0, 0)
        if cost > best:
            continue
        if cost < best:
            best, audits = cost, []
        audits.append(_trace(rows, initials, faults, wanted))
    return best, min(audits)


def align_folded(initials: str, faults: bytes) -> tuple[int, str]:
    """The same for a long conversation, columns of one remaining parity folded into one.

    Columns: 0, an even number of turns still to come; 1, an odd one; 2, right behind the system turn; 3, nothing written yet.
    """
    n = len(initials)
    costs = np.zeros((n + 1, 4), np.int64)
    costs[n] = (0, INSERT, 2 * INSERT, 0)
    even, odd, behind, start = 0, INSERT, 2 * INSERT, 0
    for i in range(n - 1, -1, -1):
        e, o, b, s = even + DELETE, odd + DELETE, behind + DELETE, start + DELETE
        if faults[i] < BLANK:
            added = STAYS_TRUNCATED if faults[i] == TRUNCATED else 0
            c = initials[i]
            write_u = odd + added + (0 if c == "u" else REROLE)
            e, b, s = min(e, write_u), min(b, write_u), min(s, write_u)
            o = min(o, even + added + (0 if c == "a" else REROLE))
            if c == "s":
                s = min(s, behind + added)
        even, odd = min(e, o + INSERT), min(o, e + INSERT)
        behind, start = min(b, odd + INSERT), min(s, odd + INSERT)
        costs[i] = (even, odd, behind, start)
    table = costs.tolist()
    audit, i, column = [], 0, 3
    while i < n or column in (1, 2):
        cost = table[i][column]
        if i < n and table[i + 1][column] + DELETE == cost:
            audit.append("D")
            i += 1
            continue
        onward = 0 if column == 1 else 1
        if table[i][onward] + INSERT == cost:
            audit.append("I")
            column = onward
            continue
        added = STAYS_TRUNCATED if faults[i] == TRUNCATED else 0
        written = "a" if column == 1 else "u"
        if column == 3 and initials[i] == "s" and table[i + 1][2] + added == cost:
            audit.append("K")
            column = 2
        else:
            audit.append("K" if initials[i] == written and table[i + 1][onward] + added == cost else "R")
            column = onward
        i += 1
    return costs[0, 3].item(), "".join(audit)


def align(initials: str, faults: bytes, table_turns: int = TABLE_TURNS) -> tuple[int, str]:
    return (align_by_length if len(initials) <= table_turns else align_folded)(initials, faults)


# ---------------------------------------------------------------- conversations as a stream

def damaged(turns: DataFrame) -> DataFrame:
    """The rows ``(conv_id, turn, role, text, gone)`` after the contract's damage; ``gone`` marks dropped rows, which stay here."""
    def shown(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    rows = turns.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"),
                        (F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20).alias("kind"))
    kind, text = F.col("kind"), F.col("text")
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")


def _faults(turns: DataFrame) -> DataFrame:
    """Rows with ``fault``: blank or truncated; duplicates are told from the order."""
    core = F.rtrim("text", F.lit(SPACE))
    return turns.withColumn("fault", F.when(core == "", BLANK).when(
        F.substring(core, -1, 1).isin(".", "!", "?"), NONE).otherwise(TRUNCATED).cast("int"))


def _in_order(turns: DataFrame) -> DataFrame:
    return turns.repartition("conv_id").sortWithinPartitions(
        F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text")


class _Hash:
    """Running digest of a repair: ``role:text`` of its turns, newline-joined."""

    def __init__(self):
        self.digest, self.parity, self.empty = hashlib.sha256(), 0, True

    def write(self, role: str, text: str) -> None:
        self.digest.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.empty = False

    def inserts(self, audit: str, at: int) -> int:
        while at < len(audit) and audit[at] == "I":
            self._own("")
            at += 1
        return at

    def _own(self, text: str) -> None:
        self.write(("user", "assistant")[self.parity], text)
        self.parity ^= 1

    def row(self, edit: str, role: str, text: str) -> None:
        if edit == "R":
            self._own(text)
        elif edit == "K":
            self.write(role, text)
            if role[:1] != "s":
                self.parity ^= 1


class _Conversation:
    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.initials, self.faults, self.digests = [], bytearray(), bytearray()
        self.texts, self.size = [], 0
        self.low = self.high = self.turn = None
        self.turns = self.illegal = 0

    def add(self, turn, role, text, fault, limit) -> None:
        if turn is not None:
            if turn != self.turn:
                self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
        if self.initials and self.initials[-1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initials.append(role[:1])
        self.faults.append(fault)
        mark = f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")
        self.digests += hashlib.blake2b(mark, digest_size=16).digest()
        if self.texts is not None:
            self.texts.append((role, text))
            self.size += len(role) + len(text)
            if self.size > limit:
                self.texts = None

    def finish(self, table_turns: int) -> tuple:
        n = len(self.initials)
        pairs = np.frombuffer(bytes(self.digests), np.uint64).reshape(-1, 2)
        order = np.lexsort((np.arange(n), pairs[:, 1], pairs[:, 0]))
        again = order[1:][(pairs[order[1:]] == pairs[order[:-1]]).all(axis=1)]
        faults = np.frombuffer(bytes(self.faults), np.uint8).copy()
        faults[again[faults[again] != BLANK]] = DUPLICATE
        counts = np.bincount(faults, minlength=4).tolist()
        faults = faults.tobytes()
        # An empty role has no initial; no grammar symbol equals it.
        cost, audit = align("".join(c or "-" for c in self.initials), faults, table_turns)
        sha = None
        if self.texts is not None:
            sha, at = _Hash(), 0
            for role, text in self.texts:
                at = sha.inserts(audit, at)
                sha.row(audit[at], role, text)
                at += 1
            sha.inserts(audit, at)
            sha = sha.digest.hexdigest()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv_id, min(gaps, (1 << 63) - 1), counts[BLANK], counts[DUPLICATE], counts[TRUNCATED], self.illegal, cost, audit, sha)


def _emitted(rows, schema):
    """Rows as batches that stay small whatever a row's size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= OUT_ROWS or size >= OUT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _stream(batches, columns):
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield from zip(*[part.column(c).to_pylist() for c in columns], strict=True)


def repair_turns(turns: DataFrame, table_turns: int = TABLE_TURNS, text_bytes: int = TEXT_BYTES) -> DataFrame:
    """One row per conversation of ``turns (conv_id, turn, role, text, gone)``: faults, the cheapest repair's cost and audit, its hash."""
    rows = _faults(turns)

    def judge(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        def done():
            now = None
            for conv_id, turn, role, text, gone, fault in _stream(batches, ["conv_id", "turn", "role", "text", "gone", "fault"]):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        yield now.finish(table_turns)
                    now = _Conversation(conv_id)
                if not gone:
                    now.add(turn, role, text, fault, text_bytes)
            if now is not None:
                yield now.finish(table_turns)

        yield from _emitted(done(), to_arrow_schema(REPAIRED))

    judged = land(_in_order(rows).mapInArrow(judge, REPAIRED))
    long = judged.where("repaired_sha256 is null")
    if long.isEmpty():
        return judged
    return judged.where("repaired_sha256 is not null").unionByName(_hashed(rows, long))


def _hashed(rows: DataFrame, long: DataFrame) -> DataFrame:
    """``long`` with the hashes of conversations whose texts are too long to hold: their rows stream past once more, behind their audit."""
    names = [f.name for f in REPAIRED]
    nothing = {"turn": "bigint", "role": "string", "text": "string"}
    heads = long.select(F.struct(*names).alias("own"), "conv_id", *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()], F.lit(0).alias("_part"))
    same = long.select(F.col("conv_id").alias("_conv"))
    texts = rows.where("not gone").join(same, rows["conv_id"].eqNullSafe(F.col("_conv")), "left_semi").select(
        F.lit(None).cast(REPAIRED).alias("own"), "conv_id", "turn", "role", "text", F.lit(1).alias("_part"))
    stream = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions(
        F.asc_nulls_first("conv_id"), "_part", F.asc_nulls_first("turn"), "role", "text")

    def hashes(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        def done():
            own, sha, at = None, None, 0
            for head, role, text in _stream(batches, ["own", "role", "text"]):
                if head is not None:
                    if own is not None:
                        sha.inserts(own["audit"], at)
                        yield (*[own[c] for c in names[:-1]], sha.digest.hexdigest())
                    own, sha, at = head, _Hash(), 0
                    continue
                at = sha.inserts(own["audit"], at)
                sha.row(own["audit"][at], role, text)
                at += 1
            if own is not None:
                sha.inserts(own["audit"], at)
                yield (*[own[c] for c in names[:-1]], sha.digest.hexdigest())

        yield from _emitted(done(), to_arrow_schema(REPAIRED))

    return stream.mapInArrow(hashes, REPAIRED)
