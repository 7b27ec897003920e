"""Streaming forms of the request-log operators.

Rows of one micro-batch are put in ``(ts, request_id)`` order per group; the state kept between
batches is one number per group.  The trigger bounds what a group can receive at once.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fleetlens import catalogs
from fleetlens.operators.request_log import request_metrics

_ORDER = ["ts", "request_id"]
_ONE_NUMBER = "n long"


def _ordered(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches), ignore_index=True).sort_values(_ORDER, ignore_index=True)


def _micros(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[us]").astype("int64")


def _extended(df: DataFrame, *fields: T.StructField) -> T.StructType:
    return T.StructType([*df.schema.fields, *fields])


def stream_ttl(requests: DataFrame, key: str = "cache_key",
               ttl: int = catalogs.CACHE_TTL_SECONDS, lateness: str = "1 hour") -> DataFrame:
    """Add ``outcome`` (``miss`` or ``hit``) and the ``anchor_us``, ``anchor_id`` of the window.

    A key whose window has passed the watermark is dropped from the state: its next request
    misses either way.
    """
    width = ttl * 1_000_000

    def settle(group, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        rows = _ordered(batches)
        anchor, anchor_id = state.get if state.exists else (None, None)
        found = []
        for us, request_id in zip(_micros(rows["ts"]), rows["request_id"]):
            miss = anchor is None or us > anchor + width
            if miss:
                anchor, anchor_id = int(us), int(request_id)
            found.append(("miss" if miss else "hit", anchor, anchor_id))
        state.update((anchor, anchor_id))
        # The timeout may not lie behind the watermark.
        state.setTimeoutTimestamp(max((anchor + width) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.concat([rows, pd.DataFrame(found, columns=["outcome", "anchor_us", "anchor_id"])], axis=1)

    schema = _extended(requests, T.StructField("outcome", T.StringType()),
                       T.StructField("anchor_us", T.LongType()),
                       T.StructField("anchor_id", T.LongType()))
    return (requests.withWatermark("ts", lateness).groupBy(key)
            .applyInPandasWithState(settle, schema, "anchor long, anchor_id long", "append",
                                    GroupStateTimeout.EventTimeTimeout))


_BLOCK_US = 3_600_000_000
#: What a row of :func:`_blocked` is: settled, waiting for the streak before its block, or the end of a block.
_SETTLED, _WAITING, _END, _END_UNBROKEN = range(4)
_LAST = (1 << 63) - 1


def _blocked(requests: DataFrame, scope: str) -> DataFrame:
    """The rows with the ``_streak`` that their scope's hour gives them, ``_block`` and ``_kind``, and a row for the end of each hour."""
    names = requests.columns
    at = [names.index(c) for c in (scope, "ts", "request_id", "path")]

    def count(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        scopes, ts, ids, paths = (table.column(i).combine_chunks() for i in at)

        def numbers(column):
            return column.cast(pa.int64()).fill_null(_LAST).to_numpy()

        us = numbers(ts.cast(pa.timestamp("us", ts.type.tz)))
        block = np.where(us == _LAST, _LAST, us // _BLOCK_US)
        group = pc.dictionary_encode(scopes, null_encoding="encode").indices.to_numpy()
        order = np.lexsort((numbers(ids), us, block, group))
        block, group = block[order], group[order]
        place = np.arange(len(order))
        fresh = np.r_[True, (group[1:] != group[:-1]) | (block[1:] != block[:-1])]
        start = np.maximum.accumulate(np.where(fresh, place, 0))
        breaks = pc.is_in(paths, pa.array(["llm", "cache_hit"])).to_numpy(zero_copy_only=False)[order]
        broken = np.maximum.accumulate(np.where(breaks, place, -1))
        waiting = broken < start
        fallbacks = np.r_[0, np.cumsum(pc.equal(paths, "fallback").fill_null(False).to_numpy(zero_copy_only=False)[order])]
        streak = fallbacks[1:] - fallbacks[np.where(waiting, start, broken + 1)]
        ends = np.flatnonzero(np.r_[fresh[1:], True])
        take = np.r_[place, ends]
        kind = np.r_[np.where(waiting, _WAITING, _SETTLED), np.where(waiting[ends], _END_UNBROKEN, _END)]
        for i in range(0, len(take), 10_000):
            now = take[i:i + 10_000]
            rows = table.take(pa.array(order[now])).combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(block[now], pa.int64()), pa.array(streak[now], pa.int64()), pa.array(kind[i:i + 10_000], pa.int32())],
                names=[*names, "_block", "_streak", "_kind"])

    schema = _extended(requests, T.StructField("_block", T.LongType()), T.StructField("_streak", T.LongType()),
                       T.StructField("_kind", T.IntegerType()))
    us = F.unix_micros("ts")
    return requests.repartition(F.col(scope), us - F.pmod(us, F.lit(_BLOCK_US))).mapInArrow(count, schema)


def stream_streaks(requests: DataFrame, scope: str) -> DataFrame:
    """Add ``streak``: consecutive fallbacks so far per scope.

    A batch is counted by hours of a scope, spread over the tasks. Only the rows before an hour's first answer, and a row per
    hour, go on to the scope's one task, which adds the streak that the hours before left.
    """

    def settle(group, batches, state: GroupState):
        rows = pd.concat(list(batches), ignore_index=True)
        ends = rows[rows["_kind"] >= _END].sort_values("_block")
        streak, before = state.get[0] if state.exists else 0, {}
        for block, tail, kind in zip(ends["_block"], ends["_streak"], ends["_kind"]):
            before[block] = streak
            streak = int(tail) + (streak if kind == _END_UNBROKEN else 0)
        state.update((streak,))
        rows = rows[rows["_kind"] == _WAITING]
        found = rows["_streak"] + rows["_block"].map(before)
        yield rows.drop(columns=["_block", "_streak", "_kind"]).assign(streak=found.astype("int64"))

    schema = _extended(requests, T.StructField("streak", T.LongType()))
    blocked = _blocked(requests, scope)
    settled = blocked.where(F.col("_kind") == _SETTLED).select(*requests.columns, F.col("_streak").alias("streak"))
    return settled.unionByName(blocked.where(F.col("_kind") != _SETTLED).groupBy(scope).applyInPandasWithState(
        settle, schema, _ONE_NUMBER, "append", GroupStateTimeout.NoTimeout))


def stream_alerts(requests: DataFrame, scope: str) -> DataFrame:
    return stream_streaks(requests, scope).where(
        F.col("streak") >= catalogs.FALLBACK_ALERT_THRESHOLD)


def stream_budget(outcomes: DataFrame, cap: int, scope: str) -> DataFrame:
    """Add ``served`` to the rows of :func:`stream_ttl`: misses beyond ``cap`` fall back.

    A hit counts only when the request that opened its window was admitted.
    """

    def spend(group, batches, state: GroupState):
        rows = _ordered(batches)
        spent, last_us, last_id = state.get if state.exists else (0, -1, -1)
        served = []
        for us, request_id, outcome, anchor in zip(
                _micros(rows["ts"]), rows["request_id"], rows["outcome"],
                zip(rows["anchor_us"], rows["anchor_id"])):
            if outcome == "miss" and (cap <= 0 or spent < cap):
                spent, last_us, last_id = spent + 1, int(us), int(request_id)
                served.append("llm")
            elif outcome == "hit" and anchor <= (last_us, last_id):
                served.append("cache_hit")
            else:
                served.append("fallback")
        state.update((spent, last_us, last_id))
        yield rows.assign(served=served)

    schema = _extended(outcomes, T.StructField("served", T.StringType()))
    return outcomes.groupBy(scope).applyInPandasWithState(
        spend, schema, "spent long, last_us long, last_id long", "append",
        GroupStateTimeout.NoTimeout)


def stream_metrics(requests: DataFrame, window: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Request metrics per tumbling window."""
    windowed = (requests.withWatermark("ts", lateness)
                .withColumn("window", F.window("ts", window)))
    return request_metrics(windowed, "window")
