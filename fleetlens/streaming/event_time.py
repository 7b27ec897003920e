"""Cache windows and fallback streaks in event time: rows of a key are settled in order, whatever order they arrive in.

Rows wait in a list state until the horizon, the latest time seen less ``lateness``, has passed them; an event-time timer
then settles them by ``(ts, request_id)``. A row that arrives at or before the horizon is late: its order has been decided. It
is not lost but comes out as ``late``, for a table of its own. Spark would drop such rows at its watermark
before any operator sees them, so the watermark lags by ``RETENTION`` and the timers are set ahead of it by the difference.
State per key: the rows within ``lateness``, one carried value, one timer; a carried value that no later row can need is cleared.

What is still waiting comes out once later rows, of any key, move the horizon on (a heartbeat does).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor

from fleetlens import catalogs

#: By how much Spark's watermark lags behind the latest row; what is older than that is dropped, so it is years.
RETENTION = 3650 * 86_400_000
_LONG = T.LongType()


def _millis(interval: str) -> int:
    amount, unit = interval.split()
    return int(amount) * {"second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000}[unit.rstrip("s")]


class _InOrder(StatefulProcessor):
    """Settles the buffered rows of a key in order; what is carried from row to row is up to the subclass."""

    carried: T.StructType
    added: tuple[str, ...]

    def __init__(self, row: T.StructType, lateness: int):
        self.row, self.ahead = row, RETENTION - lateness
        self.names = [*row.fieldNames(), "outcome", *self.added]
        self.us, self.id, self.path = (row.fieldNames().index(c) for c in ("us", "request_id", "path"))

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.carry = handle.getValueState("carry", self.carried)
        self.alarm = handle.getValueState("alarm", T.StructType([T.StructField("at", _LONG)]))

    def close(self) -> None:
        pass

    def _horizon(self, timers) -> int:
        return timers.getCurrentWatermarkInMs() + self.ahead

    def _wake(self, at_ms: int) -> None:
        """One timer a key, at the earliest time that is asked for."""
        now = self.alarm.get()[0] if self.alarm.exists() else None
        at = max(at_ms - self.ahead, 0)
        if now is None or at < now:
            if now is not None:
                self.handle.deleteTimer(now)
            self.handle.registerTimer(at)
            self.alarm.update((at,))

    def handleInputRows(self, key, rows, timerValues):
        # Before the first watermark every row is in time.
        horizon = self._horizon(timerValues) if timerValues.getCurrentWatermarkInMs() > 0 else -1
        fresh = []
        for row in rows:
            row = tuple(row[: len(self.row)])
            if row[self.us] // 1000 <= horizon:
                yield self._out(row, "late", (None,) * len(self.added))
            else:
                fresh.append(row)
        if fresh:
            self.waiting.appendList(fresh)
            self._wake(min(r[self.us] for r in fresh) // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.alarm.clear()
        horizon = self._horizon(timerValues)
        ready, later = [], []
        for row in self.waiting.get() if self.waiting.exists() else ():
            (ready if row[self.us] // 1000 <= horizon else later).append(tuple(row))
        self.waiting.clear()
        if later:
            self.waiting.put(later)
        carry = tuple(self.carry.get()) if self.carry.exists() else None
        for row in sorted(ready, key=lambda r: (r[self.us], r[self.id])):
            carry, outcome, more = self.step(carry, row)
            yield self._out(row, outcome, more)
        needed = None if carry is None else self.needed_until(carry)
        if carry is None or (needed is not None and needed <= horizon):
            self.carry.clear()
        else:
            self.carry.update(carry)
            if needed is not None and not later:
                self._wake(needed)
        if later:
            self._wake(min(r[self.us] for r in later) // 1000)

    def _out(self, row, outcome, more):
        return Row(**dict(zip(self.names, (*row, outcome, *more), strict=True)))

    def step(self, carry, row):
        """``(carry, outcome, added values)`` after a row."""
        raise NotImplementedError

    def needed_until(self, carry) -> int | None:
        """The time in milliseconds after which no row can depend on the carried value; None: always."""
        raise NotImplementedError


class _Ttl(_InOrder):
    carried = T.StructType([T.StructField("anchor_us", _LONG), T.StructField("anchor_id", _LONG)])
    added = ("anchor_us", "anchor_id")

    def __init__(self, row, lateness, ttl):
        super().__init__(row, lateness)
        self.width = ttl * 1_000_000

    def step(self, carry, row):
        miss = carry is None or row[self.us] > carry[0] + self.width
        carry = (row[self.us], row[self.id]) if miss else carry
        return carry, "miss" if miss else "hit", carry

    def needed_until(self, carry):
        return (carry[0] + self.width) // 1000 + 1


class _Streaks(_InOrder):
    carried = T.StructType([T.StructField("streak", _LONG)])
    added = ("streak",)

    def step(self, carry, row):
        before, path = carry[0] if carry else 0, row[self.path]
        carry = (0 if path in ("llm", "cache_hit") else before + (path == "fallback"),)
        return carry, "counted", carry

    def needed_until(self, carry):
        return -1 if carry == (0,) else None


def _in_order(requests: DataFrame, key: str, lateness: str, build) -> DataFrame:
    others = [c for c in requests.columns if c != "ts"]
    rows = requests.withWatermark("ts", f"{RETENTION // 1000} seconds").select(*others, F.unix_micros("ts").alias("us"), "ts")
    row = T.StructType([rows.schema[c] for c in (*others, "us")])
    processor = build(row, _millis(lateness))
    schema = T.StructType([*row.fields, T.StructField("outcome", T.StringType()), *[T.StructField(n, _LONG) for n in processor.added]])
    settled = rows.groupBy(key).transformWithState(processor, schema, "append", "eventTime")
    return settled.select(F.timestamp_micros("us").alias("ts"), *others, "outcome", *processor.added)


def stream_ttl(requests: DataFrame, key: str = "cache_key", ttl: int = catalogs.CACHE_TTL_SECONDS, lateness: str = "1 hour") -> DataFrame:
    """Every request once, with ``outcome`` ``miss``, ``hit`` or ``late``, and the request that opened its window."""
    return _in_order(requests, key, lateness, lambda row, late: _Ttl(row, late, ttl))


def stream_streaks(requests: DataFrame, scope: str, lateness: str = "1 hour") -> DataFrame:
    """Every request once, with ``streak``, the consecutive fallbacks of its scope so far, or ``outcome`` ``late``."""
    return _in_order(requests, scope, lateness, _Streaks)


def stream_alerts(requests: DataFrame, scope: str, lateness: str = "1 hour") -> DataFrame:
    """The requests of :func:`stream_streaks` at or over the threshold, and the late ones."""
    return stream_streaks(requests, scope, lateness).where(
        (F.col("streak") >= catalogs.FALLBACK_ALERT_THRESHOLD) | (F.col("outcome") == "late"))
