"""Ordered sequences on a stream: runs of equal states (survey G09) and adjacent differences
(G01), as windows give them over a table.

Rows of a key wait in its state until the watermark has passed them, and are then taken in
the order of time and ``order``; so rows that come out of order, within the watermark, change
nothing. Later ones are dropped, as by any stateful operator. A run ends with the first row of
another state, or by a timer once the watermark is ``idle`` past its last row. A key's state
holds the rows of the watermark's delay and one row more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

RUN = "key string, state string, first_us long, last_us long, n long"
STEP = "key string, us long, order long, value double, difference double"
_ROW = "us long, order long, state string, value double"


def _rows(events: DataFrame, key: str, ts: str, order: str, state: str | None, value: str | None) -> DataFrame:
    s = F.col(state).cast("string") if state else F.lit(None).cast("string")
    v = F.col(value).cast("double") if value else F.lit(None).cast("double")
    at = F.col(ts).cast("timestamp")
    return events.select(F.col(key).cast("string").alias("key"), at.alias("ts"), F.unix_micros(at).alias("us"), F.col(order).cast("long").alias("order"), s.alias("state"), v.alias("value")).filter("key is not null and ts is not null")


class _InOrder(StatefulProcessor):
    """Keeps rows until the watermark is past them; ``take`` gets them in order, with the row
    that ``last`` remembers, and ``quiet`` is asked what ends now."""

    last_schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _ROW)
        self.last = handle.getValueState("last", self.last_schema)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            self.waiting.appendList([(int(u), int(o), None if pd.isna(s) else str(s), None if pd.isna(v) else float(v)) for u, o, s, v in zip(part["us"], part["order"], part["state"], part["value"], strict=True)])
        yield from self._release(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release(key, timerValues)

    def _release(self, key, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        every = sorted(self.waiting.get(), key=lambda r: (r[0], r[1])) if self.waiting.exists() else []
        ready, later = [r for r in every if r[0] <= now], [r for r in every if r[0] > now]
        last = self.last.get() if self.last.exists() else None
        last, out = self.take(ready, last)
        last, ended = self.quiet(last, min([now, *(r[0] for r in later)]))
        if ready:
            self.waiting.clear()
            if later:
                self.waiting.appendList([tuple(r) for r in later])
        if last is None:
            self.last.clear()
        else:
            self.last.update(tuple(last))
        until = [r[0] for r in later[:1]] + self.ends(last)
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if until:
            self.handle.registerTimer(max(min(until) // 1000 + 1, now // 1000 + 1))
        if out or ended:
            yield pd.DataFrame([(key[0], *r) for r in [*out, *ended]], columns=self.columns)

    def quiet(self, last, now):
        return last, []

    def ends(self, last) -> list[int]:
        return []

    def close(self) -> None:
        pass


class _Runs(_InOrder):
    last_schema = "state string, first_us long, last_us long, n long"
    columns = ["key", "state", "first_us", "last_us", "n"]

    def __init__(self, idle_us: int):
        self.idle = idle_us

    def take(self, rows, last):
        out = []
        for us, _, state, _ in rows:
            if last is not None and last[0] == state and us - last[2] <= self.idle:
                last = (state, last[1], us, last[3] + 1)
            else:
                if last is not None:
                    out.append(tuple(last))
                last = (state, us, us, 1)
        return last, out

    def quiet(self, last, now):
        if last is not None and now - last[2] > self.idle:
            return None, [tuple(last)]
        return last, []

    def ends(self, last):
        return [last[2] + self.idle] if last is not None else []


class _Steps(_InOrder):
    last_schema = "value double"
    columns = ["key", "us", "order", "value", "difference"]

    def take(self, rows, last):
        out = []
        for us, order, _, value in rows:
            before = last[0] if last is not None else None
            out.append((us, order, value, None if value is None or before is None else value - before))
            last = (value,)
        return last, out


def _stateful(rows: DataFrame, late: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    """The session has to keep its state in RocksDB
    (``spark.sql.streaming.stateStore.providerClass``)."""
    return rows.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(processor, schema, "Append", "eventTime")


def _micros(interval: str) -> int:
    return int(pd.Timedelta(interval) / pd.Timedelta("1us"))


def state_runs(events: DataFrame, key: str, ts: str, order: str, state: str, idle: str, late: str = "2 hours") -> DataFrame:
    """Maximal runs of equal states of each key without a pause of more than ``idle``, in the
    order of ``ts`` and ``order``: (key, state, first_us, last_us, n). A null state is a state.
    Of a stream only runs that have ended."""
    rows = _rows(events, key, ts, order, state, None)
    if events.isStreaming:
        return _stateful(rows, late, _Runs(_micros(idle)), RUN)
    w = Window.partitionBy("key").orderBy("us", "order")
    same = F.lag("state").over(w).eqNullSafe(F.col("state")) & (F.col("us") - F.lag("us").over(w) <= _micros(idle))
    marked = rows.withColumn("new", F.coalesce((~same).cast("int"), F.lit(1)))
    runs = marked.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy("key", "run", "state").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("n"))
    return out.select("key", "state", "first_us", "last_us", "n")


def differences(events: DataFrame, key: str, ts: str, order: str, value: str, late: str = "2 hours") -> DataFrame:
    """Each row's value less that of the row before in its key: (key, us, order, value,
    difference), null for the first and beside a null."""
    rows = _rows(events, key, ts, order, None, value)
    if events.isStreaming:
        return _stateful(rows, late, _Steps(), STEP)
    w = Window.partitionBy("key").orderBy("us", "order")
    return rows.select("key", "us", "order", "value", (F.col("value") - F.lag("value").over(w)).alias("difference"))
