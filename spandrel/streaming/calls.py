"""Calls that are pending until they are handled or escape, settled when their session ends well.

A log of each key, in the order of time and id.  ``call`` rows are pending; a ``handler`` row
handles all that are, an ``escape`` row lets them go where nobody can say.  A session ends
with a ``success`` row, which settles its calls (``handled``, ``escaped`` or ``unhandled``), or with a
``failure`` row or a pause longer than ``gap``, which discards them.  Calls of a session that
is still going are not settled.

``settled`` answers for a table, with windows.  ``settled_stream`` answers for a stream, with
state a key and event-time timers, and gives the same rows once the watermark has passed
them: rows wait in state, in any order of arrival, until the watermark says that nothing
earlier can come, and only then are folded in order.

Edge cases: rows with a null key, time or id are ignored, as are rows of other kinds, though
these do end a pause; rows of one time go by their id, repeated rows count each; a stream
drops what is later than the watermark; an empty log settles nothing.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: A row's part in the log.
CALL, HANDLER, ESCAPE, SUCCESS, FAILURE = "call", "handler", "escape", "success", "failure"


def settled(log: DataFrame, gap_seconds: int) -> DataFrame:
    """``(key, id, status, ended_by)`` of each settled call of ``log(key, ts, id, kind)``."""
    order = Window.partitionBy("key").orderBy("ts", "id")
    rows = log.filter("key IS NOT NULL AND ts IS NOT NULL AND id IS NOT NULL").select("key", F.col("ts").cast("timestamp").alias("ts"), "id", F.coalesce("kind", F.lit("")).alias("kind"))
    late = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order)) > gap_seconds * 1_000_000
    starts = F.lag("kind").over(order).isin(SUCCESS, FAILURE) | late
    sessions = rows.withColumn("_starts", F.coalesce(starts, F.lit(False)).cast("int")).withColumn("_session", F.sum("_starts").over(order))
    back = Window.partitionBy("key", "_session").orderBy(F.desc("ts"), F.desc("id"))
    after = back.rowsBetween(Window.unboundedPreceding, -1)
    told = sessions.withColumns({
        # Backwards, the last such row is the next one, and the first row of all is the session's end.
        "_next": F.last(F.when(F.col("kind").isin(HANDLER, ESCAPE), F.col("kind")), ignorenulls=True).over(after),
        "_end": F.first(F.struct("kind", "id")).over(back),
    })
    status = F.when(F.col("_next") == HANDLER, "handled").when(F.col("_next") == ESCAPE, "escaped").otherwise("unhandled")
    return told.filter((F.col("kind") == CALL) & (F.col("_end.kind") == SUCCESS)).select("key", "id", status.alias("status"), F.col("_end.id").alias("ended_by"))


class Settling(StatefulProcessor):
    """Keeps a key's rows that may still be overtaken, its open calls and its last time."""

    def __init__(self, gap_seconds: int):
        self.gap = gap_seconds * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, id bigint, kind string")
        self.calls = handle.getListState("calls", "id bigint, status string")
        self.last = handle.getValueState("last", "at bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            frame = frame[frame["ts"].notna() & frame["id"].notna()]
            at = frame["ts"].astype("datetime64[us]").astype("int64")
            self.waiting.appendList([(int(a), int(i), k or "") for a, i, k in zip(at, frame["id"], frame["kind"], strict=True)])
            for a in sorted(set(at)):
                self.handle.registerTimer(int(a) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs() * 1000
        waiting = sorted(tuple(r) for r in self.waiting.get())
        ready = [r for r in waiting if r[0] < upto]
        if not ready:
            return
        calls = [tuple(r) for r in self.calls.get()]
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        for at, i, kind in ready:
            if last is not None and at - last > self.gap:
                calls = []
            last = at
            if kind == CALL:
                calls.append((i, "unhandled"))
            elif kind in (HANDLER, ESCAPE):
                calls = [(c, s if s != "unhandled" else "handled" if kind == HANDLER else "escaped") for c, s in calls]
            elif kind in (SUCCESS, FAILURE):
                out += [(key[0], c, s, i) for c, s in calls] if kind == SUCCESS else []
                calls = []
        self._keep(self.waiting, waiting[len(ready) :])
        self._keep(self.calls, calls)
        self.last.update((last,))
        if out:
            yield pd.DataFrame(out, columns=["key", "id", "status", "ended_by"])

    @staticmethod
    def _keep(state, rows: list) -> None:
        state.clear()
        if rows:
            state.put(rows)

    def close(self) -> None:
        pass


def settled_stream(log: DataFrame, gap_seconds: int, late: str) -> DataFrame:
    """The rows of settled() of a streaming ``log(key, ts, id, kind)``, as the watermark passes the ends of sessions.  Needs the RocksDB state store."""
    # The processor goes along with the plan; executors need no copy of the package.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    key_type = log.schema["key"].dataType.simpleString()
    rows = log.filter("key IS NOT NULL AND ts IS NOT NULL AND id IS NOT NULL").select("key", F.col("ts").cast("timestamp").alias("ts"), F.col("id").cast("long").alias("id"), "kind").withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(Settling(gap_seconds), f"key {key_type}, id bigint, status string, ended_by bigint", "Append", "EventTime")
