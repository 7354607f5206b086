"""Pieces of closed sessions of a stream: rows gather in state by medium until no row can join them any more.

A session is a run of rows each at most gap after the end of those before it. It is closed once the
watermark has passed its end by more than gap: later rows can't reach it. Then it is split as a batch
would split it, at the best row ends in reach, and its rows leave the state. Rows behind the
watermark are late and dropped by Spark, which counts them; so are rows before time 0.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.intervals import merge_gap
from ..operators.segment import split_windows

PIECE = "media_id string, session_ms long, start_ms long, end_ms long"
AFTER = 1  # event time is so many ms after the row's start: at 0, where a watermark begins, Spark takes rows for late
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sessions_of(rows: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, cuts) of each run of rows (start, end, quality); cuts are (time, quality), in order of time."""
    out: list[list] = []
    for a, b, q in sorted(rows):
        if out and a - out[-1][1] <= gap:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b, []])
        out[-1][2].append((b, q))
    return [(a, b, sorted(c)) for a, b, c in out]


def borders(start: int, end: int, cuts: list[tuple[int, int]], least: int, most: int) -> list[int]:
    """Borders of the pieces of one session: each the best of quality, then time, in reach, else most after the last."""
    times, at = [t for t, _ in cuts], [start]
    while end - at[-1] > most:
        low, high = at[-1] + least, min(at[-1] + most, end - least)
        near = cuts[bisect.bisect_left(times, low) : bisect.bisect_right(times, high)] if high > low else []
        at.append(max((q, t) for t, q in near)[1] if near else at[-1] + most)
    return [*at, end]


def _frame(rows: list[tuple[str, int, int, int]]) -> pd.DataFrame:
    media, *times = zip(*rows)
    return pd.DataFrame({"media_id": pd.Series(media, dtype=object)} | {n: pd.Series(t, dtype="int64") for n, t in zip(("session_ms", "start_ms", "end_ms"), times)})


class Sessions(StatefulProcessor):
    """State of one medium: its rows that may still be joined, and the one timer that will look at them next."""

    def __init__(self, gap: int, least: int, most: int):
        self.gap, self.least, self.most = gap, least, most

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "a long, b long, q long")
        self.timer = handle.getValueState("timer", "at long")

    def _wake_at(self, reach: int) -> None:
        at = reach + self.gap + 1 + AFTER
        held = self.timer.get()[0] if self.timer.exists() else None
        if held is None or at < held:
            if held is not None:
                self.handle.deleteTimer(held)
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleInputRows(self, key, rows, timerValues):
        for part in rows:
            new = [tuple(map(int, r)) for r in part[["start_ms", "end_ms", "quality"]].itertuples(index=False)]
            if new:
                self.rows.appendList(new)
                self._wake_at(min(b for _, b, _ in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() - AFTER
        self.timer.clear()
        out, left = [], []
        rows = [tuple(r) for r in self.rows.get()] if self.rows.exists() else []
        for a, b, cuts in sessions_of(rows, self.gap):
            if b + self.gap < now:
                at = borders(a, b, cuts, self.least, self.most)
                out += [(str(key[0]), a, x, y) for x, y in zip(at, at[1:])]
            else:
                left.append((a, b))
        if left:
            first = min(a for a, _ in left)  # sessions are apart in time, so open rows are those from here on
            self.rows.put([r for r in rows if r[0] >= first])
            self._wake_at(min(b for _, b in left))
        else:
            self.rows.clear()
        return iter([_frame(out)] if out else ())

    def close(self) -> None:
        pass


def stream_pieces(stream: DataFrame, gap: int, least: int, most: int, late: str = "1 day") -> DataFrame:
    """media_id, session_ms (its start), start_ms, end_ms of the closed sessions of a stream (media_id, start_ms, end_ms, quality).

    Needs the RocksDB state store, which is set here. An end before its start counts as the start.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    s = stream.select(F.col("media_id").cast("string").alias("media_id"), "start_ms", F.greatest("start_ms", "end_ms").alias("end_ms"), F.col("quality").cast("long").alias("quality"))
    s = s.withColumn("at", F.timestamp_millis(F.col("start_ms") + AFTER)).withWatermark("at", late)
    return s.groupBy("media_id").transformWithStateInPandas(Sessions(gap, least, most), PIECE, "Append", "EventTime")


def batch_pieces(rows: DataFrame, gap: int, least: int, most: int, late_ms: int | None = None) -> DataFrame:
    """The same of a table. With late_ms, only sessions that a stream so late would have closed by now."""
    r = rows.select(F.col("media_id").cast("string").alias("media_id"), "start_ms", F.greatest("start_ms", "end_ms").alias("end_ms"), F.col("quality").cast("long").alias("quality"))
    runs = merge_gap(r, gap).drop("n")
    if late_ms is not None:
        newest = r.agg(F.max("start_ms")).first()[0]
        runs = runs.where(F.col("end_ms") + gap < (newest or 0) - late_ms)
    cuts = r.select("media_id", F.col("end_ms").alias("time_ms"), "quality")
    return split_windows(runs, cuts, least, most, named="session_ms")
