"""Watch of silent keys: rows of "unknown" at a steady pace while a key sends nothing, by timers of the state store.

A clock ticks at whole multiples of ``every_ms``.  A key that has sent nothing for over ``stale_ms`` gets an "unknown" row at each
tick until it speaks again; the first of a silence carries ``reset``, as what was tracked before it is void.  Expected keys that
never spoke are silent since their start (``initial``).  One timer a key is registered at a time, so keys that speak cost
no more than one state row and one timer.

``EventTime``: the clock is the watermark, so the result depends on the rows alone: a silence is told once the
watermark has passed its tick, or when the key's next row shows it.  ``ProcessingTime``: the clock is the machine's, rows count when they
arrive, and "unknown" comes while nothing arrives at all.

Cases: rows of a batch are taken in the order of their time, ties as they come; a null time counts as no row; a null key is a key;
rows later than the watermark are left out by Spark; a row before the key's last tick changes nothing but ends the silence.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Ticks of one output batch.
CHUNK = 10_000


def first_tick(last: int, stale: int, every: int) -> int:
    """The first multiple of ``every`` that is over ``stale`` after ``last``."""
    return ((last + stale) // every + 1) * every


class SilenceWatch(StatefulProcessor):
    """State of a key: when it spoke last, the tick that is due, and whether it ever spoke."""

    def __init__(self, key: str, stale_ms: int, every_ms: int, by_event: bool) -> None:
        self.key, self.stale, self.every, self.by_event = key, stale_ms, every_ms, by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("silence", "last long, due long, spoken boolean")

    def _ticks(self, key: tuple, last: int, due: int, until: int, spoken: bool) -> Iterator[pd.DataFrame]:
        """Rows of the ticks from ``due`` to ``until``."""
        first = first_tick(last, self.stale, self.every)
        for lo in range(due, until + 1, self.every * CHUNK):
            t = pd.Series(range(lo, min(until, lo + self.every * (CHUNK - 1)) + 1, self.every), dtype="int64")
            yield pd.DataFrame({self.key: [key[0]] * len(t), "tick_ms": t, "silent_ms": t - last, "reset": t == first, "reason": "stale" if spoken else "no input"})

    def _expect(self, last: int, due: int, spoken: bool, timer: int | None) -> None:
        if timer != due:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.state.update((last, due, spoken))

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        start = int(initialState["start_ms"].iloc[0])
        self._expect(start, first_tick(start, self.stale, self.every), False, None)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        times = sorted(int(t) for b in rows for t in b["ms"].tolist() if not pd.isna(t))
        if not times:
            return
        if not self.by_event:
            times = [timerValues.getCurrentProcessingTimeInMs()]
        last, due, spoken = self.state.get() or (None, None, True)
        timer = due
        for t in times:
            if last is not None:
                if due < t:
                    yield from self._ticks(key, last, due, t - 1, spoken)
                if t < last:
                    continue
            last, due, spoken = t, first_tick(t, self.stale, self.every), True
        self._expect(last, due, spoken, timer)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, due, spoken = self.state.get()
        now = timerValues.getCurrentWatermarkInMs() if self.by_event else timerValues.getCurrentProcessingTimeInMs()
        if due <= now:
            yield from self._ticks(key, last, due, now, spoken)
            self._expect(last, (now // self.every + 1) * self.every, spoken, None)

    def close(self) -> None:
        pass


def expected(keys: DataFrame, key: str, start_ms) -> GroupedData:
    """Keys that are expected to speak from ``start_ms`` on, for ``silence_watch``."""
    return keys.select(key, F.lit(start_ms).cast("long").alias("start_ms")).groupBy(key)


def silence_watch(frames: DataFrame, key: str, time: str, stale_ms: int, every_ms: int, mode: str = "EventTime", initial: GroupedData | None = None) -> DataFrame:
    """``key, tick_ms, silent_ms, reset, reason``: the ticks of silent keys of a stream; ``time`` is a timestamp with a watermark in mode ``EventTime``."""
    kind = dict(frames.dtypes)[key]
    src = frames.select(key, time, F.unix_millis(time).alias("ms")) if mode == "EventTime" else frames.select(key, F.lit(0).cast("long").alias("ms"))
    out = f"{key} {kind}, tick_ms long, silent_ms long, reset boolean, reason string"
    return src.groupBy(key).transformWithStateInPandas(SilenceWatch(key, stale_ms, every_ms, mode == "EventTime"), out, "append", mode, initialState=initial)
