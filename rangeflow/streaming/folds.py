"""The folds on streams: arbitrary state a key, kept as JSON, with the code that serves batches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tracks.batch import OUT, frame_dict
from ..operators.tracks.core import new_state


def stream_fold(frames: DataFrame, step: Callable[[dict, dict], dict], key: str = "bag", silent_ms: int | None = None) -> DataFrame:
    """As ``operators.tracks.batch.fold`` for a stream of ``(key, i, stamp, unknown, hits)``.

    Within a micro-batch rows are taken by ``i``; a stamp that goes back begins a new sequence, it is
    never dropped as late.  With ``silent_ms`` a key that stays silent so long in processing time
    emits an "unknown" row (``i`` null) and begins anew.
    """
    kind = dict(frames.dtypes)[key]

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([{key: keys[0], "i": None, "reset": True, "status": "unknown", "distance": None, "tracks": 0, "confirmed": 0, "coasting": 0}])
            return
        kept = json.loads(state.get[0]) if state.exists else new_state()
        rows = sorted((r for b in batches for r in b.itertuples(index=False)), key=lambda r: r.i)
        out = [{key: keys[0], "i": r.i, **step(kept, frame_dict(r))} for r in rows]
        state.update((json.dumps(kept),))
        if silent_ms:
            state.setTimeoutDuration(silent_ms)
        if out:
            yield pd.DataFrame(out)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if silent_ms else GroupStateTimeout.NoTimeout
    return frames.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {OUT}", "state string", "append", timeout)


def stream_gaps(frames: DataFrame, key: str, order: str, time: str, tick: int) -> DataFrame:
    """``key, tick, missed``: a row for every ``tick`` that a key stays silent, as soon as it speaks again.

    ``time`` is a column of the input, so the result does not depend on when micro-batches run.
    """
    kind = dict(frames.dtypes)[key]

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for b in sorted((r for x in batches for r in x.itertuples(index=False)), key=lambda r: getattr(r, order)):
            now = int(getattr(b, time))
            if last is not None and now - last > tick:
                out += [(keys[0], last + m * tick, m) for m in range(1, (now - last - 1) // tick + 1)]
            last = now
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=[key, "tick", "missed"])

    return frames.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, tick long, missed long", "last long", "append", GroupStateTimeout.NoTimeout)


def freshest(batch: DataFrame, key: str, order: str) -> DataFrame:
    """Load shedding of a micro-batch, for ``foreachBatch``: only each key's newest row."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    w = Window.partitionBy(key).orderBy(F.desc(order))
    return batch.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
