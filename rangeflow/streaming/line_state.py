"""The line model as a stream: state in the state store, the step that the batch form uses.

A key's two short lists of models and its values are one state variable, as each call to the store costs more than its few bytes.  With ``idle_ms`` keys that
stay silent for so much of the machine's time are dropped by the store; such a stream runs on its clock and so has no end of input.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.tracks.line import OUT, LineRules, line_step, new_line


def line_frame(row) -> dict:
    known = lambda v: None if pd.isna(v) else v
    stamp = known(row.stamp)
    return {"stamp": None if stamp is None else int(stamp), "still": known(row.still), "b": known(row.b), "reach": known(row.reach)}


class LineModel(StatefulProcessor):
    """One key's line model."""

    def __init__(self, key: str, order: str, rules: LineRules, idle_ms: int | None) -> None:
        self.key, self.order, self.rules, self.idle = key, order, rules, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.model = handle.getValueState("model", "model string", self.idle)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kept = self.model.get()
        state = new_line() if kept is None else json.loads(kept[0])
        parts = list(rows)
        frames = parts[0] if len(parts) == 1 else pd.concat(parts)
        if not frames[self.order].is_monotonic_increasing:
            frames = frames.sort_values(self.order, kind="stable")
        out = [{self.key: key[0], self.order: getattr(r, self.order), **line_step(state, line_frame(r), self.rules)} for r in frames.itertuples(index=False)]
        self.model.update((json.dumps(state),))
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def stream_lines(frames: DataFrame, key: str, order: str, rules: LineRules = LineRules(), idle_ms: int | None = None) -> DataFrame:
    """As ``ordered_fold`` of ``line_step``, for a stream of ``key, order, stamp, still, b, reach`` whose batches follow each other in order."""
    kinds = dict(frames.dtypes)
    out = f"{key} {kinds[key]}, {order} {kinds[order]}, {OUT}"
    mode = "None" if idle_ms is None else "ProcessingTime"
    return frames.select(key, order, "stamp", "still", "b", "reach").groupBy(key).transformWithStateInPandas(LineModel(key, order, rules, idle_ms), out, "append", mode)
