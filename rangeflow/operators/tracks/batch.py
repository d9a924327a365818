"""Folds over whole recordings: one ordered pass a recording, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .core import new_state

#: One row a frame: what the folds read.
HITS = "array<struct<det:string,d:double,l:double,score:double,cls:string>>"
OUT = "i long, reset boolean, status string, distance double, tracks long, confirmed long, coasting long"


def frame_dict(row) -> dict:
    hits = [h if isinstance(h, dict) else h.asDict() for h in (row.hits if row.hits is not None else [])]
    return {"i": row.i, "stamp": None if pd.isna(row.stamp) else int(row.stamp), "unknown": bool(row.unknown), "hits": hits}


def fold(frames: DataFrame, step: Callable[[dict, dict], dict], key: str = "bag") -> DataFrame:
    """``key`` and the fold's output a frame, for ``(key, i, stamp, unknown, hits)``.

    Rows are dealt by key and sorted by ``i`` in Spark, so a recording streams through its task with one
    frame and the fold's state in memory, however long it is.
    """
    placed = frames.select(key, "i", "stamp", "unknown", "hits").repartition(key).sortWithinPartitions(key, "i")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                if state is None or getattr(row, key) != at:
                    at, state = getattr(row, key), new_state()
                out.append({key: at, "i": row.i, **step(state, frame_dict(row))})
            if out:
                yield pd.DataFrame(out)

    kind = dict(frames.dtypes)[key]
    return placed.mapInPandas(run, f"{key} {kind}, {OUT}")


def ordered_fold(rows: DataFrame, key: str, order: str, step: Callable[[dict, object], list[dict]], start: Callable[[], dict], out: str) -> DataFrame:
    """``key, order`` and the fields of ``out``: what ``step(state, row)`` gives for each row of a key in turn, state beginning as ``start()``.

    Rows stream through the key's task: one batch and the state are held, whatever the key's length.
    """
    names = [f.split()[0] for f in out.split(", ")]
    placed = rows.repartition(key).sortWithinPartitions(key, order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for b in batches:
            got = []
            for row in b.itertuples(index=False):
                name = getattr(row, key)
                if state is None or name != at:
                    at, state = name, start()
                got += [(name, getattr(row, order), *(r[n] for n in names)) for r in step(state, row)]
            if got:
                yield pd.DataFrame(got, columns=[key, order, *names])

    kinds = dict(rows.dtypes)
    return placed.mapInPandas(run, f"{key} {kinds[key]}, {order} {kinds[order]}, {out}")
