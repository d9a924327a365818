"""Connected components on an edge table, for graphs of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, written


def connected_components(
    edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, rounds: int | None = None
) -> DataFrame:
    """Label every vertex of ``edges`` with the smallest vertex id it can reach.

    Returns a written table ``(id, component)``; vertices without an edge are absent.  Rows with a null end are
    ignored, self loops only make their vertex appear, duplicate edges change nothing.

    With ``rounds`` it stops after so many: equal labels are then connected, but not all that is
    connected has equal labels yet.

    Alternating large-star / small-star rounds: every round rewires each vertex to the smallest
    neighbour it knows, so the number of rounds grows with the logarithm of the diameter.  Both
    halves are a ``groupBy(min)`` plus an equi-join that adaptive execution may split when one
    vertex is hot.  Each round is written to the shared folder, which cuts the lineage, and its
    predecessor deleted.
    """
    both = written(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null"), "cc-input")
    vertices = both.select(F.col("a").alias("id")).union(both.select("b")).distinct()
    e = written(both.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc-edges")
    state = None
    for k in range(max_rounds):
        # large-star: neighbours above a vertex hang on the smallest vertex of its neighbourhood
        sym = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        large = sym.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small-star: neighbours below a vertex, and the vertex, hang on the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        old, e = e, written(small.where("a <> b").distinct(), "cc-edges")
        discard(old)
        if rounds is not None:
            if k + 1 == rounds:
                break
            continue
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    labels = e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    out = written(vertices.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component")), "cc-labels")
    discard(both, e)
    return out


#: Edges that a task holds at once.
HELD = 200_000


def _least(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of some edges, each with the least that they connect it to."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(ids)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        x, y = root(x), root(y)
        up[max(x, y)] = min(x, y)
    return ids, ids[[root(x) for x in range(len(ids))]]


def grouped_components(edges: DataFrame, group: str, src: str, dst: str, held: int = HELD) -> DataFrame:
    """``connected_components`` of edges that never leave a ``group``, mostly in one pass over them.

    A task holds ``held`` edges at a time, of whole groups where they fit.  A group of more is brought to stars piece by
    piece, and the stars are joined in rounds.
    """
    e = edges.select(group, F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, split = None, None  # rows of the last group, and the group that was cut

        def told(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            part = rows[group] == split
            for some, whole in ((rows[~part], True), (rows[part], False)):
                if len(some):
                    ids, least = _least(some["a"].to_numpy(), some["b"].to_numpy())
                    yield pd.DataFrame({"id": ids, "component": least, "whole": whole})

        for b in batches:
            rest = b if rest is None else pd.concat([rest, b], ignore_index=True)
            if len(rest) < held:
                continue
            last = rest[group] == rest[group].iloc[-1]
            if last.all():
                split = rest[group].iloc[-1]
                yield from told(rest)
                rest = None
            else:
                yield from told(rest[~last])
                rest = rest[last]
        if rest is not None:
            yield from told(rest)

    got = written(e.repartition(group).sortWithinPartitions(group).mapInPandas(run, "id long, component long, whole boolean"), "cc-groups")
    done, cut = got.where("whole").select("id", "component"), got.where("not whole")
    if cut.isEmpty():
        return done
    return done.unionByName(connected_components(cut, "id", "component"))
