"""Ego-motion along the track: cost curves of frame pairs, and the least-cost path through them, split over tasks.

The shift between two frames is one of ``m`` grid points.  ``shift_costs`` gives every pair its cost a grid point from the points
themselves; ``least_cost_path`` picks the shifts of a recording together, so that they change little from pair to pair.  A path of
``n`` pairs is sequential, but in the (min, +) algebra it is a product of matrices, which is associative: blocks of pairs get their
matrices in parallel, the prefixes of a recording's few blocks are vectors times matrices, and then every block is walked in parallel
from its prefix.  Costs are whole numbers, so the blocks change nothing: the path is the sequential one, ties included (the least
index wins).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, written

#: Costs are rounded to this part of one.
UNIT = 1024


def grid(low: float, high: float, step: float) -> list[float]:
    return [low + step * k for k in range(int(np.floor((high - low) / step + 1e-9)) + 1)]


def smoothness(points: list[float], sigma: float) -> np.ndarray:
    """Costs of changing from one grid point to another: half the square of the change in ``sigma``, in ``UNIT``."""
    g = np.array(points)
    return np.floor(0.5 * ((g[:, None] - g[None, :]) / sigma) ** 2 * UNIT + 0.5).astype(np.int64)


def shift_costs(earlier: DataFrame, later: DataFrame, keys: list[str], low: float, step: float, m: int, trunc: float, counts: DataFrame | None = None) -> DataFrame:
    """``keys, costs``: the mean distance, at most ``trunc``, of the later frame's points to the earlier one's nearest, a shift.

    Both have ``keys, d, l, h``; points of one pair of frames meet in cells, along the track as wide as the grid, across it four ``trunc``
    wide, so that most of the later ones go to one or two.  A pair with an empty frame has no row.  ``counts``, where it is known, has ``keys, n``
    of the pairs without: the number of later points.
    """
    reach, wide = step * (m - 1) + 2 * trunc, 4 * trunc
    cell = lambda c: F.floor(c / wide)
    # one number goes before the keys, as rows sort by their first key's prefix, which all of a recording would share
    met = ["_at", *keys, "cd", "cl", "ch"]
    marked = lambda df: df.withColumn("_at", F.xxhash64(*met[1:]))
    a = marked(earlier.select(*keys, F.col("d").alias("da"), F.col("l").alias("la"), F.col("h").alias("ha"), F.floor(F.col("d") / reach).alias("cd"), cell(F.col("l")).alias("cl"), cell(F.col("h")).alias("ch")))
    b = later.withColumn("_id", F.monotonically_increasing_id())
    near = lambda c: F.explode(F.sequence(cell(F.col(c) - 1.001 * trunc), cell(F.col(c) + 1.001 * trunc)))
    first = F.floor((F.col("d") + low - trunc) / reach)
    cells = marked(b.withColumn("cd", F.explode(F.array(first, first + 1))).withColumn("cl", near("l")).withColumn("ch", near("h")))
    flat = F.pow(F.col("la") - F.col("l"), F.lit(2.0)) + F.pow(F.col("ha") - F.col("h"), F.lit(2.0))
    pairs = cells.join(a, met).withColumn("_flat", flat).where(F.col("_flat") < trunc * trunc)
    off = F.col("da") - F.col("d")
    from_, to = F.greatest(F.ceil((off - trunc - low) / step), F.lit(0)), F.least(F.floor((off + trunc - low) / step), F.lit(m - 1))
    at = pairs.where(from_ <= to).withColumn("j", F.explode(F.sequence(from_.cast("int"), to.cast("int"))))
    dist = F.sqrt(F.pow(off - (low + F.col("j") * step), F.lit(2.0)) + F.col("_flat"))
    best = at.groupBy(*keys, "_id", "j").agg(F.min(dist).alias("dist"))
    gain = best.where(F.col("dist") < trunc).groupBy(*keys, "j").agg(F.sum(trunc - F.col("dist")).alias("gain"))
    gains = gain.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("j", "gain"))).alias("gains"))  # ``m`` entries at most
    seen = later.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(earlier.select(*keys).distinct(), keys) if counts is None else counts
    one = lambda j: F.round(trunc - F.coalesce(F.try_element_at("gains", j), F.lit(0.0)) / F.col("n"), 9)  # noqa: E731  # whatever the order of the sum
    costs = seen.join(gains, keys, "left").withColumn("gains", F.coalesce("gains", F.create_map().cast("map<int,double>")))
    return costs.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(m - 1)), one).alias("costs"))


def scaled_costs(costs: Column, m: int) -> Column:
    """Whole-number costs over a curve's least one, in its own noise (three medians of the steps between neighbours); null gives a flat curve."""
    once = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  # ``f`` of a value that is computed once and not wherever ``f`` names it
    half = (m - 1) // 2
    steps = F.transform(F.sequence(F.lit(1), F.lit(m - 1)), lambda j: F.abs(F.get(costs, j) - F.get(costs, j - 1)))
    median = once(F.sort_array(steps), lambda o: o[half] if (m - 1) % 2 else (o[half - 1] + o[half]) / 2)
    scale = F.struct(F.array_min(costs).alias("least"), F.greatest(median * 3, F.lit(1e-4)).alias("noise"))
    scaled = once(scale, lambda s: F.transform(costs, lambda c: F.floor((c - s["least"]) / s["noise"] * UNIT + 0.5).cast("long")))
    return F.coalesce(scaled, F.array_repeat(F.lit(0).cast("long"), m))


def refined(costs: Column, j: Column, low: float, step: float, m: int) -> Column:
    """The vertex of the parabola through a curve's point and its neighbours, within half a step; the grid point where that is no local minimum."""
    at = low + j * step
    before, here, after = F.get(costs, j - 1), F.get(costs, j), F.get(costs, j + 1)
    bend = before - 2 * here + after
    off = F.greatest(F.lit(-0.5 * step), F.least(F.lit(0.5 * step), 0.5 * step * (before - after) / bend))
    return F.when((j > 0) & (j < m - 1) & (here <= before) & (here <= after) & (bend > 1e-12), at + off).otherwise(at)


def _walk(costs: np.ndarray, change: np.ndarray, acc: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Least costs at the last pair of a block by its state, and the state before each pair's (-1 at a recording's first pair)."""
    back = np.full(costs.shape, -1, np.int16)
    for k, e in enumerate(costs):
        if acc is None:
            acc = e.copy()
            continue
        total = acc[:, None] + change
        back[k] = total.argmin(0)
        acc = total[back[k], np.arange(len(e))] + e
    return acc, back


def _product(costs: np.ndarray, change: np.ndarray) -> np.ndarray:
    """The block's matrix: least costs from each state before it to each state at its end."""
    out = change + costs[0]
    for e in costs[1:]:
        out = np.stack([(row[:, None] + change).min(0) for row in out]) + e
    return out


def least_cost_path(curves: DataFrame, key: str, order: str, costs: str, change: np.ndarray, block: int = 256) -> DataFrame:
    """``key, order, state``: the states of each key's rows (``order`` counts from 0) of least cost: ``costs`` of a state, ``change`` between rows."""
    m = len(change)
    kind, place = dict(curves.dtypes)[key], dict(curves.dtypes)[order]
    ints = lambda raw, *shape: np.frombuffer(raw, np.int64).reshape(shape)
    # a number of tasks is given, as the blocks are few bytes and much work, and adaptive execution makes one task of few bytes
    tasks = int(curves.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    numbered = curves.select(key, order, costs, F.floor(F.col(order) / block).cast("long").alias("block")).repartition(tasks, key, "block")
    held = F.array_sort(F.collect_list(F.struct(order, costs)))  # ``block`` rows at most
    rows = numbered.groupBy(key, "block").agg(F.min(order).alias("first"), held.alias("rows"))
    blocks = written(rows.select(key, "block", "first", F.flatten(F.col(f"rows.{costs}")).alias("e")), "motion-blocks")

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for number, raw in zip(b["block"], b["e"]):
                e = np.reshape(raw, (-1, m))
                out.append((_walk(e, change, None)[0] if number == 0 else _product(e, change)).tobytes())
            yield pd.DataFrame({key: b[key], "block": b["block"], "matrix": out})

    def in_order(df: DataFrame) -> DataFrame:
        return df.repartition(tasks, key).sortWithinPartitions(key, "block")

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Streams a key's blocks: only the vector before the next one is held."""
        acc = None
        for b in batches:
            out = []
            for number, raw in zip(b["block"], b["matrix"]):
                out.append(None if number == 0 else acc.tobytes())
                acc = ints(raw, m) if number == 0 else (acc[:, None] + ints(raw, m, m)).min(0)
            yield pd.DataFrame({key: b[key], "block": b["block"], "before": out})

    start = in_order(blocks.select(key, "block", "e").mapInPandas(products, f"{key} {kind}, block long, matrix binary")).mapInPandas(prefixes, f"{key} {kind}, block long, before binary")
    walked = written(blocks.join(start, [key, "block"]).repartition(tasks, key, "block"), "motion-walks")

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The state before the block by the state at its end, and the best end."""
        for b in batches:
            origin, best = [], []
            for raw, before in zip(b["e"], b["before"]):
                acc, back = _walk(np.reshape(raw, (-1, m)), change, None if before is None else ints(before, m))
                at = np.arange(m)
                for row in back[::-1]:
                    at = np.where(at >= 0, row[at], -1)
                origin.append(at.astype(np.int64).tobytes())
                best.append(int(acc.argmin()))
            yield pd.DataFrame({key: b[key], "block": b["block"], "origin": origin, "best": best})

    def backwards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Streams a key's blocks from its last one: the state at a block's end is where the next one came from."""
        held, state = (), -1
        for b in batches:
            out = []
            for name, raw, best in zip(b[key], b["origin"], b["best"]):
                if (name,) != held:
                    held, state = (name,), best
                out.append(state)
                state = int(ints(raw, m)[state])
            yield pd.DataFrame({key: b[key], "block": b["block"], "end": out})

    last = walked.mapInPandas(ends, f"{key} {kind}, block long, origin binary, best int")
    last = last.repartition(tasks, key).sortWithinPartitions(F.col(key), F.desc("block")).mapInPandas(backwards, f"{key} {kind}, block long, end int")

    def states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for first, raw, before, end in zip(b["first"], b["e"], b["before"], b["end"]):
                _, back = _walk(np.reshape(raw, (-1, m)), change, None if before is None else ints(before, m))
                path = np.empty(len(back), np.int64)
                for k in range(len(back) - 1, -1, -1):
                    path[k] = end
                    end = int(back[k][end])
                out.append((first + np.arange(len(path)), path))
            if out:
                yield pd.DataFrame({key: np.repeat(b[key].to_numpy(), [len(p) for _, p in out]), order: np.concatenate([n for n, _ in out]), "state": np.concatenate([p for _, p in out])})

    ended = walked.join(last, [key, "block"]).repartition(tasks, key, "block")
    out = written(ended.mapInPandas(states, f"{key} {kind}, {order} {place}, state long"), "motion-path")
    discard(blocks, walked)
    return out


def segment_motion(points: DataFrame, key: str, frame: str, low: float = -0.2, high: float = 3.0, step: float = 0.02, sigma: float = 0.03, trunc: float = 0.15, block: int = 256, check: bool = True) -> DataFrame:
    """``key, frame, shift, position, informative, closure``: how far each frame is along the track after the one before.

    ``points`` has ``key, frame, d, l, h`` with frames counted from 0.  ``closure`` is, on every second frame, how far the shift over two frames (looked
    for within half a metre) is from the sum of its two, and left out without ``check``; frames without structure are bridged by the smoothness alone.
    """
    p = points.select(key, F.col(frame).alias("k"), "d", "l", "h")
    is_seen, is_structure = F.expr("d > 2 and d < 50 and abs(l) < 4.5 and h > -1"), F.expr("d > 4 and d < 45 and abs(l) < 4 and h > -0.9")
    tally = written(p.groupBy(key, "k").agg(F.count_if(is_structure).alias("n"), F.count_if(is_seen).alias("seen")), "motion-frames")
    seen = written(p.where(is_seen), "motion-points")  # and so all structure
    structure = seen.where(is_structure)
    after = lambda df, lag: df.withColumn("k", F.col("k") + lag)
    counts = lambda lag: tally.where("n > 0").select(key, "k", "n").join(after(tally.where("seen > 0").select(key, "k"), lag), [key, "k"])
    g, g2 = grid(low, high, step), grid(low, 2 * high, step)
    frames = tally.groupBy(key).agg(F.max("k").alias("last")).where("last > 0").select(key, F.explode(F.sequence(F.lit(1).cast("long"), F.col("last").cast("long"))).alias("k"))
    one = shift_costs(after(seen, 1), structure, [key, "k"], low, step, len(g), trunc, counts(1))
    curves = frames.join(one, [key, "k"], "left")
    curves = written(curves.select(key, (F.col("k") - 1).alias("n"), "costs", scaled_costs(F.col("costs"), len(g)).alias("scaled")), "motion-curves")
    path = least_cost_path(curves, key, "n", "scaled", smoothness(g, sigma), block)
    j = F.col("state")
    found = curves.join(path, [key, "n"]).select(key, (F.col("n") + 1).alias("k"), F.coalesce(refined(F.col("costs"), j, low, step, len(g)), low + j * step).alias("shift"), F.col("costs").isNotNull().alias("informative"))
    start = tally.groupBy(key).agg(F.lit(0).cast("long").alias("k")).select(key, "k", F.lit(0.0).alias("shift"), F.lit(True).alias("informative"))
    w = Window.partitionBy(key).orderBy("k")
    steps = found.unionByName(start).withColumn("position", F.sum("shift").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if not check:
        discard(seen)
        return steps.select(key, F.col("k").alias(frame), "shift", "position", "informative")
    steps = steps.withColumn("two", F.when(F.col("k") % 2 == 0, F.col("shift") + F.lag("shift").over(w)))
    even = F.col("k") % 2 == 0
    two = written(shift_costs(after(seen.where(even), 2), structure.where(even), [key, "k"], low, step, len(g2), trunc, counts(2).where(even)), "motion-check")
    discard(seen)
    half = int(round(0.5 / step))
    at = F.least(F.greatest(F.floor((F.col("two") - low) / step + 0.5).cast("int"), F.lit(0)), F.lit(len(g2) - 1))
    lo, hi = F.greatest(at - half, F.lit(0)), F.least(at + half, F.lit(len(g2) - 1))
    window = F.slice("costs", lo + 1, hi - lo + 1)
    best = lo + F.array_position(window, F.array_min(window)).cast("int") - 1
    closure = F.abs(low + best * step - F.col("two"))
    got = steps.join(two, [key, "k"], "left")
    return got.select(key, F.col("k").alias(frame), "shift", "position", "informative", F.when(F.col("k") > 1, closure).alias("closure"))
