"""Joins by nearness: theta matches, labelled intervals, as-of, grid neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_label(rows: DataFrame, position: str, intervals: DataFrame, width: float, first: str = "uncertain") -> DataFrame:
    """Label of the interval ``[lo, hi]`` that holds a row: ``first`` wins, else the last by ``seq``.

    ``intervals`` has ``lo, hi, label, seq``.  Both sides meet in buckets of ``width``, so the join is an
    equi-join with a filter, whatever the number of intervals.  Rows need a unique ``row_id``.
    """
    bucket = lambda c: F.floor(c / width).cast("long")
    spread = intervals.withColumn("_b", F.explode(F.sequence(bucket(F.col("lo")), bucket(F.col("hi")))))
    placed = rows.withColumn("_b", bucket(F.col(position)))
    hits = placed.join(spread, "_b").where((F.col(position) >= F.col("lo")) & (F.col(position) <= F.col("hi")))
    best = hits.groupBy("row_id").agg(F.max(F.struct((F.col("label") == first).alias("f"), "seq", "label")).alias("m"))
    return rows.join(best.select("row_id", F.col("m.label").alias("label")), "row_id", "left")


def as_of_nearest(rows: DataFrame, points: DataFrame, keys: list[str], position: str, value: str) -> DataFrame:
    """The value of the point nearest in position, the earlier of equals: two running windows, no join.

    ``points`` has ``keys``, ``position`` and ``value``; a point at a row's own position is nearest.
    """
    both = rows.withColumn("_is", F.lit(0)).unionByName(
        points.select(*keys, position, F.col(value).alias("_v"), F.lit(1).alias("_is")), allowMissingColumns=True
    )
    known = F.when(F.col("_is") == 1, F.struct(F.col(position).alias("x"), F.col("_v").alias("y")))
    up = Window.partitionBy(*keys).orderBy(F.col(position), F.col("_is").desc())
    down = Window.partitionBy(*keys).orderBy(F.col(position).desc(), F.col("_is").desc())
    before = F.last(known, ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(known, ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    got = both.withColumn("_lo", before).withColumn("_hi", after).where("_is = 0")
    x = F.col(position)
    pick = F.when(F.col("_hi").isNull(), F.col("_lo")).when(F.col("_lo").isNull(), F.col("_hi"))
    pick = pick.when(x - F.col("_lo.x") <= F.col("_hi.x") - x, F.col("_lo")).otherwise(F.col("_hi"))
    return got.withColumn("_m", pick).select(*rows.columns, F.col("_m.x").alias("model_position"), F.col("_m.y").alias(value))


def radius_pairs(points: DataFrame, keys: list[str], axes: list[str], point_id: str, reach: float) -> DataFrame:
    """Pairs ``(a, b, distance)``, a before b, within ``reach``, by a grid of that cell size.

    Each point meets the points of its own and half of the adjoining cells, so a pair is found once.
    """
    cell = [F.floor(F.col(c) / reach).cast("long") for c in axes]
    base = points.select(*keys, F.col(point_id).alias("id"), *[F.col(c).alias(f"x{k}") for k, c in enumerate(axes)], *[c.alias(f"c{k}") for k, c in enumerate(cell)])
    steps = [[]]
    for _ in axes:
        steps = [s + [d] for s in steps for d in (-1, 0, 1)]
    half = [s for s in steps if s >= [0] * len(axes)]
    near = base.withColumn("s", F.explode(F.array(*[F.array(*map(F.lit, s)) for s in half])))
    left = near.select(*keys, F.col("id").alias("p"), *[F.col(f"x{k}").alias(f"p{k}") for k in range(len(axes))], *[(F.col(f"c{k}") + F.col("s")[k]).alias(f"c{k}") for k in range(len(axes))], F.expr("forall(s, v -> v = 0)").alias("own"))
    right = base.select(*keys, F.col("id").alias("q"), *[F.col(f"x{k}").alias(f"q{k}") for k in range(len(axes))], *[f"c{k}" for k in range(len(axes))])
    d2 = sum(((F.col(f"p{k}") - F.col(f"q{k}")) * (F.col(f"p{k}") - F.col(f"q{k}")) for k in range(1, len(axes))), (F.col("p0") - F.col("q0")) * (F.col("p0") - F.col("q0")))
    met = left.join(right, [*keys, *[f"c{k}" for k in range(len(axes))]]).where("not own or p < q")
    met = met.withColumn("distance", F.sqrt(d2)).where(F.col("distance") <= reach)
    return met.select(*keys, F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "distance")


def near_in_time(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, reach: int, condition: Column) -> DataFrame:
    """Pairs of rows of one key whose times lie within ``reach`` and that meet a condition.

    Both sides meet in buckets of time, so a key with very many rows is dealt out, and no more pairs are formed than
    lie in neighbouring buckets.  Columns of the two sides, but the keys, must differ.
    """
    bucket = lambda c: F.floor(F.col(c) / reach).cast("long")
    a = left.withColumn("_b", F.explode(F.sequence(bucket(left_time) - 1, bucket(left_time) + 1)))
    met = a.join(right.withColumn("_b", bucket(right_time)), [*keys, "_b"])
    return met.where((F.abs(F.col(left_time) - F.col(right_time)) <= reach) & condition).drop("_b")
