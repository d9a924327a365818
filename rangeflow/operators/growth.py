"""Growth of regions from seeds through points near each other, all regions at once, until no front is left.

A round looks for the points within a region's radius of its front; what is new is the next front.  A region whose box gets wider than
``max_extent`` in any direction, or which holds more than ``max_points`` points, has run into larger structure: it stops at
once and has no extent.  A region that goes on adds a point a round, so there are at most ``max_points`` rounds, each a few equi-joins on
cells whose cost follows the fronts.  A point near a front was reached with it, with the front before or not at all, as being near goes both
ways, so only these two are read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, written

_AXES = "dlh"


def _box(prefix: str = "") -> list:
    return [f(c).alias(f"{c}_{name}") for c in _AXES for name, f in (("lo", F.min), ("hi", F.max))]


def grow_regions(points: DataFrame, regions: DataFrame, seeds: DataFrame, key: str, cell: float, max_extent: float, max_points: int) -> DataFrame:
    """``key, region, n, rounds, ext_d, ext_l, ext_h`` of every region with a seed; extents are null where it grew past a limit.

    ``points``: ``key, point, d, l, h``.  ``regions``: ``key, region, radius`` (at most ``cell``) and the box it begins with, ``d_lo .. h_hi``,
    null where it has none.  ``seeds``: ``key, region, point``; repeated ones count once, unknown points not at all.
    """
    at = lambda c: F.floor(F.col(c) / cell)
    own = [at(c).alias(f"_c{c}") for c in _AXES]
    p = written(points.select(key, "point", *_AXES, *own), "growth-points")
    front = written(seeds.select(key, "region", "point").distinct().join(p, [key, "point"]).select(key, "region", "point", *_AXES), "growth-front")
    before = None
    start = regions.select(key, "region", "radius", *[F.col(f"{c}_{e}").cast("double").alias(f"{c}_{e}") for c in _AXES for e in ("lo", "hi")])
    state = start.withColumn("n", F.lit(0).cast("long")).withColumn("rounds", F.lit(0))
    over = F.greatest(*[F.col(f"{c}_hi") - F.col(f"{c}_lo") for c in _AXES]) > max_extent
    over = over | (F.col("n") > max_points)
    near = lambda c: F.explode(F.sequence(at(c) - 1, at(c) + 1)).alias(f"_c{c}")
    k = 0
    while True:
        new = front.groupBy(key, "region").agg(F.count(F.lit(1)).alias("m"), *[x.alias(f"_{name}") for x, name in zip(_box(), [f"{c}_{e}" for c in _AXES for e in ("lo", "hi")])])
        grown = state.join(new, [key, "region"], "left")
        sides = {f"{c}_{e}": (F.least if e == "lo" else F.greatest)(F.col(f"{c}_{e}"), F.col(f"_{c}_{e}")) for c in _AXES for e in ("lo", "hi")}
        last = state
        state = written(
            grown.select(key, "region", "radius", *[v.alias(c) for c, v in sides.items()], (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"), F.when(F.col("m").isNotNull(), F.lit(k)).otherwise(F.col("rounds")).alias("rounds")),
            "growth-state",
        )
        if k:
            discard(last)
        alive = state.where(~over).select(key, "region", "radius")
        wide = front.join(alive, [key, "region"])
        for c in _AXES:
            wide = wide.select("*", near(c))
        q = p.select(key, F.col("point").alias("to"), *[F.col(c).alias(f"t{c}") for c in _AXES], *[f"_c{c}" for c in _AXES])
        far = sum((F.pow(F.col(f"t{c}") - F.col(c), F.lit(2.0)) for c in _AXES[1:]), F.pow(F.col("td") - F.col("d"), F.lit(2.0)))
        found = wide.join(q, [key, *[f"_c{c}" for c in _AXES]]).where(far <= F.col("radius") * F.col("radius"))
        found = found.select(key, "region", F.col("to").alias("point"), *[F.col(f"t{c}").alias(c) for c in _AXES]).distinct()
        seen = front.select(key, "region", "point")
        if before is not None:
            seen = seen.unionByName(before.select(key, "region", "point"))
        new = written(found.join(seen, [key, "region", "point"], "left_anti"), "growth-front")
        if before is not None:
            discard(before)
        before, front = front, new
        if front.isEmpty():
            break
        k += 1
    ext = [F.when(~over, F.col(f"{c}_hi") - F.col(f"{c}_lo")).alias(f"ext_{c}") for c in _AXES]
    out = written(state.where("n > 0").select(key, "region", "n", "rounds", *ext), "growth-regions")
    discard(p, state, front, before)
    return out
