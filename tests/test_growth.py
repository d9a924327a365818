"""Regions grown to their end against brute force, limits, odd seeds, and pixel numbers."""

import numpy as np
import pytest

from rangeflow.operators.growth import grow_regions
from rangeflow.plans.image_queries import pixel_id

POINT = "frame int, point int, d double, l double, h double"
REGION = "frame int, region int, radius double, " + ", ".join(f"{c}_{e} double" for c in "dlh" for e in ("lo", "hi"))
NONE = (None,) * 6


def brute(points, regions, seeds, max_extent, max_points):
    out = {}
    for frame, region, radius, *box in regions:
        at = {p: np.array(x) for f, p, *x in points if f == frame}
        front = {p for f, r, p in seeds if (f, r) == (frame, region) and p in at}
        if not front:
            continue
        held, rounds, fits = set(front), 0, True
        sides = [x for x in box if x is not None]
        while True:
            pts = np.array([at[p] for p in held])
            lo, hi = pts.min(0), pts.max(0)
            if sides:
                lo, hi = np.minimum(lo, box[0::2]), np.maximum(hi, box[1::2])
            fits = (hi - lo).max() <= max_extent and len(held) <= max_points
            front = {q for q in at for p in front if ((at[q] - at[p]) ** 2).sum() <= radius * radius} - held
            if not fits or not front:
                break
            held |= front
            rounds += 1
        out[frame, region] = (len(held), rounds, *(np.round(hi - lo, 9) if fits else (None,) * 3))
    return out


def run(spark, points, regions, seeds, max_extent, max_points):
    g = grow_regions(spark.createDataFrame(points, POINT), spark.createDataFrame(regions, REGION), spark.createDataFrame(seeds, "frame int, region int, point int"), "frame", 1.0, max_extent, max_points)
    return {(r.frame, r.region): (r.n, r.rounds, *(None if x is None else round(x, 9) for x in (r.ext_d, r.ext_l, r.ext_h))) for r in g.collect()}


@pytest.mark.parametrize("max_extent, max_points", [(3.0, 30), (100.0, 10_000), (1.0, 5), (0.0, 0)])
def test_equals_brute_force(spark, max_extent, max_points):
    rng = np.random.default_rng(int(max_extent))
    points = [(f, k, *map(float, np.round(p, 3))) for f in range(3) for k, p in enumerate(rng.uniform([0, -2, 0], [12, 2, 1], (60, 3)))]
    regions = [(f, r, float(rng.uniform(0.3, 1.0)), *NONE) for f in range(3) for r in range(8)] + [(0, 90, 0.5, 1.0, 2.0, 0.0, 1.0, 0.0, 0.5)]
    seeds = [(f, r, int(rng.integers(0, 60))) for f in range(3) for r in range(8) for _ in range(r % 3 + 1)] + [(0, 90, 3), (0, 90, 3), (0, 7, 999), (2, 1, 999), (7, 1, 1)]
    assert run(spark, points, regions, seeds, max_extent, max_points) == brute(points, regions, seeds, max_extent, max_points)


def test_a_chain_grows_over_any_number_of_rounds(spark):
    points = [(0, k, k * 0.5, 0.0, 0.0) for k in range(25)]
    seeds, regions = [(0, 1, 0), (0, 2, 12)], [(0, 1, 0.6, *NONE), (0, 2, 0.6, *NONE)]
    assert run(spark, points, regions, seeds, 100.0, 1000) == {(0, 1): (25, 24, 12.0, 0.0, 0.0), (0, 2): (25, 12, 12.0, 0.0, 0.0)}
    assert run(spark, points, regions, seeds, 100.0, 9) == {(0, 1): (10, 9, None, None, None), (0, 2): (11, 5, None, None, None)}


def test_nothing_to_grow(spark):
    assert run(spark, [(0, 1, 0.0, 0.0, 0.0)], [(0, 1, 0.5, *NONE)], [], 1.0, 5) == {}
    assert run(spark, [], [(0, 1, 0.5, *NONE)], [(0, 1, 1)], 1.0, 5) == {}


def test_pixels_have_numbers_of_their_own(spark):
    rows = [(f, r, c) for f in (0, 1, 10**6) for r in (-1000, -1, 0, 1, 9000, 400_000) for c in (-5000, -400, 0, 600, 2048, 500_000)]
    df = spark.createDataFrame(rows, "frame long, row long, col long").withColumn("id", pixel_id("frame", "row", "col"))
    ids = [r.id for r in df.orderBy("frame", "row", "col").collect()]
    assert len(set(ids)) == len(rows) and ids == sorted(ids)
    with pytest.raises(Exception, match="outside the sides"):
        spark.createDataFrame([(0, 0, 10**6)], "frame long, row long, col long").select(pixel_id("frame", "row", "col")).collect()


def test_fronts_that_are_passed_are_dropped(spark, monkeypatch):
    """A round reads the last two fronts only, however many there were."""
    from rangeflow import session
    from rangeflow.operators import growth

    held = []
    real = growth.written

    def counted(df, label, **options):
        held.append(sum("growth-front" in path for path in session._live))
        return real(df, label, **options)

    monkeypatch.setattr(growth, "written", counted)
    points = spark.createDataFrame([(1, k, 0.5 * k, 0.0, 0.0) for k in range(9)], "frame int, point int, d double, l double, h double")
    box = ", ".join(f"{c}_{e} double" for c in "dlh" for e in ("lo", "hi"))
    regions = spark.createDataFrame([(1, 7, 0.6, *[None] * 6)], f"frame int, region int, radius double, {box}")
    seeds = spark.createDataFrame([(1, 7, 0)], "frame int, region int, point int")
    got = growth.grow_regions(points, regions, seeds, "frame", 1.0, 100.0, 100).collect()
    assert [(r.n, r.rounds, r.ext_d) for r in got] == [(9, 8, 4.0)] and max(held) == 2
