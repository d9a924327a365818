"""Ego-motion: block-wise paths against the sequential one, curves against brute force, a ride of known shifts."""

import numpy as np
import pytest

from rangeflow.operators import motion as M


def sequential(e, change):
    acc, back, path = e[0].copy(), [], []
    for row in e[1:]:
        total = acc[:, None] + change
        back.append(total.argmin(0))
        acc = total.min(0) + row
    j = int(acc.argmin())
    for b in reversed(back):
        path.append(j)
        j = int(b[j])
    return [*path, j][::-1]


@pytest.mark.parametrize("m, n, block", [(7, 41, 6), (33, 100, 16), (5, 9, 100), (3, 1, 4), (4, 24, 8), (6, 17, 1)])
def test_blocks_give_the_sequential_path(spark, m, n, block):
    """Ties included: small costs that repeat, flat stretches, and recordings of several lengths."""
    rng = np.random.default_rng(m * n)
    change = M.smoothness(M.grid(0.0, 0.1 * (m - 1), 0.1), 0.3)
    assert len(change) == m
    rows, want = [], {}
    for bag in range(4):
        e = rng.integers(0, 4, (n + 3 * bag, m)) * 1000
        e[n // 2 : n // 2 + 5] = 0
        want[bag] = sequential(e, change)
        rows += [(bag, k, [int(v) for v in row]) for k, row in enumerate(e)]
    df = spark.createDataFrame(rows, "bag long, n long, e array<long>").repartition(5)
    got = M.least_cost_path(df, "bag", "n", "e", change, block)
    by_bag = {}
    for r in got.collect():
        by_bag.setdefault(r.bag, []).append((r.n, r.state))
    assert {b: [s for _, s in sorted(x)] for b, x in by_bag.items()} == want


def test_one_recording_uses_many_tasks(spark):
    df = spark.range(64).selectExpr("1L as bag", "id as n", "array(id % 3, 1L, 0L) as e")
    seen = []
    real = M.written
    try:
        M.written = lambda df, label, **k: seen.append((label, real(df, label, **k))) or seen[-1][1]
        M.least_cost_path(df, "bag", "n", "e", M.smoothness(M.grid(0.0, 0.2, 0.1), 0.1), block=4)
    finally:
        M.written = real
    assert [label for label, _ in seen] == ["motion-blocks", "motion-walks", "motion-path"]


def test_curves_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    low, step, m, trunc = -0.2, 0.1, 23, 0.3
    frames = {k: np.round(rng.uniform([0, -1, 0], [6, 1, 1], (40, 3)), 3) for k in range(3)}
    table = lambda shift, some: spark.createDataFrame([(k + shift, *map(float, p)) for k in some for p in frames[k]], "k int, d double, l double, h double")
    got = {r.k: r.costs for r in M.shift_costs(table(1, (0, 1)), table(0, (1, 2)), ["k"], low, step, m, trunc).collect()}
    assert set(got) == {1, 2}
    for k in got:
        a, b = frames[k - 1], frames[k]
        for j in range(m):
            q = b + [low + step * j, 0, 0]
            dist = np.sqrt(((q[:, None] - a[None]) ** 2).sum(2)).min(1)
            assert abs(np.minimum(dist, trunc).mean() - got[k][j]) < 1e-8


def test_ride_of_known_shifts(spark):
    rng = np.random.default_rng(1)
    world = np.column_stack([rng.uniform(0, 90, 2500), rng.uniform(-3.5, 3.5, 2500), rng.uniform(-0.5, 4, 2500)])
    where = np.cumsum([0, *(1.0 + 0.05 * np.sin(k / 3) for k in range(1, 9))])
    rows = []
    for k, at in enumerate(where):
        q = world - [at, 0, 0]
        q = q[(q[:, 0] > 0) & (q[:, 0] < (60 if k != 5 else 1.5))]  # the sixth frame sees no structure
        rows += [(1, k, *map(float, r)) for r in q + rng.normal(0, 0.01, q.shape)]
    rows += [(2, 0, 10.0, 0.0, 0.0)]  # a recording of one frame
    df = spark.createDataFrame(rows, "bag long, frame long, d double, l double, h double")
    got = sorted(M.segment_motion(df, "bag", "frame", block=3).collect(), key=lambda r: (r.bag, r.frame))
    ride = [r for r in got if r.bag == 1]
    assert len(ride) == 9 and [r.informative for r in ride] == [k not in (5, 6) for k in range(9)]
    assert all(abs(r.shift - d) < (0.005 if r.informative else 0.06) for r, d in zip(ride[1:], np.diff(where)))
    assert abs(ride[-1].position - where[-1]) < 0.1
    assert all((r.closure is not None) == (r.frame > 1 and r.frame % 2 == 0) for r in ride if r.informative and r.frame != 7)
    assert [(r.frame, r.shift, r.position) for r in got if r.bag == 2] == [(0, 0.0, 0.0)]


def test_no_points(spark):
    assert M.segment_motion(spark.createDataFrame([], "bag long, frame long, d double, l double, h double"), "bag", "frame").count() == 0
