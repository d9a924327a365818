"""Rays against triangles: the grid against every pair, whatever the cell, and odd faces."""

import numpy as np
import pytest

from rangeflow.operators import mesh as M

FACE = "scene int, face int, " + ", ".join(f"{c} double" for c in M.CORNERS)
BEAM = "scene int, beam int, dx double, dy double, dz double"


def every_pair(beams, faces):
    out = {}
    for scene, beam, *d in beams:
        if None in d or not any(d):
            continue
        d, best = np.array(d), None
        for other, face, *c in faces:
            if other != scene or any(v is None or not np.isfinite(v) for v in c):
                continue
            a, b, e = np.array(c).reshape(3, 3)
            e1, e2 = b - a, e - a
            p = np.cross(d, e2)
            det = e1 @ p
            if abs(det) <= 1e-12:
                continue
            q = np.cross(-a, e1)
            u, v, t = (-a @ p) / det, (d @ q) / det, (e2 @ q) / det
            if u >= 0 and v >= 0 and u + v <= 1 and t > 1e-9:
                best = min(best or (t, face), (t, face))
        if best:
            out[scene, beam] = best
    return out


def scene(seed, n_faces=40, n_beams=150):
    rng = np.random.default_rng(seed)
    at = rng.normal(0, 10, (n_faces, 1, 3))
    corners = at + rng.normal(0, 1, (n_faces, 3, 3)) * rng.choice([0.3, 2, 20], (n_faces, 1, 1))
    faces = [(seed, k, *map(float, c.ravel())) for k, c in enumerate(corners)]
    beams = [(seed, k, *map(float, rng.normal(0, 1, 3))) for k in range(n_beams)]
    beams += [(seed, 1000 + k, *d) for k, d in enumerate([(0.0, 0.0, 1.0), (0.0, 0.0, -2.0), (-1.0, 0.0, 0.0), (-1.0, -1e-12, 0.0), (1.0, 0.0, 0.0)])]
    beams += [(seed, 2000 + k, *map(float, c.mean(0))) for k, c in enumerate(corners)]  # at the middle of each face
    beams += [(seed, 3000 + k, *map(float, c[0] * 0.9999 + c[1:].mean(0) * 0.0001)) for k, c in enumerate(corners)]  # next to a corner
    return faces, beams


@pytest.mark.parametrize("cell", [1.0, 5.0, 45.0])
def test_equals_every_pair(spark, cell):
    faces, beams = (a + b for a, b in zip(scene(1), scene(2)))
    faces += [(1, 900, 5.0, 5.0, 5.0, -5.0, 5.0, 5.0, 0.0, -9.0, 5.0), (1, 901, 5.0, 5.0, -5.0, -5.0, 5.0, -5.0, 0.0, -9.0, -5.0), (1, 902, -7.0, 3.0, -1.0, -7.0, -3.0, -1.0, -7.0, 0.0, 4.0)]
    got = M.cast_rays(spark.createDataFrame(beams, BEAM), spark.createDataFrame(faces, FACE), ["scene"], ["beam"], "face", cell).collect()
    want = every_pair(beams, faces)
    assert len(got) == len(want) > 150
    assert all(want[r.scene, r.beam][1] == r.face and abs(want[r.scene, r.beam][0] - r.t) < 1e-9 * max(1, r.t) for r in got)


def test_few_faces_are_tested(spark):
    rng = np.random.default_rng(3)
    at = rng.uniform([5, -20, -5], [60, 20, 5], (500, 3))
    faces = [(0, k, *map(float, (a + rng.normal(0, 0.3, (3, 3))).ravel())) for k, a in enumerate(at)]
    beams = [(0, k, 1.0, float(rng.uniform(-0.5, 0.5)), float(rng.uniform(-0.1, 0.1))) for k in range(400)]
    b, f = spark.createDataFrame(beams, BEAM), spark.createDataFrame(faces, FACE)
    n = [r.n for r in M.cast_rays(b, f, ["scene"], ["beam"], "face", 1.0, tested=True).collect()]
    assert sum(n) < 0.05 * 400 * 500
    got = {(r.scene, r.beam): (r.t, r.face) for r in M.cast_rays(b, f, ["scene"], ["beam"], "face", 1.0).collect()}
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in every_pair(beams, faces).items()}


def test_odd_faces_and_beams(spark):
    wall = (10.0, -5.0, -5.0, 10.0, 5.0, -5.0, 10.0, 0.0, 9.0)
    faces = [(0, 2, *wall), (0, 1, *wall), (0, 3, None, *wall[1:]), (0, 4, float("nan"), *wall[1:]), (0, 5, float("inf"), *wall[1:]), (0, 6, *[0.0] * 9), (0, 7, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0), (0, 8, *[4.0] * 9), (1, 9, *wall)]
    beams = [(0, 1, 1.0, 0.0, 0.0), (0, 1, 1.0, 0.0, 0.0), (0, 2, 0.0, 0.0, 0.0), (0, 3, None, 1.0, 0.0), (0, 4, -1.0, 0.0, 0.0), (2, 5, 1.0, 0.0, 0.0)]
    got = M.cast_rays(spark.createDataFrame(beams, BEAM), spark.createDataFrame(faces, FACE), ["scene"], ["beam"], "face")
    assert [tuple(r) for r in got.collect()] == [(0, 1, 1, 10.0)]
    none = spark.createDataFrame([], FACE)
    assert M.cast_rays(spark.createDataFrame(beams, BEAM), none, ["scene"], ["beam"], "face").count() == 0
