"""Rays against shapes, as column expressions: distances along a unit or any direction, null where a ray misses."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import box_distance, lit

Vector = tuple[Column, Column, Column]


def vector(x: float, y: float, z: float) -> Vector:
    return lit(x), lit(y), lit(z)


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def minus(a: Vector, b: Vector) -> Vector:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def turned(a: Vector, yaw_deg: float) -> Vector:
    """A vector turned about the third axis."""
    c, s = math.cos(math.radians(yaw_deg)), math.sin(math.radians(yaw_deg))
    return a[0] * c - a[1] * s, a[0] * s + a[1] * c, a[2]


def turned_box_distance(origin: Vector, direction: Vector, centre: tuple, half: tuple, yaw_deg: float) -> Column:
    """Distance to a box turned about the third axis."""
    o, v = turned(minus(origin, vector(*centre)), -yaw_deg), turned(direction, -yaw_deg)
    return box_distance(o, v, tuple(lit(-h) for h in half), tuple(lit(h) for h in half))


def _first_root(a: Column, b: Column, c: Column) -> Column:
    """Smaller root of a t^2 + 2 b t + c that is not negative, else the larger if that is not; null if neither."""
    disc = b * b - a * c
    root = F.sqrt(F.greatest(disc, lit(0)))
    near, far = (-b - root) / F.nullif(a, lit(0)), (-b + root) / F.nullif(a, lit(0))
    return F.when(disc >= 0, F.when(near >= 0, near).when(far >= 0, far))


def sphere_distance(origin: Vector, direction: Vector, centre: tuple, radius: float) -> Column:
    o = minus(origin, vector(*centre))
    return _first_root(dot(direction, direction), dot(o, direction), dot(o, o) - radius * radius)


def capsule_distance(origin: Vector, direction: Vector, foot: tuple, height: float, radius: float) -> Column:
    """Distance to an upright capsule: a cylinder over ``foot`` with a half sphere at both ends."""
    o = minus(origin, vector(*foot))
    side = _first_root(direction[0] * direction[0] + direction[1] * direction[1], o[0] * direction[0] + o[1] * direction[1], o[0] * o[0] + o[1] * o[1] - radius * radius)
    z = o[2] + side * direction[2]
    wall = F.when((z >= 0) & (z <= height), side)
    low = sphere_distance(origin, direction, foot, radius)
    high = sphere_distance(origin, direction, (foot[0], foot[1], foot[2] + height), radius)
    below, above = F.when(o[2] + low * direction[2] <= 0, low), F.when(o[2] + high * direction[2] >= height, high)
    return F.array_min(F.filter(F.array(wall, below, above), lambda t: t.isNotNull()))


def triangle_distance(origin: Vector, direction: Vector, a: tuple, b: tuple, c: tuple) -> Column:
    """Distance to a triangle by barycentric coordinates; both faces count."""
    u, v = (tuple(lit(q - p) for p, q in zip(a, x, strict=True)) for x in (b, c))
    h = cross(direction, v)
    det = dot(u, h)
    s = minus(origin, vector(*a))
    q = cross(s, u)
    inverse = 1.0 / F.nullif(det, lit(0))
    first, second, t = dot(s, h) * inverse, dot(direction, q) * inverse, dot(v, q) * inverse
    return F.when((F.abs(det) > 1e-9) & (first >= 0) & (second >= 0) & (first + second <= 1) & (t > 0), t)
