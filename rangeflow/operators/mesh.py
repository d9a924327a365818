"""Rays against tables of triangles: the nearest hit of each beam, through a grid of directions.

Every face is seen from the origin inside a cone (its corners' mean direction and the widest angle from that to a corner), and the cone
inside a box of azimuth and elevation cells.  A beam has one cell, so beams and faces meet in an equi-join on the cell, and only
what may hit is tested.  Where a face fills a cell, faces that begin behind it are left out there, so a beam meets those in front of the first
such face and not all of a scene's depth.  A face that is seen wide is cut into a grid of parts first, each with a cone of its own; the test is
always against the whole face.  Cones and boxes hold all of their face, so no hit is lost whatever the size of cells and parts.  Faces with the same
corners are one face, beams with the same direction are one beam until the first hit is known, so the work grows with different faces and directions.

Cases: a beam without direction or a face with a null or non-finite corner hits nothing; a face in a plane through the origin is seen edge on and
hit by nothing; of equal hits the least face wins; a beam that is there several times is told once, by its first hit; a face around or at the origin takes all cells.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

CORNERS = [f"{c}{k}" for k in range(3) for c in "xyz"]
#: Parts a side of a face at most: what is wider than that many parts' cones takes more cells.
PARTS = 32
Vec = tuple[Column, Column, Column]


def _sub(a: Vec, b: Vec) -> Vec:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def _dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _corner(k: int, prefix: str = "") -> Vec:
    return tuple(F.col(f"{prefix}{c}{k}") for c in "xyz")  # type: ignore[return-value]


def _angle(a: Vec, b: Vec) -> Column:
    """Angle between two directions, by the half-angle form that holds for small ones."""
    na, nb = F.sqrt(_dot(a, a)), F.sqrt(_dot(b, b))
    u, v = tuple(x * nb for x in a), tuple(x * na for x in b)
    p, q = _sub(u, v), tuple(x + y for x, y in zip(u, v))
    return 2 * F.atan2(F.sqrt(_dot(p, p)), F.sqrt(_dot(q, q)))  # type: ignore[arg-type]


def _cone(a: Vec, b: Vec, c: Vec) -> tuple[Vec, Column]:
    """Mean direction of three corners, and the widest angle from it to one of them."""
    unit = lambda v: tuple(F.try_divide(x, F.sqrt(_dot(v, v))) for x in v)
    m = tuple(x + y + z for x, y, z in zip(unit(a), unit(b), unit(c)))
    return m, F.greatest(*[_angle(m, v) for v in (a, b, c)])  # type: ignore[arg-type,return-value]


def face_cells(faces: DataFrame, keys: list[str], cell_deg: float) -> DataFrame:
    """``faces`` with ``_az`` and ``_el``: a row a cell of directions that the face may be seen in."""
    size = F.radians(F.lit(float(cell_deg)))
    finite = F.lit(True)
    for c in CORNERS:
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    f = faces.where(finite)
    _, wide = _cone(_corner(0), _corner(1), _corner(2))
    n = F.least(F.greatest(F.ceil(F.coalesce(F.nanvl(wide, F.lit(9.0)), F.lit(9.0)) / (2 * size)), F.lit(1)), F.lit(PARTS)).cast("int")
    f = f.withColumn("_n", n).withColumn("_p", F.explode(F.sequence(F.lit(0), F.col("_n") * F.col("_n") - 1)))
    # part (row i, place j) of n rows of 2 i + 1 triangles, corners in steps along the two sides from corner 0
    i = F.floor(F.sqrt(F.col("_p") + 0.5)).cast("int")
    j = F.col("_p") - i * i
    f = f.withColumn("_i", i).withColumn("_h", F.floor(j / 2).cast("int")).withColumn("_up", j % 2 == 0)

    def at(row: Column, place: Column) -> Vec:
        s, t = (row - place) / F.col("_n"), place / F.col("_n")
        return tuple(o + s * (p - o) + t * (q - o) for o, p, q in zip(_corner(0), _corner(1), _corner(2)))  # type: ignore[return-value]

    r, h, up = F.col("_i"), F.col("_h"), F.col("_up")
    parts = {"a": at(r, h), "b": at(r + 1, h + 1), "c": tuple(F.when(up, x).otherwise(y) for x, y in zip(at(r + 1, h), at(r, h + 1)))}
    f = f.withColumns({f"_{v}{c}": col for v, vec in parts.items() for c, col in zip("xyz", vec)})
    vec = lambda v: tuple(F.col(f"_{v}{c}") for c in "xyz")
    m, wide = _cone(vec("a"), vec("b"), vec("c"))
    f = f.withColumn("_w", F.coalesce(F.nanvl(wide, F.lit(9.0)), F.lit(9.0)) + 1e-9).withColumn("_ma", F.atan2(m[1], m[0])).withColumn("_me", F.atan2(m[2], F.sqrt(m[0] * m[0] + m[1] * m[1])))
    near_pole = (F.col("_w") > 1.3) | (F.abs(F.col("_me")) + F.col("_w") > 1.5)
    half = F.asin(F.try_divide(F.sin("_w"), F.cos("_me")))
    pi = 3.141592653589793
    az_lo = F.when(near_pole, F.lit(-pi)).otherwise(F.col("_ma") - half)
    az_hi = F.when(near_pole, F.lit(pi)).otherwise(F.col("_ma") + half)
    el_lo = F.when(F.col("_w") > 1.3, F.lit(-pi / 2)).otherwise(F.col("_me") - F.col("_w"))
    el_hi = F.when(F.col("_w") > 1.3, F.lit(pi / 2)).otherwise(F.col("_me") + F.col("_w"))
    cells = lambda lo, hi: F.sequence(F.floor(lo / size).cast("int"), F.floor(hi / size).cast("int"))
    around = int(round(360.0 / cell_deg))
    f = f.withColumn("_el", F.explode(cells(el_lo, el_hi))).withColumn("_az", F.explode(cells(az_lo, az_hi))).withColumn("_az", F.pmod("_az", F.lit(around)))
    return f.select(*faces.columns, "_az", "_el").distinct()


def in_front(cells: DataFrame, keys: list[str], cell_deg: float) -> DataFrame:
    """Rows of ``face_cells`` without those whose face lies behind another that fills the cell.

    A cell is held by a cone about its middle; a face fills it if the cone lies within the planes through the origin and the face's sides, and
    its plane's distances in the cone are between those at the least and the widest angle to the plane's normal.
    """
    size = F.radians(F.lit(float(cell_deg)))
    az, el = (F.col("_az") + 0.5) * size, (F.col("_el") + 0.5) * size
    d = cells.withColumns({"_mx": F.cos(el) * F.cos(az), "_my": F.cos(el) * F.sin(az), "_mz": F.sin(el)})
    m: Vec = (F.col("_mx"), F.col("_my"), F.col("_mz"))
    half = 2 * math.asin(min(1.0, math.sqrt(2.0) * math.sin(math.radians(cell_deg) / 4))) + 1e-6  # no direction of a cell is farther from its middle
    wide = F.lit(half)
    a, b, c = (_corner(k) for k in range(3))
    d = d.withColumns({f"_n{x}": v for x, v in zip("xyz", _cross(_sub(b, a), _sub(c, a)))})
    normal: Vec = (F.col("_nx"), F.col("_ny"), F.col("_nz"))
    d = d.withColumns({"_length": F.sqrt(_dot(normal, normal)), "_height": _dot(normal, a)})
    length, height = F.col("_length"), F.col("_height")
    side = F.signum(height)
    # in front of what fills a cell nothing else may be told by the limits of the test of a hit
    filled = F.lit(half < 1.5) & (F.abs(height) > 1e-2 * length)
    for p, q in ((a, b), (b, c), (c, a)):
        plane = _cross(p, q)
        # the sides' planes look inwards if the face is seen from the side its normal points away from
        filled = filled & (_dot(plane, m) * side > (F.sin(wide) + 1e-9) * F.sqrt(_dot(plane, plane)))
    d = d.withColumn("_upward", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(_dot(normal, m) * side, length)))))
    up = F.col("_upward")
    filled = filled & (up + wide < 1.57) & (length * F.cos(up + wide) > 1e-3)
    far = F.when(filled, F.try_divide(F.abs(height), length * F.cos(up + wide)))
    near = F.coalesce(F.try_divide(F.abs(height), length * F.cos(F.greatest(up - wide, F.lit(0.0)))), F.lit(0.0))
    near = F.when(up - wide < 1.57, F.nanvl(near, F.lit(0.0))).otherwise(0.0)
    d = written(d.withColumn("_near", near).withColumn("_far", far).select(*cells.columns, "_near", "_far"), "mesh-depths")
    bound = d.where("_far is not null and not isnan(_far)").groupBy(*keys, "_az", "_el").agg(F.min("_far").alias("_bound"))
    d = d.join(bound, [*keys, "_az", "_el"], "left")
    return d.where(F.col("_bound").isNull() | (F.col("_near") <= F.col("_bound") * (1 + 1e-9))).select(cells.columns)


def cast_rays(beams: DataFrame, faces: DataFrame, keys: list[str], beam: list[str], face: str, cell_deg: float = 2.0, tested: bool = False) -> DataFrame:
    """``keys, beam, face, t``: the first face that each beam hits, ``t`` in lengths of its direction; beams that hit nothing are absent.

    ``beams`` has ``keys, beam, dx, dy, dz`` from the origin, ``faces`` has ``keys, face`` and corners ``x0 .. z2``.  360 degrees must be a
    multiple of ``cell_deg``.  With ``tested`` it is ``keys, beam, n``: how many different faces each beam was tested against.
    """
    size = F.radians(F.lit(float(cell_deg)))
    way = [*keys, "dx", "dy", "dz"]
    d = (F.col("dx"), F.col("dy"), F.col("dz"))
    beams = beams.select(*keys, *beam, "dx", "dy", "dz").where("dx is not null and dy is not null and dz is not null and (dx <> 0 or dy <> 0 or dz <> 0)")
    b = beams.select(way).distinct()
    b = b.withColumn("_az", F.pmod(F.floor(F.atan2("dy", "dx") / size).cast("int"), F.lit(int(round(360.0 / cell_deg)))))
    b = b.withColumn("_el", F.floor(F.atan2(F.col("dz"), F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))) / size).cast("int"))
    # directions are few bytes and much work, so the number of tasks is told and not left to what bytes need
    spark = beams.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    b = b.repartition(tasks, *keys, "_az", "_el")
    # equal faces are hit at once, and of equal hits the least face wins
    alike = written(faces.groupBy(*keys, *CORNERS).agg(F.min(face).alias(face)).select(*keys, face, *CORNERS), "mesh-faces")
    g = written(face_cells(alike, keys, cell_deg), "mesh-cells")
    # with the beam from the origin, all but the direction is a face's own: three vectors and a number
    o, e1, e2 = _corner(0), _sub(_corner(1), _corner(0)), _sub(_corner(2), _corner(0))
    s = tuple(-x for x in o)
    q = _cross(s, e1)  # type: ignore[arg-type]
    own = {"_d": _cross(e2, e1), "_u": _cross(e2, s), "_v": q}  # type: ignore[arg-type]
    vectors = [*keys, face, "_az", "_el", *[x.alias(f"{name}{c}") for name, vec in own.items() for c, x in zip("xyz", vec)], _dot(e2, q).alias("_t")]
    # a beam so short or long that the limits below may pass over a face that fills its cell meets all faces of the cell
    usual = F.sqrt(_dot(d, d)).between(1e-8, 1e6)
    pairs = b.where(usual).join(in_front(g, keys, cell_deg).select(vectors), [*keys, "_az", "_el"])
    pairs = pairs.unionByName(b.where(~usual).join(g.select(vectors), [*keys, "_az", "_el"]))
    if tested:
        return beams.join(pairs.groupBy(way).agg(F.count(F.lit(1)).alias("n")), way).select(*keys, *beam, "n")
    det, u, v = (_dot(d, tuple(F.col(f"{name}{c}") for c in "xyz")) for name in own)  # type: ignore[arg-type]
    side = F.signum(det)
    hit = pairs.where((F.abs(det) > 1e-12) & (u * side >= 0) & (v * side >= 0) & ((u + v) * side <= F.abs(det)) & (F.col("_t") * side > F.abs(det) * 1e-9))
    best = hit.select(way + [F.try_divide("_t", det).alias("t"), F.col(face).alias("face")])
    # written, so that Spark knows the size of what it joins to the beams
    best = written(best.groupBy(way).agg(F.min(F.struct("t", "face")).alias("b")), "mesh-hits")
    told = beams.join(best, way).select(*keys, *beam, "b").repartition(*[F.col(c) for c in (*keys, *beam)])
    told = told.groupBy(*keys, *beam).agg(F.min("b").alias("b"))
    return told.select(*keys, *beam, F.col("b.face").alias(face), F.col("b.t").alias("t"))
