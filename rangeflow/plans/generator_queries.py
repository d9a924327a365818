"""Queries of the synthetic generator: shapes, meshes, beams, dust, insertion styles, labels, placement, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rays as R
from ..functions.dust import soft_return
from ..operators import islands as isl
from ..session import written
from .views import FR, PT, V3, frames, points, vectors

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {PT}, w AS (SELECT frame, d, greatest(0e0, least(1e0, (d - 60) / 40e0)) AS weight, 80e0 + frame % 50 AS support, CASE WHEN frame % 3 = 0 THEN 150e0 END AS ext FROM pt)
SELECT frame, round(sum(weight), 4) AS weights, round(avg(h), 4) AS height, max(reach) AS reach FROM (SELECT frame, weight, (1 - weight) * 0.1e0 * d + weight * 6e0 AS h, least(300e0, greatest(support, coalesce(ext, 0e0))) AS reach FROM w) GROUP BY frame""")
def extension_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that hands over to its extension by a ramp, and how far the corridor is supported."""
    weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("d") - 60) / 40.0))
    reach = F.least(F.lit(300.0), F.greatest(80.0 + F.col("frame") % 50, F.coalesce(F.when(F.col("frame") % 3 == 0, 150.0), F.lit(0.0))))
    return points(spark, sf_dir).groupBy("frame").agg(F.round(F.sum(weight), 4).alias("weights"), F.round(F.avg((1 - weight) * 0.1 * F.col("d") + weight * 6.0), 4).alias("height"), F.max(reach).alias("reach"))


@query(f"""WITH {PT}, u AS (SELECT frame, r, ((slot * 7919 + frame * 104729) % 997 + 1) / 998e0 AS a, ((slot * 6151 + frame * 3571) % 991) / 991e0 AS b FROM pt),
z AS (SELECT frame, greatest(1e0, least(255e0, round_even(2e0 * r * exp(0.4e0 * sqrt(-2e0 * ln(a)) * cos(2e0 * pi() * b)), 0))) AS i FROM u) SELECT frame, sum(i) AS total, min(i) AS low, max(i) AS high, count(*) FILTER (i = 255) AS saturated FROM z GROUP BY frame""")
def intensity_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intensities with log-normal noise drawn from keys, rounded and clipped to a byte."""
    a = ((F.col("slot") * 7919 + F.col("frame") * 104729) % 997 + 1) / 998.0
    b = ((F.col("slot") * 6151 + F.col("frame") * 3571) % 991) / 991.0
    i = F.greatest(F.lit(1.0), F.least(F.lit(255.0), F.rint(2.0 * F.col("r") * F.exp(0.4 * C.standard_normal(a, b)))))
    return points(spark, sf_dir).select("frame", i.alias("i")).groupBy("frame").agg(F.sum("i").alias("total"), F.min("i").alias("low"), F.max("i").alias("high"), F.count_if(F.col("i") == 255).alias("saturated"))


def _root_sql(a: str, b: str, c: str) -> str:
    disc = f"(({b})*({b}) - ({a})*({c}))"
    near, far = f"((-({b}) - sqrt(greatest({disc}, 0e0))) / ({a}))", f"((-({b}) + sqrt(greatest({disc}, 0e0))) / ({a}))"
    return f"CASE WHEN {disc} >= 0 THEN CASE WHEN {near} >= 0 THEN {near} WHEN {far} >= 0 THEN {far} END END"


_D2 = "e0*e0+e1*e1+e2*e2"


@query(f"""WITH {V3}, t AS (SELECT *, cos(radians(30)) * e0 + sin(radians(30)) * e1 AS u0, -sin(radians(30)) * e0 + cos(radians(30)) * e1 AS u1, cos(radians(30)) * -2e0 + sin(radians(30)) * -0.5e0 AS o0, -sin(radians(30)) * -2e0 + cos(radians(30)) * -0.5e0 AS o1 FROM v3 WHERE e0 <> 0 AND e1 <> 0 AND e2 <> 0),
s AS (SELECT *, greatest(0e0, least((-1e0 - o0) / u0, (1e0 - o0) / u0), least((-0.5e0 - o1) / u1, (0.5e0 - o1) / u1), least(-0.8e0 / e2, 0.8e0 / e2)) AS near, least(greatest((-1e0 - o0) / u0, (1e0 - o0) / u0), greatest((-0.5e0 - o1) / u1, (0.5e0 - o1) / u1), greatest(-0.8e0 / e2, 0.8e0 / e2)) AS far FROM t),
h AS (SELECT vec_id, CASE WHEN near <= far THEN near END AS box, {_root_sql(_D2, "1.5e0*e0 + -2e0*e1 + 0.2e0*e2", "1.5e0*1.5e0+4e0+0.04e0-0.81e0")} AS ball,
  {_root_sql("e0*e0+e1*e1", "0.5e0*e0 + 2.5e0*e1", "0.25e0+6.25e0-0.36e0")} AS wall, {_root_sql(_D2, "0.5e0*e0 + 2.5e0*e1 + 1e0*e2", "0.25e0+6.25e0+1e0-0.36e0")} AS low, {_root_sql(_D2, "0.5e0*e0 + 2.5e0*e1 + -0.5e0*e2", "0.25e0+6.25e0+0.25e0-0.36e0")} AS high, e2 FROM s),
c AS (SELECT vec_id, box, ball, least(CASE WHEN 1e0 + wall * e2 BETWEEN 0 AND 1.5e0 THEN wall END, CASE WHEN 1e0 + low * e2 <= 0 THEN low END, CASE WHEN 1e0 + high * e2 >= 1.5e0 THEN high END) AS capsule FROM h)
SELECT vec_id, round(box, 5) AS box, round(ball, 5) AS ball, round(capsule, 5) AS capsule, round(least(box, ball, capsule), 5) AS nearest FROM c WHERE box IS NOT NULL OR ball IS NOT NULL OR capsule IS NOT NULL""")
def ray_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where directions from the origin meet a turned box, a ball and an upright capsule."""
    o, v = R.vector(0, 0, 0), (F.col("e0"), F.col("e1"), F.col("e2"))
    box = R.turned_box_distance(o, v, (2.0, 0.5, 0.0), (1.0, 0.5, 0.8), 30.0)
    ball = R.sphere_distance(o, v, (-1.5, 2.0, -0.2), 0.9)
    capsule = R.capsule_distance(o, v, (-0.5, -2.5, -1.0), 1.5, 0.6)
    c = vectors(spark, sf_dir).where("e0 <> 0 and e1 <> 0 and e2 <> 0").select("vec_id", box.alias("box"), ball.alias("ball"), capsule.alias("capsule"))
    c = c.where("box is not null or ball is not null or capsule is not null")
    return c.select("vec_id", *[F.round(x, 5).alias(x) for x in ("box", "ball", "capsule")], F.round(F.least("box", "ball", "capsule"), 5).alias("nearest"))


_FACES = [((2, -1, -1), (2, 1, -1), (2, 0, 1.5)), ((-2, -2, -1), (-2, 2, -1), (-1.5, 0, 2)), ((-1, 2, -1), (1, 2, -1), (0, 2.5, 1)), ((-1, -3, -2), (1, -3, -2), (0, -2, 2))]


def _triangle_sql(a: tuple, b: tuple, c: tuple) -> str:
    u, v, s = [q - p for p, q in zip(a, b)], [q - p for p, q in zip(a, c)], [-p for p in a]
    f = lambda x: f"({float(x)}e0)"
    h = [f"(e1*{f(v[2])} - e2*{f(v[1])})", f"(e2*{f(v[0])} - e0*{f(v[2])})", f"(e0*{f(v[1])} - e1*{f(v[0])})"]
    q = [s[1] * u[2] - s[2] * u[1], s[2] * u[0] - s[0] * u[2], s[0] * u[1] - s[1] * u[0]]
    det = " + ".join(f"{f(x)}*{y}" for x, y in zip(u, h))
    first, second, t = " + ".join(f"{f(x)}*{y}" for x, y in zip(s, h)), " + ".join(f"e{k}*{f(x)}" for k, x in enumerate(q)), f(sum(x * y for x, y in zip(v, q)))
    return f"CASE WHEN abs({det}) > 1e-9 AND ({first}) / ({det}) >= 0 AND ({second}) / ({det}) >= 0 AND ({first}) / ({det}) + ({second}) / ({det}) <= 1 AND {t} / ({det}) > 0 THEN {t} / ({det}) END"


@query(f"""WITH {V3}, t AS (SELECT vec_id, unnest([{", ".join(_triangle_sql(*f) for f in _FACES)}]) AS t, unnest(range(1, {len(_FACES) + 1})) AS face FROM v3)
SELECT vec_id, arg_min(face, t * 1000 + face * 1e-6) AS face, round(min(t), 5) AS t, count(*) AS hits FROM t WHERE t IS NOT NULL GROUP BY vec_id""")
def ray_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest face of a mesh that each direction hits, and how many it passes through."""
    o, v = R.vector(0, 0, 0), (F.col("e0"), F.col("e1"), F.col("e2"))
    hits = F.filter(F.array(*[F.struct(R.triangle_distance(o, v, *f).alias("t"), F.lit(k).cast("long").alias("face")) for k, f in enumerate(_FACES, 1)]), lambda h: h["t"].isNotNull())
    m = vectors(spark, sf_dir).select("vec_id", hits.alias("h")).where(F.size("h") > 0)
    return m.select("vec_id", F.array_min("h")["face"].alias("face"), F.round(F.array_min("h")["t"], 5).alias("t"), F.size("h").cast("long").alias("hits"))


def _erf_sql(x: str) -> str:
    t = f"(1e0 / (1e0 + 0.3275911e0 * abs({x})))"
    return f"(sign({x}) * (1e0 - {t} * (0.254829592e0 + {t} * (-0.284496736e0 + {t} * (1.421413741e0 + {t} * (-1.453152027e0 + {t} * 1.061405429e0)))) * exp(-({x}) * ({x}))))"


_PUFFS = [(30.0, 4.0, 0.6, 0.2), (70.0, 9.0, 0.9, -0.4), (110.0, 6.0, 0.4, 0.5)]


def _depth_sql(upto: str) -> str:
    return " + ".join(f"{a}e0 * exp(-power((l - ({m}e0)) / 0.5e0, 2)) * 0.5e0 * ({_erf_sql(f'(({upto}) - {c}e0) / {s}e0')} - {_erf_sql(f'(0e0 - {c}e0) / {s}e0')})" for c, s, a, m in _PUFFS)


@query(f"""WITH {PT}, p AS (SELECT frame, slot, d, l, {_depth_sql("d")} AS tau FROM pt), k AS (SELECT p.*, unnest(range(1, 25)) AS step FROM p),
s AS (SELECT frame, slot, d, tau, step, ({_depth_sql("d * step / 24e0")}) - ({_depth_sql("d * (step - 1) / 24e0")}) AS gain, d * step / 24e0 AS x, l, exp(-({_depth_sql("d * (step - 1) / 24e0")})) AS before FROM k),
b AS (SELECT frame, slot, any_value(tau) AS tau, any_value(d) AS d, max(round(gain * before, 9)) AS best, min(step) FILTER (top) AS step FROM (SELECT *, round(gain * before, 9) = max(round(gain * before, 9)) OVER (PARTITION BY frame, slot) AS top FROM s) GROUP BY ALL)
SELECT frame, count(*) AS beams, round(avg(exp(-tau)), 5) AS survival, count(*) FILTER (best > 0.1e0 AND best > exp(-tau) * 0.5e0) AS dust_returns, round(sum(CASE WHEN best > 0.1e0 AND best > exp(-tau) * 0.5e0 THEN d * step / 24e0 ELSE d END), 2) AS ranges FROM b GROUP BY frame""")
def dust_puffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Optical depth of puffs along each beam, the strongest of 24 samples as a soft return, and what passes through; a beam's samples never leave its row."""
    b = points(spark, sf_dir).select("frame", "d", soft_return(_PUFFS, 24)("d", "l").alias("s")).select("frame", "d", "s.*")
    dusty = (F.col("best") > 0.1) & (F.col("best") > F.exp(-F.col("tau")) * 0.5)
    return b.groupBy("frame").agg(
        F.count(F.lit(1)).alias("beams"), F.round(F.avg(F.exp(-F.col("tau"))), 5).alias("survival"), F.count_if(dusty).alias("dust_returns"), F.round(F.sum(F.when(dusty, F.col("d") * F.col("step") / 24.0).otherwise(F.col("d"))), 2).alias("ranges")
    )


@query(f"""WITH {FR}, p AS (SELECT bag, i, sum(dist / 100) OVER w AS x, sum(k / 10e0 - 2.5e0) OVER w AS y FROM fr WINDOW w AS (PARTITION BY bag ORDER BY i)), s AS (SELECT *, x - lag(x) OVER v AS dx, y - lag(y) OVER v AS dy FROM p WINDOW v AS (PARTITION BY bag ORDER BY i)),
h AS (SELECT *, sqrt(dx * dx + dy * dy) AS step, degrees(atan2(dy, dx)) AS heading FROM s WHERE dx IS NOT NULL)
SELECT bag, round(sum(step), 3) AS arc, round(avg(heading), 4) AS heading, round(sum(cos(radians(20)) * dx - sin(radians(20)) * dy), 3) AS turned_x, round(sum(sin(radians(20)) * dx + cos(radians(20)) * dy), 3) AS turned_y FROM h GROUP BY bag""")
def arc_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arc length and heading along a path, and its steps turned by an angle."""
    w = isl.by(["bag"], ["i"])
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    p = frames(spark, sf_dir).select("bag", "i", F.sum(F.col("dist") / 100).over(up).alias("x"), F.sum(F.col("k") / 10.0 - 2.5).over(up).alias("y"))
    s = p.select("bag", (F.col("x") - F.lag("x").over(w)).alias("dx"), (F.col("y") - F.lag("y").over(w)).alias("dy")).where("dx is not null")
    tx, ty, _ = R.turned((F.col("dx"), F.col("dy"), F.lit(0.0)), 20.0)
    step = R.norm((F.col("dx"), F.col("dy"), F.lit(0.0)))
    return s.groupBy("bag").agg(F.round(F.sum(step), 3).alias("arc"), F.round(F.avg(F.degrees(F.atan2("dy", "dx"))), 4).alias("heading"), F.round(F.sum(tx), 3).alias("turned_x"), F.round(F.sum(ty), 3).alias("turned_y"))


@query(f"""WITH {V3}, a AS (SELECT *, lead(e0) OVER w AS f0, lead(e1) OVER w AS f1, lead(e2) OVER w AS f2 FROM v3 WINDOW w AS (PARTITION BY label ORDER BY vec_id)), c AS (SELECT *, e1*f2-e2*f1 AS c0, e2*f0-e0*f2 AS c1, e0*f1-e1*f0 AS c2 FROM a WHERE f0 IS NOT NULL)
SELECT label, count(*) AS n, round(sum(sqrt(c0*c0+c1*c1+c2*c2)), 3) AS areas, round(max(abs(c0*e0+c1*e1+c2*e2)), 6) AS off, round(avg((e0*f0+e1*f1+e2*f2)/sqrt(({_D2})*(f0*f0+f1*f1+f2*f2))), 5) AS cosine FROM c GROUP BY label""")
def cross_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross products of neighbouring directions: their areas, that they stand upright on both, and cosines."""
    w = Window.partitionBy("label").orderBy("vec_id")
    a = vectors(spark, sf_dir).select("label", "e0", "e1", "e2", *[F.lead(f"e{k}").over(w).alias(f"f{k}") for k in range(3)]).where("f0 is not null")
    e, f = tuple(F.col(f"e{k}") for k in range(3)), tuple(F.col(f"f{k}") for k in range(3))
    c = R.cross(e, f)
    return a.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(R.norm(c)), 3).alias("areas"), F.round(F.max(F.abs(R.dot(c, e))), 6).alias("off"), F.round(F.avg(R.dot(e, f) / F.sqrt(R.dot(e, e) * R.dot(f, f))), 5).alias("cosine")
    )


#: Faces of a box as corner numbers, two triangles a side; corner k has the upper end of axis j where bit j of k is set.
_BOX_FACES = [(0, 1, 3), (0, 3, 2), (4, 7, 5), (4, 6, 7), (0, 5, 1), (0, 4, 5), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 7, 3), (1, 5, 7)]
_BOX_SQL = ", ".join(f"({k}, {a}, {b}, {c})" for k, (a, b, c) in enumerate(_BOX_FACES))


@query(f"""WITH b AS (SELECT p_partkey AS object, 0.2e0 + p_size / 20e0 AS sx, 0.1e0 + (p_partkey % 7) / 5e0 AS sy, 0.3e0 + (p_partkey % 5) / 4e0 AS sz FROM part), f(face, a, b, c) AS (VALUES {_BOX_SQL}),
v AS (SELECT object, face, (a & 1) * sx AS ax, ((a >> 1) & 1) * sy AS ay, ((a >> 2) & 1) * sz AS az, (f.b & 1) * sx AS bx, ((f.b >> 1) & 1) * sy AS by_, ((f.b >> 2) & 1) * sz AS bz, (c & 1) * sx AS cx, ((c >> 1) & 1) * sy AS cy, ((c >> 2) & 1) * sz AS cz FROM b, f),
n AS (SELECT object, 0.5e0 * sqrt(power((by_-ay)*(cz-az)-(bz-az)*(cy-ay),2) + power((bz-az)*(cx-ax)-(bx-ax)*(cz-az),2) + power((bx-ax)*(cy-ay)-(by_-ay)*(cx-ax),2)) AS area, (ax*(by_*cz-bz*cy) - ay*(bx*cz-bz*cx) + az*(bx*cy-by_*cx)) / 6 AS vol FROM v)
SELECT object, count(*) AS faces, round(sum(area), 5) AS area, round(abs(sum(vol)), 5) AS volume FROM n GROUP BY object""")
def box_meshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles of boxes, and each mesh's surface and volume.  Twelve faces are broadcast."""
    from ..session import read_table

    b = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("object"), (0.2 + F.col("p_size") / 20.0).alias("s0"), (0.1 + (F.col("p_partkey") % 7) / 5.0).alias("s1"), (0.3 + (F.col("p_partkey") % 5) / 4.0).alias("s2"))
    f = spark.createDataFrame([(k, *c) for k, c in enumerate(_BOX_FACES)], "face int, a int, b int, c int")
    corner = lambda c: tuple(F.shiftright(c, k).bitwiseAND(1) * F.col(f"s{k}") for k in range(3))
    a, u, w = corner(F.col("a")), corner(F.col("b")), corner(F.col("c"))
    area = 0.5 * R.norm(R.cross(R.minus(u, a), R.minus(w, a)))
    m = b.join(F.broadcast(f), how="cross").select("object", area.alias("area"), (R.dot(a, R.cross(u, w)) / 6).alias("vol"))
    return m.groupBy("object").agg(F.count(F.lit(1)).alias("faces"), F.round(F.sum("area"), 5).alias("area"), F.round(F.abs(F.sum("vol")), 5).alias("volume"))


@query(f"""WITH {FR}, c AS (SELECT bag, i, sum(0.02e0 * (k - 25)) OVER w AS heading FROM fr WINDOW w AS (PARTITION BY bag ORDER BY i)), x AS (SELECT bag, i, heading, sum(2e0 * cos(radians(heading))) OVER w AS x, sum(2e0 * sin(radians(heading))) OVER w AS y FROM c WINDOW w AS (PARTITION BY bag ORDER BY i)),
v AS (SELECT bag, i, j, x - sin(radians(heading)) * 2.5e0 * cos(radians(j * 30)) AS vx, y + cos(radians(heading)) * 2.5e0 * cos(radians(j * 30)) AS vy, 1.5e0 + 2.5e0 * sin(radians(j * 30)) AS vz FROM x, (SELECT unnest(range(0, 12)) AS j)),
q AS (SELECT *, lead(vx) OVER w AS nx, lead(vy) OVER w AS ny, lead(vz) OVER w AS nz FROM v WINDOW w AS (PARTITION BY bag, j ORDER BY i))
SELECT bag, count(*) AS vertices, 2 * count(nx) AS faces, round(max(vx) - min(vx), 4) AS length, round(max(vy) - min(vy), 4) AS width, round(sum(sqrt(power(nx-vx,2)+power(ny-vy,2)+power(nz-vz,2))), 3) AS edges FROM q GROUP BY bag""")
def tunnel_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tunnel extruded along a centre line of given bends: ring vertices and the faces between rings."""
    w = isl.by(["bag"], ["i"]).rowsBetween(Window.unboundedPreceding, 0)
    c = frames(spark, sf_dir).select("bag", "i", F.sum(0.02 * (F.col("k") - 25)).over(w).alias("heading"))
    turn = F.radians("heading")
    x = c.withColumn("x", F.sum(2.0 * F.cos(turn)).over(w)).withColumn("y", F.sum(2.0 * F.sin(turn)).over(w))
    v = x.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(11))))
    round_ = F.radians(F.col("j") * 30)
    v = v.select("bag", "i", "j", (F.col("x") - F.sin(turn) * 2.5 * F.cos(round_)).alias("vx"), (F.col("y") + F.cos(turn) * 2.5 * F.cos(round_)).alias("vy"), (1.5 + 2.5 * F.sin(round_)).alias("vz"))
    n = Window.partitionBy("bag", "j").orderBy("i")
    here, there = tuple(F.col(f"v{a}") for a in "xyz"), tuple(F.col(f"n{a}") for a in "xyz")
    q = v.select("*", *[F.lead(f"v{a}").over(n).alias(f"n{a}") for a in "xyz"])
    return q.groupBy("bag").agg(
        F.count(F.lit(1)).alias("vertices"), (2 * F.count("nx")).alias("faces"), F.round(F.max("vx") - F.min("vx"), 4).alias("length"), F.round(F.max("vy") - F.min("vy"), 4).alias("width"), F.round(F.sum(R.norm(R.minus(there, here))), 3).alias("edges")
    )


@query("""WITH b AS (SELECT ring, col, radians(-12e0 + ring * 0.75e0) AS el, radians(-30e0 + col * 0.5e0) AS az FROM (SELECT unnest(range(0, 32)) AS ring), (SELECT unnest(range(0, 121)) AS col)), v AS (SELECT *, cos(el) * cos(az) AS x, cos(el) * sin(az) AS y, sin(el) AS z FROM b)
SELECT ring, count(*) AS beams, count(*) FILTER (x * 0.98e0 + y * 0.19e0 + z * -0.05e0 >= cos(radians(8))) AS in_cone, round(sum(y), 6) + 0e0 AS side, round(max(z), 6) AS up FROM v GROUP BY ring""")
def beam_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions of all rings and columns, and those within a cone around an object.  The grid is the feature: it reads no table."""
    n = spark.range(32 * 121).select(F.floor(F.col("id") / 121).cast("long").alias("ring"), (F.col("id") % 121).alias("col"))
    el, az = F.radians(-12.0 + F.col("ring") * 0.75), F.radians(-30.0 + F.col("col") * 0.5)
    x, y, z = F.cos(el) * F.cos(az), F.cos(el) * F.sin(az), F.sin(el)
    return n.groupBy("ring").agg(F.count(F.lit(1)).alias("beams"), F.count_if(x * 0.98 + y * 0.19 + z * -0.05 >= F.cos(F.radians(F.lit(8.0)))).alias("in_cone"), (F.round(F.sum(y), 6) + 0.0).alias("side"), F.round(F.max(z), 6).alias("up"))


@query(f"""WITH {PT}, e AS (SELECT frame, slot // 2 AS beam, slot, d, r * (1 - abs(l) / 2) AS strength FROM pt) SELECT frame, count(*) AS beams, round(sum(d), 5) AS ranges, count(*) FILTER (second) AS seconds FROM (
  SELECT frame, beam, arg_max(d, strength * 1e6 - slot) AS d, arg_max(slot % 2, strength * 1e6 - slot) = 1 AS second FROM e GROUP BY ALL) GROUP BY frame""")
def strongest_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One return a beam, the strongest, the first of equals."""
    e = points(spark, sf_dir).select("frame", F.floor(F.col("slot") / 2).cast("long").alias("beam"), "slot", "d", (F.col("r") * (1 - F.abs("l") / 2)).alias("strength"))
    best = F.max_by(F.struct("d", "slot"), F.col("strength") * 1e6 - F.col("slot"))
    g = e.groupBy("frame", "beam").agg(best.alias("b"))
    return g.groupBy("frame").agg(F.count(F.lit(1)).alias("beams"), F.round(F.sum("b.d"), 5).alias("ranges"), F.count_if(F.col("b.slot") % 2 == 1).alias("seconds"))


_OBJECT = "o AS (SELECT frame, slot, 40e0 + (slot % 11) AS od FROM pt WHERE slot % 6 = 0 AND abs(l) < 0.7e0)"


def _object(p: DataFrame) -> DataFrame:
    return p.where("slot % 6 = 0 and abs(l) < 0.7D").select("frame", "slot", (F.lit(40.0) + F.col("slot") % 11).alias("od"))


@query(f"""WITH {PT}, {_OBJECT}, k AS (SELECT pt.frame, pt.slot, d, 0 AS added FROM pt LEFT JOIN o USING (frame, slot) WHERE od IS NULL OR od >= d), a AS (SELECT o.frame, o.slot, od AS d, 1 AS added FROM o JOIN pt USING (frame, slot) WHERE od < d),
u AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY added, CASE WHEN added = 0 THEN slot END, d DESC, slot) - 1 AS place FROM (SELECT * FROM k UNION ALL SELECT * FROM a))
SELECT frame, count(*) AS n, sum(added)::BIGINT AS appended, min(place) FILTER (added = 1) AS first_place, arg_min(d, place) FILTER (added = 1) AS farthest, round(sum(d), 5) AS total FROM u GROUP BY frame""")
def appended_insertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an object hides is deleted and its returns are appended, the farthest first."""
    p = points(spark, sf_dir)
    o = _object(p)
    j = p.select("frame", "slot", "d").join(o, ["frame", "slot"], "left")
    kept = j.where("od is null or od >= d").select("frame", "slot", "d", F.lit(0).alias("added"))
    new = j.where("od < d").select("frame", "slot", F.col("od").alias("d"), F.lit(1).alias("added"))
    w = Window.partitionBy("frame").orderBy("added", F.when(F.col("added") == 0, F.col("slot")), F.desc("d"), "slot")
    u = kept.unionByName(new).withColumn("place", (F.row_number().over(w) - 1).cast("long"))
    mine = F.col("added") == 1
    return u.groupBy("frame").agg(
        F.count(F.lit(1)).alias("n"), F.sum("added").alias("appended"), F.min(F.when(mine, F.col("place"))).alias("first_place"), F.min_by(F.when(mine, F.col("d")), F.when(mine, F.col("place"))).alias("farthest"), F.round(F.sum("d"), 5).alias("total")
    )


@query(f"""WITH {PT}, {_OBJECT}, j AS (SELECT pt.frame, pt.slot, d, r, CASE WHEN od < d THEN od + CASE WHEN slot % 12 = 0 THEN d - od - 0.0005e0 ELSE 0e0 END ELSE d END AS rendered, CASE WHEN od < d THEN 25e0 ELSE r END AS inten FROM pt LEFT JOIN o USING (frame, slot))
SELECT frame, count(*) FILTER (abs(rendered - d) < 1e-3) AS restored, round(sum(CASE WHEN abs(rendered - d) < 1e-3 THEN d ELSE rendered END), 5) AS ranges, round(sum(CASE WHEN abs(rendered - d) < 1e-3 THEN r ELSE inten END), 2) AS intensity FROM j GROUP BY frame""")
def physical_insertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rendered cloud keeps the base's own values wherever rendering changed the range by less than a millimetre."""
    p = points(spark, sf_dir)
    j = p.join(_object(p), ["frame", "slot"], "left")
    hit = F.col("od") < F.col("d")
    rendered = F.when(hit, F.col("od") + F.when(F.col("slot") % 12 == 0, F.col("d") - F.col("od") - 0.0005).otherwise(0.0)).otherwise(F.col("d"))
    j = j.withColumn("rendered", rendered).withColumn("inten", F.when(hit, 25.0).otherwise(F.col("r"))).withColumn("same", F.abs(F.col("rendered") - F.col("d")) < 1e-3)
    return j.groupBy("frame").agg(
        F.count_if("same").alias("restored"), F.round(F.sum(F.when(F.col("same"), F.col("d")).otherwise(F.col("rendered"))), 5).alias("ranges"), F.round(F.sum(F.when(F.col("same"), F.col("r")).otherwise(F.col("inten"))), 2).alias("intensity")
    )


@query(f"""WITH {PT}, {_OBJECT}, h AS (SELECT frame, slot // 6 % 3 AS obj, count(*) FILTER (od < d) AS hits, quantile_cont(od, 0.1) FILTER (od < d) AS near, min(od) AS planned, min(l) FILTER (od < d) AS lo, max(l) FILTER (od < d) AS hi, min(h) FILTER (od < d) AS bot, max(h) FILTER (od < d) AS top FROM pt JOIN o USING (frame, slot) GROUP BY ALL),
e AS (SELECT frame, avg(d) AS centre FROM pt GROUP BY frame)
SELECT h.frame, obj, hits, round(coalesce(CASE WHEN hits >= 10 THEN near END, planned, centre), 4) AS distance, round(coalesce(hi - lo, 0e0), 4) AS width, coalesce(lo <= 1.4e0 AND hi >= -1.4e0 AND bot <= 3.4e0 AND top >= 0.1e0, false) AS in_gauge FROM h JOIN e USING (frame)""")
def object_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of inserted objects: measured distance if hits suffice, else the planned one, else the scene's centre; extent and gauge."""
    p = points(spark, sf_dir)
    j = p.join(_object(p), ["frame", "slot"])
    hit = F.col("od") < F.col("d")
    seen = lambda c: F.when(hit, F.col(c))
    h = j.groupBy("frame", (F.floor(F.col("slot") / 6).cast("long") % 3).alias("obj")).agg(
        F.count_if(hit).alias("hits"), F.percentile(seen("od"), 0.1).alias("near"), F.min("od").alias("planned"), F.min(seen("l")).alias("lo"), F.max(seen("l")).alias("hi"), F.min(seen("h")).alias("bot"), F.max(seen("h")).alias("top")
    )
    e = p.groupBy("frame").agg(F.avg("d").alias("centre"))
    distance = F.coalesce(F.when(F.col("hits") >= 10, F.col("near")), F.col("planned"), F.col("centre"))
    gauge = F.coalesce(C.gauge_overlap(F.col("lo"), F.col("hi"), F.col("bot"), F.col("top")), F.lit(False))
    return h.join(e, "frame").select("frame", "obj", "hits", F.round(distance, 4).alias("distance"), F.round(F.coalesce(F.col("hi") - F.col("lo"), F.lit(0.0)), 4).alias("width"), gauge.alias("in_gauge"))


@query(f"""WITH {PT}, b AS (SELECT frame, floor(d / 20)::BIGINT AS bin, quantile_cont(h, 0.05) AS floor_h, count(*) AS n FROM pt WHERE abs(l) <= 0.7e0 GROUP BY ALL HAVING count(*) >= 3), s AS (SELECT frame, quantile_cont(d, 0.995) AS sight FROM pt GROUP BY frame),
o AS (SELECT frame, count(*) AS samples, median(floor_h - (0.02e0 + 0.001e0 * (bin * 20 + 10))) AS off FROM b GROUP BY frame)
SELECT frame, samples, round(sight, 4) AS sight, round(CASE WHEN samples >= 3 THEN off ELSE -0.05e0 END, 5) AS floor_offset, round(greatest(-0.3e0, least(0.1e0, off)), 5) AS clipped FROM s JOIN o USING (frame)""")
def floor_and_sight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sight limit, and the offset of the local floor from a model, with a default where samples are few."""
    p = points(spark, sf_dir)
    b = p.where("abs(l) <= 0.7D").groupBy("frame", C.floor_bin(F.col("d"), 20.0).alias("bin")).agg(F.percentile("h", 0.05).alias("floor_h"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    o = b.groupBy("frame").agg(F.count(F.lit(1)).alias("samples"), F.percentile(F.col("floor_h") - (0.02 + 0.001 * (F.col("bin") * 20 + 10)), 0.5).alias("off"))
    s = p.groupBy("frame").agg(F.percentile("d", 0.995).alias("sight"))
    return s.join(o, "frame").select(
        "frame", "samples", F.round("sight", 4).alias("sight"), F.round(F.when(F.col("samples") >= 3, F.col("off")).otherwise(-0.05), 5).alias("floor_offset"), F.round(F.greatest(F.lit(-0.3), F.least(F.lit(0.1), F.col("off"))), 5).alias("clipped")
    )


@query(f"""WITH {PT}, t AS (SELECT frame, slot, d, d BETWEEN 30 AND 60 AND abs(l) < 0.5e0 AS object FROM pt), f AS (SELECT t.frame, t.slot, t.d, object, (SELECT arg_min(o.d, abs(o.frame - t.frame) * 1000 + o.frame) FROM t o WHERE o.slot = t.slot AND o.frame % 2 = t.frame % 2 AND o.frame <> t.frame AND abs(o.frame - t.frame) <= 6 AND NOT o.object) AS base FROM t)
SELECT frame, count(*) FILTER (object) AS removed, count(*) FILTER (object AND base IS NULL) AS unfilled, round(sum(CASE WHEN object THEN coalesce(base, 0e0) ELSE d END), 5) AS total FROM f GROUP BY frame""")
def object_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object's returns replaced by the same slot of the nearest frame of equal parity without it, within six frames."""
    t = points(spark, sf_dir).select("frame", "slot", "d", (F.col("d").between(30, 60) & (F.abs("l") < 0.5)).alias("object"))
    shifts = F.explode(F.array(*[F.lit(x).cast("long") for x in (-6, -4, -2, 2, 4, 6)]))
    want = t.where("object").select("frame", "slot", shifts.alias("shift")).withColumn("source", F.col("frame") + F.col("shift"))
    have = t.where("not object").select(F.col("frame").alias("source"), "slot", F.col("d").alias("base"))
    best = want.join(have, ["source", "slot"]).groupBy("frame", "slot").agg(F.min_by("base", F.struct(F.abs("shift"), "source")).alias("base"))
    j = t.join(best, ["frame", "slot"], "left")
    o = F.col("object")
    return j.groupBy("frame").agg(F.count_if(o).alias("removed"), F.count_if(o & F.col("base").isNull()).alias("unfilled"), F.round(F.sum(F.when(o, F.coalesce("base", F.lit(0.0))).otherwise(F.col("d"))), 5).alias("total"))


@query(f"""WITH {PT}, g AS (SELECT frame % 2 AS real, floor(d / 25)::BIGINT AS bin, count(*)::DOUBLE / count(DISTINCT frame) AS per, avg(r) AS inten FROM pt GROUP BY ALL)
SELECT a.bin, round(b.per / a.per, 6) AS count_ratio, round(b.inten / a.inten, 6) AS intensity_ratio, b.per / a.per BETWEEN 0.8e0 AND 1.2e0 AND b.inten / a.inten BETWEEN 0.8e0 AND 1.2e0 AS passes FROM g a JOIN g b USING (bin) WHERE a.real = 1 AND b.real = 0""")
def fidelity_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and intensities of a synthetic set against a real one by distance, within a fifth."""
    g = points(spark, sf_dir).groupBy((F.col("frame") % 2).alias("real"), C.floor_bin(F.col("d"), 25.0).alias("bin")).agg((F.count(F.lit(1)) / F.count_distinct("frame")).alias("per"), F.avg("r").alias("inten"))
    pick = lambda c, v: F.max(F.when(F.col("real") == v, F.col(c)))
    x = g.groupBy("bin").agg((pick("per", 0) / pick("per", 1)).alias("c"), (pick("inten", 0) / pick("inten", 1)).alias("i")).where("c is not null and i is not null")
    return x.select("bin", F.round("c", 6).alias("count_ratio"), F.round("i", 6).alias("intensity_ratio"), (F.col("c").between(0.8, 1.2) & F.col("i").between(0.8, 1.2)).alias("passes"))


@query(f"""WITH {PT}, {_OBJECT}, h AS (SELECT frame, slot // 6 % 3 AS obj, count(*) FILTER (od < d) AS hits, arg_max(od, d) AS seen_at FROM pt JOIN o USING (frame, slot) GROUP BY ALL)
SELECT obj, min(frame) FILTER (hits > 0) AS first_frame, max(frame) FILTER (hits > 0) AS last_frame, max(hits) AS most, arg_max(frame, hits * 100000 - frame) AS frame_of_most, arg_max(seen_at, hits * 100000 - frame) AS at_most, round(avg((hits >= 3)::INT), 6) AS share3 FROM h GROUP BY obj""")
def object_tracks_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each object's first and last frame, its most hits and what was measured there."""
    p = points(spark, sf_dir)
    h = p.join(_object(p), ["frame", "slot"]).groupBy("frame", (F.floor(F.col("slot") / 6).cast("long") % 3).alias("obj")).agg(F.count_if(F.col("od") < F.col("d")).alias("hits"), F.max_by("od", "d").alias("at"))
    seen = F.when(F.col("hits") > 0, F.col("frame"))
    best = F.max_by(F.struct("frame", "at"), F.struct("hits", -F.col("frame")))
    g = h.groupBy("obj").agg(F.min(seen).alias("first_frame"), F.max(seen).alias("last_frame"), F.max("hits").alias("most"), best.alias("b"), F.round(F.avg((F.col("hits") >= 3).cast("int")), 6).alias("share3"))
    return g.select("obj", "first_frame", "last_frame", "most", F.col("b.frame").alias("frame_of_most"), F.col("b.at").alias("at_most"), "share3")


@query(f"""WITH RECURSIVE {FR}, t AS (SELECT bag, i // 12 AS scene, i % 12 AS n, i, (dist * 7 + k * 13) % 300 AS want FROM fr), a AS (SELECT bag, scene, -1::BIGINT AS n, -1::BIGINT AS i, []::DOUBLE[] AS placed, NULL::DOUBLE AS x, 0::BIGINT AS redraws FROM (SELECT DISTINCT bag, scene FROM t)
  UNION ALL SELECT bag, scene, n, i, CASE WHEN x IS NULL THEN placed ELSE list_append(placed, x) END, x, CASE WHEN x IS NULL THEN -1 ELSE list_position(tries, x) - 1 END FROM (
    SELECT *, list_filter(tries, lambda v: len(list_filter(placed, lambda p: abs(p - v) < 4.5e0)) = 0)[1] AS x FROM (SELECT t.bag, t.scene, t.n, t.i, placed, list_transform(range(0, 21), lambda q: (want + q * 185.4e0) % 300) AS tries FROM a JOIN t ON t.bag = a.bag AND t.scene = a.scene AND t.n = a.n + 1)))
SELECT bag, i, redraws, round(coalesce(x, -1e0), 4) AS placed FROM a WHERE i >= 0""")
def spaced_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects placed in turn with a least spacing: up to twenty redraws that follow from the first draw, else left out.

    A scene is a dozen objects of a recording, folded inside the JVM.
    """
    t = frames(spark, sf_dir).select("bag", F.floor(F.col("i") / 12).alias("scene"), "i", ((F.col("dist") * 7 + F.col("k") * 13) % 300).alias("want"))
    rows = t.groupBy("bag", "scene").agg(F.sort_array(F.collect_list(F.struct("i", "want"))).alias("t"))
    kind = "struct<placed:array<double>,out:array<struct<i:bigint,redraws:bigint,x:double>>>"
    start = F.from_json(F.lit('{"placed":[],"out":[]}'), kind)

    def step(s: Column, o: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda q: F.struct(((o["want"] + q * 185.4) % 300).alias("x"), q.cast("bigint").alias("q")))
        fits = F.filter(tries, lambda v: ~F.exists(s["placed"], lambda p: F.abs(p - v["x"]) < 4.5))
        got = F.try_element_at(fits, F.lit(1))
        placed = F.when(got.isNull(), s["placed"]).otherwise(F.array_append(s["placed"], got["x"]))
        return F.struct(placed.alias("placed"), F.array_append(s["out"], F.struct(o["i"].alias("i"), F.coalesce(got["q"], F.lit(-1).cast("bigint")).alias("redraws"), got["x"].alias("x"))).alias("out")).cast(kind)

    out = rows.select("bag", F.inline(F.aggregate("t", start, step)["out"]))
    return out.select("bag", "i", "redraws", F.round(F.coalesce("x", F.lit(-1.0)), 4).alias("placed"))


@query(f"""WITH {FR}, m AS (SELECT bag, i, 0.5e0 * (i % 4) + k * 0.01e0 AS step, k % 10 = 0 AS still FROM fr), s AS (SELECT *, sum(still::INT) OVER (PARTITION BY bag ORDER BY i) AS segment FROM m)
SELECT bag, segment::BIGINT AS segment, min(i) AS first_i, count(*) AS n, round(sum(step), 4) AS travelled, round(max(pos), 4) AS reached FROM (SELECT *, sum(step) OVER (PARTITION BY bag ORDER BY i) AS pos FROM s) GROUP BY ALL""")
def aligned_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions from the motion between frames, and what each segment between stops travelled."""
    w = isl.by(["bag"], ["i"]).rowsBetween(Window.unboundedPreceding, 0)
    m = frames(spark, sf_dir).select("bag", "i", (0.5 * (F.col("i") % 4) + F.col("k") * 0.01).alias("step"), (F.col("k") % 10 == 0).cast("long").alias("still"))
    s = m.withColumn("segment", F.sum("still").over(w)).withColumn("pos", F.sum("step").over(w))
    return s.groupBy("bag", "segment").agg(F.min("i").alias("first_i"), F.count(F.lit(1)).alias("n"), F.round(F.sum("step"), 4).alias("travelled"), F.round(F.max("pos"), 4).alias("reached"))


@query(f"""WITH {PT}, a AS (SELECT frame, slot, d, CASE WHEN slot % 9 = 0 THEN 0 ELSE slot + 128 * (slot // 200) END AS edited FROM pt), s AS (SELECT *, CASE WHEN edited = 0 THEN NULL ELSE edited - slot END AS off FROM a),
f AS (SELECT *, coalesce(last_value(off IGNORE NULLS) OVER (PARTITION BY frame ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS used FROM s), j AS (SELECT *, used - lag(used) OVER (PARTITION BY frame ORDER BY slot) AS jump FROM f)
SELECT frame, count(*) FILTER (off IS NULL) AS inherited, count(*) FILTER (jump > 0) AS splits, max(used)::BIGINT AS last_offset FROM j GROUP BY frame""")
def split_align_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of an edited cloud against the original's: zeros inherit the last offset, and each growth is a split."""
    w = Window.partitionBy("frame").orderBy("slot")
    split = F.floor(F.col("slot") / 200).cast("long") * 128
    s = points(spark, sf_dir).select("frame", "slot", F.when((F.col("slot") % 9 != 0) & (F.col("slot") + split != 0), split).alias("off"))
    f = s.withColumn("used", F.coalesce(F.last("off", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0).cast("long")))
    j = f.withColumn("jump", F.col("used") - F.lag("used").over(w))
    return j.groupBy("frame").agg(F.count_if(F.col("off").isNull()).alias("inherited"), F.count_if(F.col("jump") > 0).alias("splits"), F.max("used").alias("last_offset"))


@query("""SELECT s_suppkey AS scene, CASE WHEN s_suppkey % 4 = 0 THEN round(s_acctbal / 100, 4) ELSE s_acctbal END AS grade, s_suppkey % 4 = 0 AS patched FROM supplier""")
def patched_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of written metadata patched: the new table is written whole beside the old, which goes only then."""
    from ..session import discard, read_table

    old = written(read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("scene"), F.col("s_acctbal").alias("grade")), "metadata")
    patch = old.where("scene % 4 = 0").select("scene", F.round(F.col("grade") / 100, 4).alias("new"))
    new = written(old.join(patch, "scene", "left").select("scene", F.coalesce("new", "grade").alias("grade"), F.col("new").isNotNull().alias("patched")), "metadata")
    discard(old)
    return new
