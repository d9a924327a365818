"""Queries of scenes in motion: shifts of frames from their points, rays against tables of faces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.mesh import cast_rays
from ..operators.motion import grid, segment_motion, smoothness
from ..operators.tracks.batch import ordered_fold
from ..operators.tracks.linking import COMPONENTS, link_step, new_links
from ..operators.tracks.linking import OUT as LINKS
from ..session import read_table
from .views import PT, points

QUERIES: dict = {}
ORACLE_SQL: dict = {}
LOW, HIGH, STEP, SIGMA, TRUNC = -0.2, 3.0, 0.1, 0.15, 0.25
#: Frames of a ride.
RIDE = 25
_M, _M2 = len(grid(LOW, HIGH, STEP)), len(grid(LOW, 2 * HIGH, STEP))


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def ride_points(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Points with their frames numbered from 0 in rides of ``RIDE``."""
    p = points(spark, sf_dir)
    return p.select(F.floor(F.col("frame") / RIDE).alias("ride"), (F.col("frame") % RIDE).alias("k"), "slot", "d", "l", "h", *more)


_RIDE = f"""p AS (SELECT frame // {RIDE} AS ride, frame % {RIDE} AS k, slot, d, l, h FROM pt),
seen AS (SELECT * FROM p WHERE d > 2 AND d < 50 AND abs(l) < 4.5 AND h > -1), st AS (SELECT *, row_number() OVER () AS id FROM p WHERE d > 4 AND d < 45 AND abs(l) < 4 AND h > -0.9)"""


def _cost_sql(name: str, lag: int, m: int, where: str = "true") -> str:
    """A curve a pair of frames: ``ride, k, j, c``, none where a frame is empty."""
    return f"""{name}n AS (SELECT ride, k, count(*) AS n FROM st WHERE {where} AND (ride, k - {lag}) IN (SELECT (ride, k) FROM seen) GROUP BY ALL),
{name}p AS (SELECT b.ride, b.k, b.id, a.d - b.d AS off, power(a.l - b.l, 2) + power(a.h - b.h, 2) AS flat FROM st b JOIN seen a ON a.ride = b.ride AND a.k = b.k - {lag} AND a.d - b.d BETWEEN {LOW - TRUNC} AND {HIGH * lag + TRUNC} WHERE power(a.l - b.l, 2) + power(a.h - b.h, 2) < {TRUNC}e0 * {TRUNC}e0 AND b.{where.replace('true', 'k >= 0')}),
{name}d AS (SELECT ride, k, id, j, min(sqrt(power(off - ({LOW}e0 + j * {STEP}e0), 2) + flat)) AS dist FROM {name}p, range({m}) t(j) WHERE abs(off - ({LOW}e0 + j * {STEP}e0)) <= {TRUNC}e0 GROUP BY ALL),
{name}g AS (SELECT ride, k, j, sum({TRUNC}e0 - dist) AS gain FROM {name}d WHERE dist < {TRUNC}e0 GROUP BY ALL),
{name}c AS (SELECT ride, k, j, round({TRUNC}e0 - coalesce(gain, 0e0) / n, 9) AS c FROM {name}n CROSS JOIN range({m}) t(j) LEFT JOIN {name}g USING (ride, k, j))"""


_CHANGE = str(smoothness(grid(LOW, HIGH, STEP), SIGMA).tolist())
_MOTION_SQL = f"""WITH RECURSIVE {PT}, {_RIDE}, {_cost_sql("a", 1, _M)}, {_cost_sql("b", 2, _M2, "k % 2 = 0")},
s AS (SELECT *, abs(c - lag(c) OVER (PARTITION BY ride, k ORDER BY j)) AS dc FROM ac), z AS (SELECT ride, k, greatest(median(dc) * 3, 1e-4) AS noise, min(c) AS lo FROM s GROUP BY ALL),
f AS (SELECT ride, max(k) AS last FROM p GROUP BY ride), fk AS (SELECT ride, unnest(range(1, last + 1)) AS k FROM f),
e AS (SELECT fk.ride, fk.k, list(coalesce(floor((c - lo) / noise * 1024 + 0.5)::BIGINT, 0) ORDER BY t.j) AS e, list(c ORDER BY t.j) AS cs, bool_and(c IS NOT NULL) AS informative FROM fk CROSS JOIN range({_M}) t(j) LEFT JOIN ac ON ac.ride = fk.ride AND ac.k = fk.k AND ac.j = t.j LEFT JOIN z ON z.ride = fk.ride AND z.k = fk.k GROUP BY ALL),
w AS (SELECT ride, k, e AS acc, []::BIGINT[] AS back FROM e WHERE k = 1
  UNION ALL SELECT ride, k, list_transform(x, lambda v, j: v // 64 + e[j]), list_transform(x, lambda v: v % 64) FROM (
    SELECT e.ride, e.k, e.e, list_transform(range({_M}), lambda j: list_min(list_transform(range({_M}), lambda i: (w.acc[i + 1] + {_CHANGE}[i + 1][j + 1]) * 64 + i))) AS x FROM w JOIN e ON e.ride = w.ride AND e.k = w.k + 1)),
v AS (SELECT w.ride, w.k, list_position(acc, list_min(acc)) - 1 AS state FROM w JOIN f ON f.ride = w.ride AND f.last = w.k
  UNION ALL SELECT v.ride, v.k - 1, w.back[v.state + 1] FROM v JOIN w ON w.ride = v.ride AND w.k = v.k AND v.k > 1),
r AS (SELECT v.ride, v.k, informative, {LOW}e0 + state * {STEP}e0 AS place, state, cs[state] AS c0, cs[state + 1] AS c1, cs[state + 2] AS c2 FROM v JOIN e USING (ride, k)),
h AS (SELECT ride, k, informative, CASE WHEN state > 0 AND state < {_M - 1} AND c1 <= c0 AND c1 <= c2 AND c0 - 2 * c1 + c2 > 1e-12 THEN place + greatest(-0.5e0 * {STEP}, least(0.5e0 * {STEP}, 0.5e0 * {STEP} * (c0 - c2) / (c0 - 2 * c1 + c2))) ELSE place END AS shift FROM r
  UNION ALL SELECT ride, 0, true, 0e0 FROM f),
g AS (SELECT *, sum(shift) OVER o AS position, shift + lag(shift) OVER o AS two FROM h WINDOW o AS (PARTITION BY ride ORDER BY k)),
q AS (SELECT g.ride, g.k, two, least(greatest(floor((two - {LOW}e0) / {STEP}e0 + 0.5)::INT, 0), {_M2 - 1}) AS jc FROM g WHERE k > 1 AND k % 2 = 0),
u AS (SELECT q.ride, q.k, abs({LOW}e0 + arg_min(j, c * 1e6 + j * 1e-4) * {STEP}e0 - any_value(two)) AS closure FROM q JOIN bc ON bc.ride = q.ride AND bc.k = q.k AND j BETWEEN jc - {int(round(0.5 / STEP))} AND jc + {int(round(0.5 / STEP))} GROUP BY ALL)
SELECT ride, k, round(shift, 6) AS shift, round(position, 6) AS position, informative, round(closure, 6) AS closure FROM g LEFT JOIN u USING (ride, k)"""


@query(_MOTION_SQL)
def ego_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each frame of a ride is along the track: cost curves of its points against the frame before, the least-cost path in blocks, its vertex, and the check over two frames."""
    m = segment_motion(ride_points(spark, sf_dir), "ride", "k", LOW, HIGH, STEP, SIGMA, TRUNC, block=8)
    return m.select("ride", "k", F.round("shift", 6).alias("shift"), F.round("position", 6).alias("position"), "informative", F.round("closure", 6).alias("closure"))


#: A scene's faces are the parts of its number modulo ``SCENES``, its beams the line items of such a supplier.
SCENES = 8
_FACE = f"""f AS (SELECT p_partkey % {SCENES} AS scene, p_partkey AS part, p_retailprice / 20e0 AS x, (p_partkey * 37 % 100 - 50) * 0.4e0 AS y, (p_partkey * 53 % 40 - 20) * 0.25e0 AS z, CASE WHEN p_partkey % 50 = 7 THEN 15e0 ELSE p_size * 0.04e0 END AS s FROM part),
g AS (SELECT scene, part, x AS x0, y - s AS y0, z - s AS z0, x + s / 2 AS x1, y + s AS y1, z - s AS z1, x AS x2, y AS y2, z + s AS z2 FROM f)"""
_BEAM = f"b AS (SELECT l_suppkey % {SCENES} AS scene, l_orderkey AS beam, l_linenumber AS line, 1e0 AS dx, (l_partkey % 401 - 200) / 400e0 AS dy, (l_orderkey % 101 - 50) / 400e0 AS dz FROM lineitem)"


def scene_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as triangles; every fiftieth is as large as a wall."""
    k = F.col("p_partkey")
    f = read_table(spark, sf_dir, "part").select(
        (k % SCENES).alias("scene"), k.alias("part"), (F.col("p_retailprice") / 20.0).alias("x"), ((k * 37 % 100 - 50) * 0.4).alias("y"), ((k * 53 % 40 - 20) * 0.25).alias("z"),
        F.when(k % 50 == 7, 15.0).otherwise(F.col("p_size") * 0.04).alias("s"),
    )
    x, y, z, s = (F.col(c) for c in "xyzs")
    corners = {"x0": x, "y0": y - s, "z0": z - s, "x1": x + s / 2, "y1": y + s, "z1": z - s, "x2": x, "y2": y, "z2": z + s}
    return f.select("scene", "part", *[c.alias(name) for name, c in corners.items()])


def scene_beams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as directions ahead."""
    across, up = (F.col("l_partkey") % 401 - 200) / 400.0, (F.col("l_orderkey") % 101 - 50) / 400.0
    return read_table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % SCENES).alias("scene"), F.col("l_orderkey").alias("beam"), F.col("l_linenumber").alias("line"), F.lit(1.0).alias("dx"), across.alias("dy"), up.alias("dz")
    )


@query(f"""WITH {_FACE}, {_BEAM},
v AS (SELECT b.*, part, -x0 AS sx, -y0 AS sy, -z0 AS sz, x1 - x0 AS ux, y1 - y0 AS uy, z1 - z0 AS uz, x2 - x0 AS wx, y2 - y0 AS wy, z2 - z0 AS wz FROM b JOIN g USING (scene)),
p AS (SELECT *, dy * wz - dz * wy AS px, dz * wx - dx * wz AS py, dx * wy - dy * wx AS pz, sy * uz - sz * uy AS qx, sz * ux - sx * uz AS qy, sx * uy - sy * ux AS qz FROM v),
d AS (SELECT *, ux * px + uy * py + uz * pz AS det FROM p),
h AS (SELECT scene, beam, line, part, (wx * qx + wy * qy + wz * qz) / det AS t FROM d WHERE abs(det) > 1e-12 AND (sx * px + sy * py + sz * pz) / det >= 0 AND (dx * qx + dy * qy + dz * qz) / det >= 0 AND (sx * px + sy * py + sz * pz) / det + (dx * qx + dy * qy + dz * qz) / det <= 1)
SELECT scene, beam, line, arg_min(part, {{'t': t, 'part': part}}) AS part, round(min(t), 6) AS t FROM h WHERE t > 1e-9 GROUP BY ALL""")
def mesh_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first face of a scene's table of triangles that each beam hits, by a grid of directions."""
    h = cast_rays(scene_beams(spark, sf_dir), scene_faces(spark, sf_dir), ["scene"], ["beam", "line"], "part")
    return h.select("scene", "beam", "line", "part", F.round("t", 6).alias("t"))


def static_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong points of a ride's frames linked to static objects under the ride's own motion: all pairs of a frame, the cheapest first; one ordered pass a ride."""
    p = ride_points(spark, sf_dir, "r", "flag")
    moved = segment_motion(p, "ride", "k", LOW, HIGH, STEP, SIGMA, TRUNC, block=8, check=False).select("ride", "k", "position")
    one = F.struct(F.col("slot").alias("c"), "d", "l", "h", F.col("d").alias("r"), F.col("flag").alias("kind"))
    seen = p.where("r >= 47").groupBy("ride", "k").agg(F.collect_list(one).cast(COMPONENTS).alias("components"))  # a frame's components
    # an array a field: a batch of frames as Python's objects, one a component, took many times its bytes
    names = ["c", "d", "l", "h", "r", "kind"]
    rows = seen.select("ride", "k", *[F.col(f"components.{n}").alias(n) for n in names]).join(moved, ["ride", "k"])

    def step(state: dict, r) -> list[dict]:
        return link_step(state, int(r.k), r.position, [dict(zip(names, one)) for one in zip(*(getattr(r, n) for n in names))])

    linked = ordered_fold(rows, "ride", "k", step, new_links, LINKS)
    return linked.groupBy("ride", "track").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first_k"), F.max("k").alias("last_k"), F.max("gap").alias("longest_gap"), F.min_by("c", "k").alias("first_c"))


#: Matching by costs that are sorted over a whole frame is no SQL: tested against a plain form.
QUERIES["static_objects"] = static_objects
