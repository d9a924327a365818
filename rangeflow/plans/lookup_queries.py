"""Queries of lookups and neighbourhoods: composite keys, fallbacks, ring neighbours, footprints, profiles."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import cells as cl
from ..session import read_table
from .views import FR, PT, frames, points

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""WITH k AS (SELECT l_orderkey, l_linenumber, (l_suppkey * 2048 + l_partkey) * 64 + l_linenumber AS key FROM lineitem),
d AS (SELECT (l_suppkey * 2048 + l_partkey) * 64 + 3 AS key, min(l_orderkey) AS id FROM lineitem WHERE l_linenumber <> 3 GROUP BY 1)
SELECT coalesce(id, -1) >= 0 AS found, count(*) AS n, sum(coalesce(id, -1))::BIGINT AS total FROM k LEFT JOIN d USING (key) GROUP BY 1""")
def composite_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary lookup by a packed key, -1 where it is missing."""
    pack = lambda a, b, c: (a * 2048 + b) * 64 + c
    li = read_table(spark, sf_dir, "lineitem").select(pack(F.col("l_suppkey"), F.col("l_partkey"), F.col("l_linenumber").cast("long")).alias("key"))
    d = read_table(spark, sf_dir, "lineitem").where("l_linenumber <> 3").groupBy(pack(F.col("l_suppkey"), F.col("l_partkey"), F.lit(3).cast("long")).alias("key")).agg(F.min("l_orderkey").alias("id"))
    j = li.join(d, "key", "left").select(F.coalesce("id", F.lit(-1).cast("long")).alias("id"))
    return j.groupBy((F.col("id") >= 0).alias("found")).agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("total"))


@query(f"""WITH {FR}, byk AS (SELECT bag, k, min(event_id) AS a FROM fr WHERE event_type = 'view' GROUP BY ALL), byp AS (SELECT bag, i, event_id AS b FROM fr WHERE event_type = 'click')
SELECT fr.bag, fr.i, coalesce(a, b, -1) AS label, CASE WHEN a IS NOT NULL THEN 'stamp' WHEN b IS NOT NULL THEN 'position' ELSE 'none' END AS by FROM fr LEFT JOIN byk ON fr.bag = byk.bag AND fr.k = byk.k LEFT JOIN byp ON fr.bag = byp.bag AND fr.i = byp.i""")
def label_by_stamp_else_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label by stamp where there is one, else by position."""
    fr = frames(spark, sf_dir)
    a = fr.where("event_type = 'view'").groupBy("bag", "k").agg(F.min("event_id").alias("a"))
    b = fr.where("event_type = 'click'").select("bag", "i", F.col("event_id").alias("b"))
    j = fr.select("bag", "i", "k").join(a, ["bag", "k"], "left").join(b, ["bag", "i"], "left")
    by = F.when(F.col("a").isNotNull(), "stamp").when(F.col("b").isNotNull(), "position").otherwise("none")
    return j.select("bag", "i", F.coalesce("a", "b", F.lit(-1).cast("long")).alias("label"), by.alias("by"))


@query(f"""WITH {PT}, s AS (SELECT DISTINCT frame FROM pt), a AS (SELECT frame, unnest(range(0, 900)) AS ring FROM s), seen AS (SELECT DISTINCT frame, slot % 900 AS ring FROM pt WHERE slot % 7 <> 0)
SELECT frame, count(*) AS missing, min(ring) AS first_ring FROM (SELECT * FROM a EXCEPT SELECT * FROM seen) GROUP BY frame""")
def no_return_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of the dictionary without a return."""
    p = points(spark, sf_dir)
    a = p.select("frame").distinct().withColumn("ring", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(899).cast("long"))))
    seen = p.where("slot % 7 <> 0").select("frame", (F.col("slot") % 900).alias("ring")).distinct()
    return a.join(seen, ["frame", "ring"], "left_anti").groupBy("frame").agg(F.count(F.lit(1)).alias("missing"), F.min("ring").alias("first_ring"))


_GRID = """c AS (SELECT frame, floor(d / 10)::BIGINT AS row, floor(l / 0.25e0)::BIGINT AS col, min(r) AS r, avg(h) AS h FROM pt GROUP BY ALL)"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).groupBy("frame", C.floor_bin(F.col("d"), 10.0).alias("row"), C.floor_bin(F.col("l"), 0.25).alias("col")).agg(F.min("r").alias("r"), F.avg("h").alias("h"))


@query(f"""WITH {PT}, {_GRID}, g AS (SELECT * FROM c WHERE r > 30),
n AS (SELECT DISTINCT b.frame, b.row, b.col, b.r FROM g JOIN c b ON b.frame = g.frame AND abs(b.row - g.row) <= 1 AND abs(b.col - g.col) <= 1 WHERE b.r <= 30), m AS (SELECT frame, median(r) AS med FROM g GROUP BY frame)
SELECT frame, count(*) AS n_ring, count(*) FILTER (abs(r - med) <= 0.5e0 + 0.4e0 * med) AS n_attached, round(avg((abs(r - med) <= 0.5e0 + 0.4e0 * med)::INT), 6) AS attached_frac FROM n JOIN m USING (frame) GROUP BY frame""")
def ring_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ring of cells around a group, and how much of it is attached to the group."""
    c = _grid(spark, sf_dir)
    g = c.where("r > 30")
    near = cl.neighbour_cells(g.select("frame", "row", "col"), "row", "col", own=False).distinct()
    n = c.where("r <= 30").join(near, ["frame", "row", "col"], "left_semi")
    m = g.groupBy("frame").agg(F.percentile("r", 0.5).alias("med"))
    near_by = F.abs(F.col("r") - F.col("med")) <= 0.5 + 0.4 * F.col("med")
    return n.join(m, "frame").groupBy("frame").agg(F.count(F.lit(1)).alias("n_ring"), F.count_if(near_by).alias("n_attached"), F.round(F.avg(near_by.cast("int")), 6).alias("attached_frac"))


@query(f"""WITH {PT}, {_GRID}, j AS (SELECT a.frame, a.row, a.col, a.r, median(b.r) AS med FROM c a JOIN c b ON b.frame = a.frame AND abs(b.row - a.row) <= 1 AND abs(b.col - a.col) <= 1 GROUP BY ALL)
SELECT frame, round(median(abs(r - med)) / (0.03e0 + 0.003e0 * avg(r)), 4) AS roughness, count(*) AS n FROM j GROUP BY frame HAVING count(*) >= 6""")
def roughness_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviation from the 3 x 3 median."""
    c = _grid(spark, sf_dir)
    near = cl.neighbour_cells(c.select("frame", "row", "col", F.col("r").alias("br")), "row", "col")
    j = c.join(near, ["frame", "row", "col"]).groupBy("frame", "row", "col", "r").agg(F.percentile("br", 0.5).alias("med"))
    rough = F.percentile(F.abs(F.col("r") - F.col("med")), 0.5) / (0.03 + 0.003 * F.avg("r"))
    return j.groupBy("frame").agg(F.round(rough, 4).alias("roughness"), F.count(F.lit(1)).alias("n")).where("n >= 6")


@query(f"""WITH {PT}, {_GRID}, s AS (SELECT frame, row, col FROM c WHERE r > 40),
x AS (SELECT s.frame, s.row, s.col, arg_min(c.r, s.row - c.row) AS below, min(s.row - c.row) AS steps FROM s LEFT JOIN c ON c.frame = s.frame AND c.col = s.col AND c.row < s.row AND c.row >= s.row - 4 AND c.r <= 40 GROUP BY ALL)
SELECT frame, row, col, coalesce(below, -1e0) AS below, coalesce(steps, -1)::BIGINT AS steps FROM x""")
def first_valid_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first valid cell below in the same column, within four rows."""
    c = _grid(spark, sf_dir)
    s = c.where("r > 40").select("frame", "row", "col")
    steps = s.withColumn("steps", F.explode(F.array(*[F.lit(k).cast("long") for k in range(1, 5)]))).withColumn("at", F.col("row") - F.col("steps"))
    hit = steps.join(c.where("r <= 40").select("frame", "col", F.col("row").alias("at"), "r"), ["frame", "col", "at"])
    best = hit.groupBy("frame", "row", "col").agg(F.min_by("r", "steps").alias("below"), F.min("steps").alias("steps"))
    return s.join(best, ["frame", "row", "col"], "left").fillna(-1.0, ["below"]).fillna(-1, ["steps"]).select("frame", "row", "col", "below", "steps")


@query(f"""WITH {PT}, b AS (SELECT frame, floor(d / 20)::BIGINT AS cell, min(d) - 0.8e0 AS d0, max(d) + 0.8e0 AS d1, min(l) - 0.4e0 AS l0, max(l) + 0.4e0 AS l1, max(h) AS top FROM pt WHERE h < 1.5e0 GROUP BY ALL)
SELECT b.frame, b.cell, count(p.slot) AS above, count(p.slot) >= 3 AS extends FROM b LEFT JOIN pt p ON p.frame = b.frame AND p.h >= 1.5e0 AND p.d BETWEEN d0 AND d1 AND p.l BETWEEN l0 AND l1 AND p.h > top + 0.1e0 AND p.h <= top + 1.3e0 GROUP BY ALL""")
def footprint_extends_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether outside returns stand above a cluster's footprint; both sides meet in cells of distance."""
    p = points(spark, sf_dir)
    b = p.where("h < 1.5D").groupBy("frame", C.floor_bin(F.col("d"), 20.0).alias("cell")).agg(
        (F.min("d") - 0.8).alias("d0"), (F.max("d") + 0.8).alias("d1"), (F.min("l") - 0.4).alias("l0"), (F.max("l") + 0.4).alias("l1"), F.max("h").alias("top")
    )
    lo, hi = C.floor_bin(F.col("d0"), 20.0), C.floor_bin(F.col("d1"), 20.0)
    spread = b.withColumn("at", F.explode(F.sequence(lo, hi)))
    out = p.where("h >= 1.5D").select("frame", C.floor_bin(F.col("d"), 20.0).alias("at"), "d", "l", "h", "slot")
    hit = spread.join(out, ["frame", "at"]).where("d between d0 and d1 and l between l0 and l1 and h > top + 0.1D and h <= top + 1.3D").groupBy("frame", "cell").agg(F.count("slot").alias("above"))
    return b.select("frame", "cell").join(hit, ["frame", "cell"], "left").fillna(0, ["above"]).withColumn("extends", F.col("above") >= 3)


@query(f"""WITH {PT}, o AS (SELECT frame, slot, d, l, h FROM pt WHERE h > 2.5e0), a AS (SELECT frame, slot, floor(d / 20)::BIGINT AS cluster, d, l, h FROM pt WHERE h <= 0.5e0), n AS (SELECT frame, cluster, count(*) AS n FROM a GROUP BY ALL),
m AS (SELECT a.frame, a.cluster, count(DISTINCT o.slot) AS near FROM a JOIN o ON o.frame = a.frame AND abs(o.d - a.d) <= 4e0 AND abs(o.l - a.l) <= 0.5e0 GROUP BY ALL)
SELECT n.frame, n.cluster, n.n, coalesce(near, 0) AS near, coalesce(near, 0) > n.n AS outnumbered FROM n LEFT JOIN m USING (frame, cluster)""")
def outside_neighbours_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct outside points near any member of a cluster, against its size, by grid cells."""
    p = points(spark, sf_dir)
    a = p.where("h <= 0.5D").select("frame", C.floor_bin(F.col("d"), 20.0).alias("cluster"), F.col("d").alias("ad"), F.col("l").alias("al"))
    o = p.where("h > 2.5D").select("frame", "slot", "d", "l", C.floor_bin(F.col("d"), 4.0).alias("at"))
    near = a.withColumn("at", F.explode(F.sequence(C.floor_bin(F.col("ad"), 4.0) - 1, C.floor_bin(F.col("ad"), 4.0) + 1))).join(o, ["frame", "at"])
    m = near.where((F.abs(F.col("d") - F.col("ad")) <= 4.0) & (F.abs(F.col("l") - F.col("al")) <= 0.5)).groupBy("frame", "cluster").agg(F.count_distinct("slot").alias("near"))
    n = a.groupBy("frame", "cluster").agg(F.count(F.lit(1)).alias("n"))
    return n.join(m, ["frame", "cluster"], "left").fillna(0, ["near"]).withColumn("outnumbered", F.col("near") > F.col("n"))


@query(f"""WITH {PT}, b AS (SELECT slot % 40 AS ring, degrees(atan2(l, d)) AS az, degrees(asin(h / sqrt(d * d + l * l + h * h))) AS el FROM pt),
m AS (SELECT ring, median(el) AS el, median(az) AS az, count(*) AS n FROM b GROUP BY ring), f AS (SELECT az FROM m WHERE ring = 0)
SELECT ring, n, round(el, 6) AS elevation, round(m.az - f.az, 6) AS azimuth_offset FROM m, f WHERE n >= 10""")
def beam_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median elevation of each ring and its azimuth offset against the first.  One row is broadcast."""
    d, s, h = F.col("d"), F.col("l"), F.col("h")
    b = points(spark, sf_dir).select((F.col("slot") % 40).alias("ring"), C.azimuth_deg(d, s).alias("az"), C.elevation_deg(h, C.range_of(d, s, h)).alias("el"))
    m = b.groupBy("ring").agg(F.percentile("el", 0.5).alias("el"), F.percentile("az", 0.5).alias("az"), F.count(F.lit(1)).alias("n"))
    f = m.where("ring = 0").select(F.col("az").alias("az0"))
    return m.where("n >= 10").join(F.broadcast(f), how="cross").select("ring", "n", F.round("el", 6).alias("elevation"), F.round(F.col("az") - F.col("az0"), 6).alias("azimuth_offset"))


@query(f"""WITH {PT}, s AS (SELECT frame, quantile_cont(abs(d), 0.98) AS reach, quantile_cont(degrees(atan2(l, d)), 0.97) - quantile_cont(degrees(atan2(l, d)), 0.03) AS spread,
  avg((slot % 40 = slot // 2 % 40)::INT) > 0.9e0 AS layout, avg((r = floor(r))::INT) AS whole FROM pt GROUP BY frame) SELECT frame, round(reach, 4) AS reach, round(spread, 6) AS spread, layout, round(whole, 6) AS whole FROM s""")
def axis_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reach and angular spread of each frame, and probes of its layout."""
    az = C.azimuth_deg(F.col("d"), F.col("l"))
    return points(spark, sf_dir).groupBy("frame").agg(
        F.round(F.percentile(F.abs("d"), 0.98), 4).alias("reach"), F.round(F.percentile(az, 0.97) - F.percentile(az, 0.03), 6).alias("spread"),
        (F.avg((F.col("slot") % 40 == F.floor(F.col("slot") / 2) % 40).cast("int")) > 0.9).alias("layout"), F.round(F.avg((F.col("r") == F.floor("r")).cast("int")), 6).alias("whole"),
    )


@query(f"""WITH {FR}, m AS (SELECT bag, dist AS a, k * 1e0 AS b, row_number() OVER (PARTITION BY bag ORDER BY dist, i) - 1 AS rn, count(*) OVER (PARTITION BY bag) AS n FROM fr WHERE k % 2 = 0)
SELECT bag, round(median(a), 6) AS a, round(median(b), 6) AS b, max(a) FILTER (rn = n // 2) AS base FROM m GROUP BY bag""")
def median_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element-wise median of models of one kind, and the upper-middle model by a stable order."""
    m = frames(spark, sf_dir).where("k % 2 = 0").select("bag", "i", F.col("dist").alias("a"), F.col("k").cast("double").alias("b"))
    w = Window.partitionBy("bag")
    r = m.withColumn("rn", F.row_number().over(w.orderBy("a", "i")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    return r.groupBy("bag").agg(F.round(F.percentile("a", 0.5), 6).alias("a"), F.round(F.percentile("b", 0.5), 6).alias("b"), F.max(F.when(F.col("rn") == F.floor(F.col("n") / 2), F.col("a"))).alias("base"))


@query(f"""WITH {FR}, c AS (SELECT bag, i, dist, 400e0 - i * 2e0 AS reference FROM fr WHERE status = 'detected')
SELECT bag, count(*) FILTER (abs(dist - reference) <= 40) AS hits, count(*) FILTER (abs(dist - reference) > 40) AS others, bool_or(abs(dist - reference) <= 40) AS any_hit FROM c GROUP BY bag""")
def reference_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates on a reference trajectory, and the others."""
    near = F.abs(F.col("dist") - (400.0 - F.col("i") * 2.0)) <= 40
    return frames(spark, sf_dir).where("status = 'detected'").groupBy("bag").agg(F.count_if(near).alias("hits"), F.count_if(~near).alias("others"), F.bool_or(near).alias("any_hit"))


@query(f"""WITH {FR}, r AS (SELECT bag, i, k, coalesce(lag(i) OVER (PARTITION BY bag, k % 3 ORDER BY i), -1) AS prev, coalesce(lead(i) OVER (PARTITION BY bag, k % 3 ORDER BY i), -1) AS nxt FROM fr) SELECT bag, i, prev, nxt FROM r""")
def scan_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previous and next slot of the same line."""
    w = Window.partitionBy("bag", F.col("k") % 3).orderBy("i")
    none = F.lit(-1).cast("long")
    return frames(spark, sf_dir).select("bag", "i", F.coalesce(F.lag("i").over(w), none).alias("prev"), F.coalesce(F.lead("i").over(w), none).alias("nxt"))


@query("""SELECT c.cls || '_' || d.d::VARCHAR || '_' || n.n::VARCHAR AS scene, c.cls, d.d AS distance, n.n AS objects, row_number() OVER (ORDER BY c.cls, d.d, n.n) - 1 AS seed
FROM (SELECT unnest(['box', 'person', 'pipe']) AS cls) c, (SELECT unnest(range(20, 300, 20)) AS d) d, (SELECT unnest(range(1, 4)) AS n) n""")
def sweep_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every class, distance and count of a sweep; seeds follow from the grid's arithmetic."""
    rows = spark.range(3 * 14 * 3)
    cls = F.element_at(F.array(F.lit("box"), F.lit("person"), F.lit("pipe")), (F.floor(F.col("id") / 42) + 1).cast("int"))
    d, n = (F.floor(F.col("id") / 3) % 14) * 20 + 20, F.col("id") % 3 + 1
    g = rows.select(cls.alias("cls"), d.cast("long").alias("distance"), n.alias("objects"), F.col("id").alias("seed"))
    return g.select(F.concat_ws("_", "cls", F.col("distance").cast("string"), F.col("objects").cast("string")).alias("scene"), "cls", "distance", "objects", "seed")


@query(f"""WITH {PT} SELECT frame, round(avg(CASE WHEN h > l THEN sqrt(power(d, 2) + power(h, 2)) ELSE d END), 4) AS remapped, round(avg(h * h + l * l + d * d), 3) AS norm2, round(avg((d * h + l * r) / sqrt((d * d + l * l) * (h * h + r * r))), 5) AS cosine FROM pt GROUP BY frame""")
def vector_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dot products and cosines by array functions, and a remap by case."""
    a, b = F.array("d", "l"), F.array("h", "r")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    remap = F.when(F.col("h") > F.col("l"), F.sqrt(F.pow("d", F.lit(2)) + F.pow("h", F.lit(2)))).otherwise(F.col("d"))
    return points(spark, sf_dir).groupBy("frame").agg(
        F.round(F.avg(remap), 4).alias("remapped"), F.round(F.avg(F.col("h") * F.col("h") + F.col("l") * F.col("l") + F.col("d") * F.col("d")), 3).alias("norm2"),
        F.round(F.avg(dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))), 5).alias("cosine"),
    )


@query(f"""WITH {PT} SELECT frame, count(*) FILTER (abs(degrees(atan2(l, d))) <= 0.5e0) AS in_wedge, count(*) FILTER (slot % 2 = 0 AND abs(degrees(atan2(l, d))) <= 0.5e0) AS first_returns FROM pt WHERE d >= 0 GROUP BY frame""")
def wedge_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Azimuth crop: a cheap superset test before the exact one."""
    p = points(spark, sf_dir).where("d >= 0")
    cheap = F.abs("l") <= F.col("d") * math.tan(math.radians(0.5)) * (1 + 1e-5) + 1e-6
    inside = cheap & (F.abs(C.azimuth_deg(F.col("d"), F.col("l"))) <= 0.5)
    return p.groupBy("frame").agg(F.count_if(inside).alias("in_wedge"), F.count_if((F.col("slot") % 2 == 0) & inside).alias("first_returns"))
