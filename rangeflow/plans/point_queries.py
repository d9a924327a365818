"""Queries over points and vectors: cells, bins, corridors, fits, neighbourhoods, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import cells as cl
from ..operators import fit
from ..operators.graph import connected_components
from ..operators.match import radius_pairs
from ..operators.quantiles import rank_quantiles, robust_nearest, spread_quantiles
from ..session import read_table
from .views import PT, V3, band_sql, points, vectors

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""WITH s AS (SELECT l_returnflag AS flag, l_extendedprice AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
SELECT flag, max(n) AS n, round(quantile_cont(x, 0.98), 4) AS q_linear, max(x) FILTER (i = floor((n - 1) * 0.98e0)) AS q_floor, max(x) FILTER (i = least(n - 1, floor(n * 0.98e0))) AS q_int,
  max(x) FILTER (i = round_even((n - 1) * 0.98e0, 0)) AS q_round, max(x) FILTER (i = n // 2) AS q_upper FROM s GROUP BY flag""")
def quantile_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five quantile conventions side by side."""
    li = read_table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("x"))
    got = spread_quantiles(li, ["flag"], "x", {"q_linear": (0.98, "linear"), "q_floor": (0.98, "floor"), "q_int": (0.98, "int"), "q_round": (0.98, "round"), "q_upper": (0.5, "upper")})
    return got.withColumn("q_linear", F.round("q_linear", 4))


@query("""SELECT l_suppkey AS frame, l_linenumber::BIGINT AS line, count(*) AS n, round(CASE WHEN count(*) >= 10 THEN quantile_cont(l_quantity, 0.1) ELSE min(l_quantity) END, 6) AS nearest FROM lineitem GROUP BY ALL""")
def robust_nearest_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("frame"), F.col("l_linenumber").cast("long").alias("line")).agg(F.count(F.lit(1)).alias("n"), F.round(robust_nearest("l_quantity"), 6).alias("nearest"))


@query(f"""WITH {PT}, v AS (SELECT *, 0.8e0 + 0.02e0 * d AS s FROM pt)
SELECT frame, floor(d / s)::BIGINT AS cd, floor(l / s)::BIGINT AS cl, floor(h / s)::BIGINT AS ch, count(*) AS n, min(slot) AS slot, round(arg_min(d, slot), 6) AS d FROM v GROUP BY ALL""")
def voxel_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point a voxel, the lowest slot; voxels grow with distance."""
    p = points(spark, sf_dir)
    k = cl.voxel_keys(F.col("d"), F.col("l"), F.col("h"), 0.8, 0.02)
    return cl.first_per_cell(p, {"frame": F.col("frame"), "cd": k[0], "cl": k[1], "ch": k[2]}, "slot", ["d"]).withColumn("d", F.round("d", 6))


@query(f"""WITH {PT}, c AS (SELECT *, floor(d / 5)::BIGINT AS row, floor(l / 0.2e0)::BIGINT AS col FROM pt)
SELECT frame, row, col, count(*) AS n, min(r) AS near_r, arg_min(slot, r * 100000 + slot) AS near_slot, max(r) AS far_r, arg_max(slot, r * 100000 + slot) AS far_slot FROM c GROUP BY ALL""")
def cell_near_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest and farthest return of each cell, ties by slot."""
    p = points(spark, sf_dir).select("frame", C.floor_bin(F.col("d"), 5.0).alias("row"), C.floor_bin(F.col("l"), 0.2).alias("col"), "r", "slot")
    return cl.near_far_per_cell(p, ["frame", "row", "col"], "r", "slot")


@query(f"""WITH {PT}, b AS (SELECT flag, floor(d / 2)::BIGINT AS bin, h, row_number() OVER (PARTITION BY flag, floor(d / 2) ORDER BY h) - 1 AS i, count(*) OVER (PARTITION BY flag, floor(d / 2)) AS n FROM pt)
SELECT flag, bin, max(n) AS n, round(max(h) FILTER (i = floor((n - 1) * 0.1e0)), 6) AS floor_h, least(max(n), 500) AS weight FROM b GROUP BY flag, bin HAVING max(n) >= CASE WHEN bin * 2 <= 45 THEN 40 ELSE 8 END""")
def binned_floor_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low height of 2 m bins by the floor-index quantile; near bins need more points."""
    p = points(spark, sf_dir).select("flag", C.floor_bin(F.col("d"), 2.0).alias("bin"), "h")
    q = spread_quantiles(p, ["flag", "bin"], "h", {"floor_h": (0.1, "floor")}).where(F.col("n") >= F.when(F.col("bin") * 2 <= 45, 40).otherwise(8))
    return q.select("flag", "bin", "n", F.round("floor_h", 6).alias("floor_h"), F.least(F.col("n"), F.lit(500).cast("long")).alias("weight"))


@query(f"""WITH {PT}, e AS (SELECT *, (d >= 10)::INT + (d >= 25)::INT + (d >= 60)::INT + (d >= 120)::INT AS bin FROM pt),
q AS (SELECT frame, bin, h, row_number() OVER (PARTITION BY frame, bin ORDER BY h) - 1 AS i, count(*) OVER (PARTITION BY frame, bin) AS n FROM e),
c AS (SELECT frame, bin, max(h) FILTER (i = floor((n - 1) * 0.98e0)) AS cap FROM q GROUP BY ALL HAVING max(n) >= 10)
SELECT frame, count(*) AS n, count(*) FILTER (h > cap - 0.6e0) AS over_cap, count(*) FILTER (cap IS NULL) AS uncapped FROM e LEFT JOIN c USING (frame, bin) GROUP BY frame""")
def ceiling_cap_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A high quantile a non-uniform bin, brought back to the points it caps."""
    e = points(spark, sf_dir).select("frame", C.digitize(F.col("d"), [10.0, 25.0, 60.0, 120.0]).alias("bin"), "h")
    c = rank_quantiles(e, ["frame", "bin"], "h", {"cap": (0.98, "floor")}).where("n >= 10").select("frame", "bin", "cap")
    j = e.join(c, ["frame", "bin"], "left")
    return j.groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("h") > F.col("cap") - 0.6).alias("over_cap"), F.count_if(F.col("cap").isNull()).alias("uncapped"))


@query("""WITH h AS (SELECT o_orderpriority AS prio, floor(o_totalprice / 2000)::BIGINT AS bin, count(*) AS c FROM orders GROUP BY ALL),
w AS (SELECT prio, bin, sum(c) OVER (PARTITION BY prio ORDER BY bin RANGE BETWEEN CURRENT ROW AND 4 FOLLOWING)::BIGINT AS n FROM h)
SELECT prio, arg_max(bin, n * 1000000 - bin) AS start, max(n) AS n FROM w GROUP BY prio""")
def densest_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("prio"), "o_totalprice")
    return cl.densest_window(o, ["prio"], "o_totalprice", 2000.0, 5)


@query(f"""WITH {PT}, c AS (SELECT DISTINCT frame, floor(d * 4)::BIGINT AS cell FROM pt), g AS (SELECT *, lead(cell) OVER (PARTITION BY frame ORDER BY cell) AS nxt FROM c)
SELECT frame, cell + 1 AS lo, nxt - 1 AS hi FROM g WHERE nxt - cell > 5""")
def free_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select("frame", C.floor_bin(F.col("d"), 0.25).alias("cell"))
    return cl.free_intervals(p, ["frame"], "cell", 5)


@query(f"""WITH {PT}, s AS (SELECT frame, floor(d / 20)::BIGINT AS bin, l > 0 AS right_side, abs(l) AS a, h FROM pt),
e AS (SELECT frame, bin, right_side, quantile_cont(a, 0.2) AS edge, count(*) AS n FROM s GROUP BY ALL HAVING count(*) >= 4),
w AS (SELECT e.*, (SELECT max(h) - min(h) FROM s WHERE s.frame = e.frame AND s.bin = e.bin AND s.right_side = e.right_side AND a <= edge + 0.5e0) AS span FROM e),
k AS (SELECT *, lead(edge, 1) OVER v AS e1, lead(edge, 2) OVER v AS e2 FROM w WHERE span >= 1.2e0 WINDOW v AS (PARTITION BY frame, right_side ORDER BY bin))
SELECT frame, right_side, bin, round(edge, 6) AS edge, coalesce(edge - e1 >= 0.15e0 AND e1 - e2 >= 0.15e0, false) AS closing FROM k""")
def wall_edge_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner wall edge a bin and side, and where three edges in a row close in."""
    s = points(spark, sf_dir).select("frame", C.floor_bin(F.col("d"), 20.0).alias("bin"), (F.col("l") > 0).alias("right_side"), F.abs("l").alias("a"), "h")
    e = s.groupBy("frame", "bin", "right_side").agg(F.percentile("a", 0.2).alias("edge"), F.count(F.lit(1)).alias("n")).where("n >= 4")
    near = s.join(e, ["frame", "bin", "right_side"]).where(F.col("a") <= F.col("edge") + 0.5)
    w = near.groupBy("frame", "bin", "right_side", "edge").agg((F.max("h") - F.min("h")).alias("span")).where("span >= 1.2")
    v = Window.partitionBy("frame", "right_side").orderBy("bin")
    closing = (F.col("edge") - F.lead("edge", 1).over(v) >= 0.15) & (F.lead("edge", 1).over(v) - F.lead("edge", 2).over(v) >= 0.15)
    return w.select("frame", "right_side", "bin", F.round("edge", 6).alias("edge"), F.coalesce(closing, F.lit(False)).alias("closing"))


@query(f"""WITH {PT}, g AS (SELECT *, 0.05e0 + 0.0001e0 * least(d, 60e0) + 0.00001e0 * least(d, 60e0) * least(d, 60e0) + (0.0001e0 + 2 * 0.00001e0 * 60e0) * greatest(0e0, d - 60e0) AS rail,
  0.02e0 + 0.001e0 * d + 0.0001e0 * d * d * 0.001e0 AS centre FROM pt WHERE d BETWEEN 3 AND 300 AND abs(l) <= 12 AND h BETWEEN -8 AND 10),
m AS (SELECT *, h - rail AS dh, l - centre AS dl, greatest(0e0, d - 80e0) AS beyond, CASE WHEN h - rail < 0.8e0 THEN 1e0 ELSE 1.4e0 END - 0.003e0 * d - 0.1e0 * 1e-7 * d * d AS hw FROM g)
SELECT frame, count(*) AS n_roi, count(*) FILTER (abs(dl) <= CASE WHEN hw < 0.7e0 THEN -1e0 ELSE hw END AND dh >= 0.3e0 + 0.002e0 * d + 0.008e0 * beyond AND dh <= 3.4e0 - 0.002e0 * d - 0.006e0 * beyond) AS n_box FROM m GROUP BY frame""")
def corridor_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the region of interest, and those inside the clearance corridor of a literal model."""
    d, s, h = F.col("d"), F.col("l"), F.col("h")
    p = points(spark, sf_dir).where(C.is_valid_point(d, s, h) & d.between(3, 300) & (F.abs(s) <= 12) & h.between(-8, 10))
    dh = h - C.rail_height(d, 0.05, 1e-4, 1e-5, 60.0)
    dl = s - C.centre_line(d, 0.02, 1e-3, 1e-7)
    return p.groupBy("frame").agg(F.count(F.lit(1)).alias("n_roi"), F.count_if(C.in_corridor(d, dl, dh, 1e-7, 80.0)).alias("n_box"))


_CLUSTER = """g AS (SELECT frame, floor(d / 10)::BIGINT AS cell, count(*) AS n, median(d) AS d_near, max(d) - min(d) AS ext_d, max(l) - min(l) AS ext_l, max(h) - min(h) AS ext_h,
  avg(h) AS mean_h, min(h) AS min_h, max(abs(l)) AS max_l FROM pt GROUP BY ALL)"""


@query(f"""WITH {PT}, {_CLUSTER}
SELECT CASE WHEN n < CASE WHEN d_near < 100 THEN 5 ELSE 4 END THEN 'too few points' WHEN d_near > 175 THEN 'beyond model' WHEN ext_d > 9.5 THEN 'too deep'
  WHEN ext_h < 0.12 AND greatest(ext_d, ext_l) >= 0.4 AND mean_h >= 1.5 THEN 'flat overhead' WHEN d_near >= 100 AND min_h >= 1.5 THEN 'hanging far'
  WHEN greatest(ext_l, ext_h) < 0.10 AND n < 15 THEN 'tiny' WHEN ext_h < 0.20 AND ext_d > 1.0 THEN 'low plate' WHEN ext_l < 0.35 AND max_l > 0.85 THEN 'thin at edge'
  WHEN d_near >= 100 AND ext_h < 0.25 THEN 'low far' WHEN d_near >= 60 AND ext_h < 0.5 * greatest(ext_d, ext_l) THEN 'longer than high' ELSE 'accepted' END AS reason,
  count(*) AS clusters, sum(n)::BIGINT AS points, round(avg(least(1e0, n / greatest(3e0, 60e0 / power(greatest(1e0, d_near / 20), 2)))), 6) AS confidence FROM g GROUP BY 1""")
def rule_chain_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters judged by an ordered chain of rules: the first that fits is the reason."""
    p = points(spark, sf_dir)
    g = p.groupBy("frame", C.floor_bin(F.col("d"), 10.0).alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.percentile("d", 0.5).alias("d_near"), (F.max("d") - F.min("d")).alias("ext_d"), (F.max("l") - F.min("l")).alias("ext_l"),
        (F.max("h") - F.min("h")).alias("ext_h"), F.avg("h").alias("mean_h"), F.min("h").alias("min_h"), F.max(F.abs("l")).alias("max_l"),
    )
    rules = [
        ("too few points", "n < if(d_near < 100, 5, 4)"),
        ("beyond model", "d_near > 175"),
        ("too deep", "ext_d > 9.5D"),
        ("flat overhead", "ext_h < 0.12D and greatest(ext_d, ext_l) >= 0.4D and mean_h >= 1.5D"),
        ("hanging far", "d_near >= 100 and min_h >= 1.5D"),
        ("tiny", "greatest(ext_l, ext_h) < 0.10D and n < 15"),
        ("low plate", "ext_h < 0.20D and ext_d > 1.0D"),
        ("thin at edge", "ext_l < 0.35D and max_l > 0.85D"),
        ("low far", "d_near >= 100 and ext_h < 0.25D"),
        ("longer than high", "d_near >= 60 and ext_h < 0.5D * greatest(ext_d, ext_l)"),
    ]
    reason = F.coalesce(*[F.when(F.expr(c), F.lit(r)) for r, c in rules], F.lit("accepted"))
    return g.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("clusters"), F.sum("n").alias("points"), F.round(F.avg(C.confidence(F.col("n"), F.col("d_near"))), 6).alias("confidence"))


@query("""WITH p AS (SELECT l_returnflag AS flag, l_quantity / 10e0 AS x, l_extendedprice / 10000e0 AS y, 1e0 + l_discount AS w FROM lineitem),
s AS (SELECT flag, count(*) AS n, sum(w) s0, sum(w*x) s1, sum(w*x*x) s2, sum(w*x*x*x) s3, sum(w*x*x*x*x) s4, sum(w*y) t0, sum(w*y*x) t1, sum(w*y*x*x) t2 FROM p GROUP BY flag),
f AS (SELECT *, s0*(s2*s4-s3*s3) - s1*(s1*s4-s3*s2) + s2*(s1*s3-s2*s2) AS det, s0*(s2*t2-t1*s3) - s1*(s1*t2-t1*s2) + t0*(s1*s3-s2*s2) AS dc,
  t0*(s2*s4-s3*s3) - s1*(t1*s4-s3*t2) + s2*(t1*s3-s2*t2) AS da, s0*(t1*s4-s3*t2) - t0*(s1*s4-s3*s2) + s2*(s1*t2-t1*s2) AS db FROM s),
c AS (SELECT *, dc/det AS c0, greatest(-0.05e0, least(0.05e0, dc/det)) AS c FROM f)
SELECT flag, n, round(CASE WHEN abs(c0) > 0.05e0 THEN ((t0-c*s2)*s2 - (t1-c*s3)*s1)/(s0*s2-s1*s1) ELSE da/det END, 5) AS a,
  round(CASE WHEN abs(c0) > 0.05e0 THEN ((t1-c*s3)*s0 - (t0-c*s2)*s1)/(s0*s2-s1*s1) ELSE db/det END, 5) AS b, round(c, 5) AS c FROM c""")
def weighted_quadratic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), (F.col("l_quantity") / 10.0).alias("x"), (F.col("l_extendedprice") / 10000.0).alias("y"), (1.0 + F.col("l_discount")).alias("w"))
    got = fit.weighted_quadratic(p, ["flag"], F.col("x"), F.col("y"), F.col("w"), 0.05)
    return got.select("flag", "n", *[F.round(c, 5).alias(c) for c in "abc"])


@query(f"""WITH {V3}, m AS (SELECT label, count(*) AS n, covar_pop(e0,e0) xx, covar_pop(e1,e1) yy, covar_pop(e2,e2) zz, covar_pop(e0,e1) xy, covar_pop(e0,e2) xz, covar_pop(e1,e2) yz FROM v3 GROUP BY label),
q AS (SELECT *, (xx+yy+zz)/3 AS q FROM m), p AS (SELECT *, sqrt((power(xx-q,2)+power(yy-q,2)+power(zz-q,2)+2*(xy*xy+xz*xz+yz*yz))/6) AS p FROM q),
r AS (SELECT *, acos(greatest(-1e0, least(1e0, ((xx-q)*((yy-q)*(zz-q)-yz*yz) - xy*(xy*(zz-q)-yz*xz) + xz*(xy*yz-(yy-q)*xz))/(2*power(p,3)))))/3 AS phi FROM p)
SELECT label, n, round(q+2*p*cos(phi+2*pi()/3), 5) AS l1, round(3*q-(q+2*p*cos(phi+2*pi()/3))-(q+2*p*cos(phi)), 5) AS l2, round(q+2*p*cos(phi), 5) AS l3 FROM r""")
def covariance_planarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fit.planarity(vectors(spark, sf_dir), ["label"], ["e0", "e1", "e2"])
    return got.select("label", "n", *[F.round(c, 5).alias(c) for c in ("l1", "l2", "l3")])


@query(f"""WITH {V3} SELECT a.vec_id AS a, b.vec_id AS b, round(sqrt((a.e0-b.e0)*(a.e0-b.e0)+(a.e1-b.e1)*(a.e1-b.e1)+(a.e2-b.e2)*(a.e2-b.e2)), 6) AS distance
FROM v3 a JOIN v3 b ON a.vec_id < b.vec_id WHERE sqrt((a.e0-b.e0)*(a.e0-b.e0)+(a.e1-b.e1)*(a.e1-b.e1)+(a.e2-b.e2)*(a.e2-b.e2)) <= 0.3e0""")
def radius_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs within a radius by a grid of cells."""
    return radius_pairs(vectors(spark, sf_dir), [], ["e0", "e1", "e2"], "vec_id", 0.3).withColumn("distance", F.round("distance", 6))


@query(f"""WITH RECURSIVE {V3}, e AS (SELECT a.vec_id AS s, b.vec_id AS t FROM v3 a JOIN v3 b ON a.vec_id <> b.vec_id
  WHERE sqrt((a.e0-b.e0)*(a.e0-b.e0)+(a.e1-b.e1)*(a.e1-b.e1)+(a.e2-b.e2)*(a.e2-b.e2)) <= 0.3e0),
r AS (SELECT vec_id AS id, vec_id AS reach FROM v3 UNION SELECT e.t, r.reach FROM r JOIN e ON e.s = r.id WHERE r.reach < e.t)
SELECT id, min(reach) AS component FROM (SELECT * FROM r) GROUP BY id""")
def connected_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of vectors: components of the pairs within a radius, lone vectors on their own."""
    v = vectors(spark, sf_dir)
    pairs = radius_pairs(v, [], ["e0", "e1", "e2"], "vec_id", 0.3)
    c = connected_components(pairs, "a", "b")
    return v.select(F.col("vec_id").alias("id")).join(c, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


@query(f"""WITH {PT}, j AS (SELECT frame, r, slot, r - lag(r) OVER (PARTITION BY frame ORDER BY r, slot) AS gap FROM pt),
s AS (SELECT *, sum(CASE WHEN gap > greatest(0.5e0, 0.01e0 * r) THEN 1 ELSE 0 END) OVER (PARTITION BY frame ORDER BY r, slot)::BIGINT AS part FROM j)
SELECT frame, part, count(*) AS n, min(r) AS r_min, max(r) AS r_max FROM s GROUP BY ALL""")
def component_range_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components cut where sorted ranges jump."""
    w = Window.partitionBy("frame").orderBy("r", "slot")
    gap = F.col("r") - F.lag("r").over(w)
    j = points(spark, sf_dir).withColumn("jump", F.coalesce((gap > F.greatest(F.lit(0.5), 0.01 * F.col("r"))).cast("long"), F.lit(0).cast("long")))
    s = j.withColumn("part", F.sum("jump").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("frame", "part").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("r_min"), F.max("r").alias("r_max"))


@query(f"""WITH {PT}, c AS (SELECT frame, floor(d / 10)::BIGINT AS row, floor(l / 0.25e0)::BIGINT AS col, min(r) AS r FROM pt GROUP BY ALL),
p AS (SELECT a.frame, a.row, a.col, a.r, min(b.r) AS lo, max(b.r) AS hi FROM c a JOIN c b ON b.frame = a.frame - 1 AND abs(b.row - a.row) <= 1 AND abs(b.col - a.col) <= 1 GROUP BY ALL),
k AS (SELECT p.* FROM p JOIN c o ON o.frame = p.frame - 1 AND o.row = p.row AND o.col = p.col)
SELECT frame, count(*) AS shared, round(avg((r >= lo - (0.05e0 + 0.002e0 * r) AND r <= hi + (0.05e0 + 0.002e0 * r))::INT), 6) AS still FROM k GROUP BY frame""")
def static_fraction_3x3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cells that lie within the 3 x 3 range of the frame before."""
    c = points(spark, sf_dir).groupBy("frame", C.floor_bin(F.col("d"), 10.0).alias("row"), C.floor_bin(F.col("l"), 0.25).alias("col")).agg(F.min("r").alias("r"))
    rows = c.select((F.col("frame") + 1).alias("frame"), F.explode(F.array(*[F.struct((F.col("row") + k).alias("row"), F.lit(k).alias("off")) for k in (-1, 0, 1)])).alias("_s"), "col", "r").select("frame", "_s.*", "col", "r")
    beside = Window.partitionBy("frame", "row").orderBy("col").rangeBetween(-1, 1)  # cells of three rows meet in the middle one
    span = rows.select("frame", "row", "col", "off", F.min("r").over(beside).alias("lo"), F.max("r").over(beside).alias("hi")).where("off = 0")
    tol = 0.05 + 0.002 * F.col("r")
    k = c.join(span, ["frame", "row", "col"]).select("frame", ((F.col("r") >= F.col("lo") - tol) & (F.col("r") <= F.col("hi") + tol)).cast("int").alias("ok"))
    return k.groupBy("frame").agg(F.count(F.lit(1)).alias("shared"), F.round(F.avg("ok"), 6).alias("still"))


@query(f"""WITH {PT}, b AS (SELECT flag, floor(d / 4)::BIGINT AS bin, avg(h) AS y FROM pt GROUP BY ALL), s AS (SELECT unnest(range(-5, 6)) AS shift),
x AS (SELECT shift, count(*) AS n, corr(a.y, c.y) AS score FROM b a CROSS JOIN s JOIN b c ON c.bin = a.bin + shift WHERE a.flag = 'A' AND c.flag = 'N' GROUP BY shift)
SELECT shift, n, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, abs(shift), shift) = 1 AS best FROM x""")
def xcorr_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised cross-correlation of two profiles over shifts, and the best shift."""
    b = points(spark, sf_dir).groupBy("flag", C.floor_bin(F.col("d"), 4.0).alias("bin")).agg(F.avg("h").alias("y"))
    a = b.where("flag = 'A'").select(F.explode(F.sequence(F.lit(-5).cast("long"), F.lit(5).cast("long"))).alias("shift"), "bin", F.col("y").alias("ya"))
    x = a.withColumn("bin", F.col("bin") + F.col("shift")).join(b.where("flag = 'N'").select("bin", F.col("y").alias("yb")), "bin").groupBy("shift").agg(F.count(F.lit(1)).alias("n"), F.corr("ya", "yb").alias("score"))
    best = Window.orderBy(F.desc("score"), F.abs("shift"), "shift")  # eleven rows
    return x.select("shift", "n", F.round("score", 6).alias("score"), (F.row_number().over(best) == 1).alias("best"))


@query(f"""WITH {V3} SELECT vec_id, round(sqrt(e0*e0+e1*e1+e2*e2), 6) AS r, round(degrees(atan2(e1, e0)), 6) AS az, round(degrees(asin(greatest(-1e0, least(1e0, e2 / sqrt(e0*e0+e1*e1+e2*e2))))), 6) AS el FROM v3""")
def spherical_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = C.range_of(F.col("e0"), F.col("e1"), F.col("e2"))
    return vectors(spark, sf_dir).select("vec_id", F.round(r, 6).alias("r"), F.round(C.azimuth_deg(F.col("e0"), F.col("e1")), 6).alias("az"), F.round(C.elevation_deg(F.col("e2"), r), 6).alias("el"))


@query("""SELECT x.slot, x.slot % 40 AS ring, (x.slot // 40) % 1200 AS col, (x.slot // 40) % 2 AS firing, (x.slot % 40) % 2 = (x.slot // 40) % 2 AS fired FROM (SELECT DISTINCT l_orderkey AS slot FROM lineitem) x""")
def beam_index_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ring, column and firing parity from a slot; rings fire in turn."""
    ring, col, firing = C.ring_column_firing(F.col("slot"), 40, 1200)
    s = read_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("slot")).distinct()
    return s.select("slot", ring.alias("ring"), col.alias("col"), firing.alias("firing"), (ring % 2 == firing).alias("fired"))


@query(f"""WITH {V3}, b(box, x0, x1, y0, y1, z0, z1) AS (VALUES (1, 1e0, 2e0, -1e0, 1e0, -1e0, 1e0), (2, -3e0, -2e0, -2e0, 2e0, -2e0, 2e0), (3, -1e0, 1e0, 2e0, 3e0, -1.5e0, 1.5e0)),
t AS (SELECT vec_id, box, least(x0/e0,x1/e0) a0, greatest(x0/e0,x1/e0) b0, least(y0/e1,y1/e1) a1, greatest(y0/e1,y1/e1) b1, least(z0/e2,z1/e2) a2, greatest(z0/e2,z1/e2) b2 FROM v3, b WHERE e0<>0 AND e1<>0 AND e2<>0),
h AS (SELECT vec_id, box, greatest(0e0,a0,a1,a2) AS near, least(b0,b1,b2) AS far FROM t)
SELECT vec_id, arg_min(box, near * 1000 + box)::BIGINT AS box, round(min(near), 6) AS t FROM h WHERE near <= far GROUP BY vec_id""")
def ray_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest box that each direction from the origin hits."""
    boxes = [(1, (1.0, -1.0, -1.0), (2.0, 1.0, 1.0)), (2, (-3.0, -2.0, -2.0), (-2.0, 2.0, 2.0)), (3, (-1.0, 2.0, -1.5), (1.0, 3.0, 1.5))]
    o, v = tuple(F.lit(0.0) for _ in range(3)), (F.col("e0"), F.col("e1"), F.col("e2"))
    hits = F.array(*[F.struct(C.box_distance(o, v, tuple(map(F.lit, a)), tuple(map(F.lit, b))).alias("t"), F.lit(k).cast("long").alias("box")) for k, a, b in boxes])
    best = F.array_min(F.filter(hits, lambda x: x["t"].isNotNull()))
    return vectors(spark, sf_dir).where("e0 <> 0 and e1 <> 0 and e2 <> 0").withColumn("b", best).where("b is not null").select("vec_id", F.col("b.box").alias("box"), F.round("b.t", 6).alias("t"))


@query(f"""WITH {PT}, c AS (SELECT frame, floor(d / 10)::BIGINT AS row, floor(l / 0.25e0)::BIGINT AS col, arg_min(h, r * 100000 + slot) AS v FROM pt GROUP BY ALL),
g AS (SELECT DISTINCT frame, row FROM c), k AS (SELECT frame, row, unnest(range(-4, 5)) AS col FROM g)
SELECT k.frame, k.row, k.col, round(coalesce(v, -1e0), 6) AS v FROM k LEFT JOIN c USING (frame, row, col)""")
def nearest_pool_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points pooled to a coarser grid by the nearest return; empty target cells are filled."""
    p = points(spark, sf_dir).withColumn("row", C.floor_bin(F.col("d"), 10.0)).withColumn("col", C.floor_bin(F.col("l"), 0.25))
    c = p.groupBy("frame", "row", "col").agg(F.min_by("h", F.struct("r", "slot")).alias("v"))
    k = c.select("frame", "row").distinct().withColumn("col", F.explode(F.sequence(F.lit(-4).cast("long"), F.lit(4).cast("long"))))
    return k.join(c, ["frame", "row", "col"], "left").withColumn("v", F.round(F.coalesce("v", F.lit(-1.0)), 6))


@query(f"""WITH {PT} SELECT frame, {band_sql("d")} AS band, count(*) AS n, round(count(*) * avg(r * r) / 100e0, 4) AS density, round(quantile_cont(r, 0.1), 6) AS p10, round(quantile_cont(r, 0.9), 6) AS p90
FROM pt GROUP BY ALL""")
def density_by_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points a band, normalised by squared range, with the spread of ranges."""
    return points(spark, sf_dir).groupBy("frame", C.band_label(F.col("d")).alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.count(F.lit(1)) * F.avg(F.col("r") * F.col("r")) / 100.0, 4).alias("density"), F.round(F.percentile("r", 0.1), 6).alias("p10"), F.round(F.percentile("r", 0.9), 6).alias("p90")
    )


@query(f"""WITH {PT}, c AS (SELECT *, count(*) OVER (PARTITION BY frame) AS m FROM pt) SELECT frame, slot FROM c WHERE slot % ceil(m / 20e0)::BIGINT = 0""")
def decimate_deterministic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every k-th point of a frame in slot order, k so that at most twenty stay."""
    c = points(spark, sf_dir).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("frame")))
    return c.where(F.col("slot") % F.ceil(F.col("m") / 20.0) == 0).select("frame", "slot")


@query(f"""WITH {PT}, q AS (SELECT slot AS id, frame, round_even(d / 0.25e0, 0) * 0.25e0 AS dq, 1e0 / (1e0 + exp(-(r - 25e0) / 5e0)) AS p FROM pt)
SELECT frame, round(sum(dq), 4) AS total, round(avg(p), 6) AS detect FROM q GROUP BY frame""")
def return_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantised distances (half to even) and detection probability of a logistic model."""
    p = points(spark, sf_dir)
    return p.groupBy("frame").agg(F.round(F.sum(C.quantise(F.col("d"), 0.25)), 4).alias("total"), F.round(F.avg(C.logistic((F.col("r") - 25.0) / 5.0)), 6).alias("detect"))
