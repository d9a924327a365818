"""Queries of gates, corridors and rule chains: which points, clusters and candidates count, and why not."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import fit
from ..operators.match import radius_pairs
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


def in_sql(condition: str) -> str:
    """A condition of Spark SQL in the oracle's SQL: double literals are written another way."""
    return re.sub(r"(?<=[0-9])D\b", "e0", condition)


@query(f"""WITH {PT}, v AS (SELECT frame, count(*) AS n_total, count(*) FILTER (r > 2) AS n_valid FROM pt GROUP BY frame)
SELECT frame, n_total, n_valid, CASE WHEN n_valid < 560 THEN 'unknown' ELSE 'clear' END AS status, CASE WHEN n_valid < 560 THEN 'too few valid points' END AS reason FROM v""")
def support_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with too few valid points have no status but "unknown"."""
    v = points(spark, sf_dir).groupBy("frame").agg(F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("r") > 2).alias("n_valid"))
    few = F.col("n_valid") < 560
    return v.select("frame", "n_total", "n_valid", F.when(few, "unknown").otherwise("clear").alias("status"), F.when(few, "too few valid points").alias("reason"))


@query(f"""WITH {PT}, k AS (SELECT col FROM (SELECT unnest(range(0, 60)) AS col) WHERE abs((col - 29.5e0) * 1.5e0) <= 20)
SELECT frame, count(*) AS n, count(DISTINCT slot // 2) AS pairs, min(slot) AS first_slot, max(slot) AS last_slot FROM pt WHERE (slot // 2) % 60 IN (SELECT col FROM k) GROUP BY frame""")
def forward_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns within an azimuth limit, both returns of a beam kept together.  The kept columns are a few dozen rows."""
    k = spark.range(60).where(F.abs((F.col("id") - 29.5) * 1.5) <= 20).select(F.col("id").alias("col"))
    pair = F.floor(F.col("slot") / 2).cast("long")
    p = points(spark, sf_dir).withColumn("pair", pair).withColumn("col", F.col("pair") % 60)
    return p.join(F.broadcast(k), "col", "left_semi").groupBy("frame").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("pair").alias("pairs"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot")
    )


_PIXEL = """m AS (SELECT frame, d, l - 0.02e0 AS dl, h - 0.05e0 AS dh, r, greatest(0e0, d - 120e0) AS beyond, greatest(0e0, d - 80e0) AS beyond_bed FROM pt WHERE r > 0.5e0),
b AS (SELECT *, 0.30e0 + 0.002e0 * d + 0.002e0 * (beyond_bed - beyond) + 0.008e0 * beyond + 0.01e0 AS bottom, 3.40e0 - 0.002e0 * d - 0.006e0 * beyond - 0.01e0 AS top,
  CASE WHEN dh < 0.8e0 THEN 1.0e0 ELSE 1.4e0 END - 0.003e0 * d AS hw FROM m)"""


@query(f"""WITH {PT}, {_PIXEL} SELECT frame, count(*) AS n_valid, count(*) FILTER (abs(dl) <= CASE WHEN hw < 0.7e0 THEN -1e0 ELSE hw END AND dh >= bottom AND dh <= top) AS n_box, round(sum(bottom), 4) AS bottoms FROM b GROUP BY frame""")
def pixel_corridor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corridor membership of pixels: a range floor, and a bottom that rises beyond the bed that was seen."""
    p = points(spark, sf_dir).where("r > 0.5D")
    d, dl, dh = F.col("d"), F.col("l") - 0.02, F.col("h") - 0.05
    bottom, top = C.corridor_bottom(d, 80.0, 120.0, 0.01, bed_slope=0.002), C.corridor_top(d, 120.0, 0.01)
    hw = C.corridor_half_width(d, dh, 0.0)
    inside = (F.abs(dl) <= hw) & (dh >= bottom) & (dh <= top)
    return p.groupBy("frame").agg(F.count(F.lit(1)).alias("n_valid"), F.count_if(inside).alias("n_box"), F.round(F.sum(bottom), 4).alias("bottoms"))


@query(f"""WITH {PT}, c AS (SELECT *, (frame % 9) * 5e-5 AS b FROM pt), f AS (SELECT *, 0.1e0 + greatest(0e0, least(1e0, (abs(b) - 2.5e-4) / (3.5e-4 - 2.5e-4))) * (0.25e0 - 0.1e0) AS factor FROM c),
w AS (SELECT *, CASE WHEN h < 0.8e0 THEN 1.0e0 ELSE 1.4e0 END - 0.003e0 * d - factor * abs(b) * CASE WHEN d <= 60e0 THEN 0.5e0 ELSE 1e0 END * d * d AS hw FROM f)
SELECT frame, round(max(factor), 6) AS factor, round(sum(factor * abs(b) * d * d), 4) AS shrink, count(*) FILTER (hw < 0.7e0) AS closed, count(*) FILTER (hw >= 0.7e0 AND abs(l) <= hw) AS inside FROM w GROUP BY frame""")
def curvature_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corridor narrows with a curve's sagitta, by a factor that ramps up with the curvature; half of it where the shape is known."""
    d, b = F.col("d"), F.col("b")
    p = points(spark, sf_dir).withColumn("b", (F.col("frame") % 9) * 5e-5)
    factor = C.curve_factor_of(b)
    known = F.when(d <= 60.0, 0.5).otherwise(1.0)
    hw = F.when(F.col("h") < 0.8, 1.0).otherwise(1.4) - 0.003 * d - factor * F.abs(b) * known * d * d
    return p.groupBy("frame").agg(
        F.round(F.max(factor), 6).alias("factor"), F.round(F.sum(factor * F.abs(b) * d * d), 4).alias("shrink"), F.count_if(hw < 0.7).alias("closed"), F.count_if((hw >= 0.7) & (F.abs("l") <= hw)).alias("inside")
    )


@query(f"""WITH {PT}, {_PIXEL}, x AS (SELECT *, abs(dl) <= CASE WHEN hw < 0.7e0 THEN -1e0 ELSE hw END AND dh >= bottom AND dh <= top AS inbox FROM b)
SELECT frame, count(*) FILTER (NOT inbox AND abs(dl) <= 4 AND dh >= bottom) AS near_outside, round(avg(d) FILTER (NOT inbox AND abs(dl) <= 4 AND dh >= bottom), 4) AS mean_d FROM x GROUP BY frame""")
def near_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points beside the corridor and above its bottom: what the neighbourhood rules look at."""
    d, dl, dh = F.col("d"), F.col("l") - 0.02, F.col("h") - 0.05
    bottom, top = C.corridor_bottom(d, 80.0, 120.0, 0.01, bed_slope=0.002), C.corridor_top(d, 120.0, 0.01)
    inbox = (F.abs(dl) <= C.corridor_half_width(d, dh, 0.0)) & (dh >= bottom) & (dh <= top)
    near = ~inbox & (F.abs(dl) <= 4) & (dh >= bottom)
    return points(spark, sf_dir).where("r > 0.5D").groupBy("frame").agg(F.count_if(near).alias("near_outside"), F.round(F.avg(F.when(near, d)), 4).alias("mean_d"))


#: The chain of cluster rules, first match wins: reason, condition, passes that skip it (W weak, C compact, P accepted plate).
JUDGE = [
    ("few points", "n < if(d_near < 100, 5, 4)", "WC"),
    ("beyond the model", "d_near > 160D", ""),
    ("too deep", "ext_d > 6D", ""),
    ("flat overhead", "ext_h < 0.12D and greatest(ext_d, ext_l) >= 0.4D and mean_h >= 1.5D", ""),
    ("hanging far", "d_near >= 100 and min_h >= 1.5D", ""),
    ("tiny", "greatest(ext_l, ext_h) < 0.10D and n < 15", ""),
    ("low and long", "ext_h < 0.20D and ext_d > 1.0D", ""),
    ("sliver at the edge", "ext_l < 0.35D and max_l > min_hw - 0.15D and not (short_compact and {C}) and not thin_straddle", ""),
    ("low far", "d_near >= 100 and ext_h < 0.25D", "W"),
    ("longer than high", "d_near >= 60 and ext_h < 0.5D * greatest(ext_d, ext_l)", "WP"),
    ("planar along the ray", "outside > 0 and d_near >= 60 and n >= 6 and flatness < 0.03D and facing < 0.35D", "WP"),
    ("extends above", "outside > 0 and above >= 3 and not face and not hanging_central", ""),
    ("part of surroundings", "outside > 0 and (max_l > min_hw - 0.3D or d_near >= 60) and neighbours > 1.0D * n and not face and not crosses_axis and not hanging_central and not ({C} and thin_straddle)", ""),
]
#: Predicates that exempt a cluster from rules.
EXEMPT = {
    "face": "ext_l >= 1.5D and ext_d <= 1.0D and n >= 20 and ext_h >= 1.5D and min_h <= 1.5D and abs(mean_l) <= 0.9D",
    "plate_across": "ext_l >= 0.8D and ext_d <= 0.6D and n >= 6 and abs(mean_l) <= 0.6D and mean_h <= 1.2D",
    "crosses_axis": "low_l <= -0.25D and high_l >= 0.25D and ext_d <= 0.5D",
    "hanging_central": "d_near <= 70 and min_h >= 1.8D and max_l - min_hw <= -0.5D",
    "short_compact": "ext_d <= 0.6D and least(ext_l, ext_h) >= 0.1D",
    "thin_straddle": "ext_d <= 0.6D and ext_l <= 0.35D and max_l >= min_hw - 0.05D and n >= 3",
}


def chain(skip: str) -> str:
    """The first rule that rejects, as a number; 0 if none does."""
    rules = [(k, c.replace("{C}", "true" if skip == "C" else "false")) for k, (_, c, s) in enumerate(JUDGE, 1) if not skip or skip not in s]
    return "CASE " + " ".join(f"WHEN {c} THEN {k}" for k, c in rules) + " ELSE 0 END"


_NAMES = "CASE reason " + " ".join(f"WHEN {k} THEN '{r}'" for k, (r, _, _) in enumerate(JUDGE, 1)) + " ELSE 'accepted' END"
_FLAGS = {
    "plate": "plate_across and plain <> 0 and as_plate = 0",
    "weak": "reason in (1, 9) and d_near >= 100 and n >= 3 and as_weak = 0",
    "compact": "reason in (1, 8) and n >= 3 and greatest(ext_d, ext_l, ext_h) <= 1D and as_compact = 0",
    "straddle": "reason in (1, 8) and n >= 3 and greatest(ext_d, ext_l, ext_h) <= 1D and as_compact = 0 and thin_straddle",
}
_BOX = "abs(l) <= 1.4e0 - 0.003e0 * d AND h >= 0.30e0 + 0.002e0 * d AND h <= 2.9e0 AND r > 5"


@query(in_sql(f"""WITH {PT}, a AS (SELECT frame, slot, d, l, h, floor(d / 2)::BIGINT AS cell, {_BOX} AS box FROM pt), i AS (SELECT * FROM a WHERE box), o AS (SELECT * FROM a WHERE NOT box),
m AS (SELECT frame, cell, count(*) AS n, median(d) AS d_near, max(d) - min(d) AS ext_d, max(l) - min(l) AS ext_l, max(h) - min(h) AS ext_h, avg(l) AS mean_l, avg(h) AS mean_h, avg(d) AS mean_d, min(h) AS min_h, max(h) AS top, max(abs(l)) AS max_l,
  min(l) AS low_l, max(l) AS high_l, min(d) AS d0, max(d) AS d1, min(1.4e0 - 0.003e0 * d) AS min_hw, covar_pop(d,d) xx, covar_pop(l,l) yy, covar_pop(h,h) zz, covar_pop(d,l) xy, covar_pop(d,h) xz, covar_pop(l,h) yz FROM i GROUP BY ALL),
q AS (SELECT *, (xx+yy+zz)/3 AS q FROM m), p AS (SELECT *, sqrt((power(xx-q,2)+power(yy-q,2)+power(zz-q,2)+2*(xy*xy+xz*xz+yz*yz))/6) AS p FROM q),
e AS (SELECT *, CASE WHEN p = 0 THEN 0e0 ELSE acos(greatest(-1e0, least(1e0, ((xx-q)*((yy-q)*(zz-q)-yz*yz) - xy*(xy*(zz-q)-yz*xz) + xz*(xy*yz-(yy-q)*xz))/(2*power(p,3)))))/3 END AS phi FROM p),
f AS (SELECT *, (q+2*p*cos(phi+2*pi()/3)) / nullif(xx+yy+zz, 0) AS flatness, abs(mean_d * ext_l) / nullif(sqrt(mean_d*mean_d + mean_l*mean_l + mean_h*mean_h) * sqrt(ext_l*ext_l + ext_d*ext_d), 0) AS facing FROM e),
s AS (SELECT f.frame, f.cell, count(*) FILTER (o.d BETWEEN d0 - 0.8e0 AND d1 + 0.8e0 AND o.l BETWEEN low_l - 0.4e0 AND high_l + 0.4e0 AND o.h > top + 0.1e0 AND o.h <= top + 1.3e0) AS above, count(*) AS near_n FROM f JOIN o ON o.frame = f.frame AND abs(o.cell - f.cell) <= 2 GROUP BY ALL),
w AS (SELECT f.frame, f.cell, count(DISTINCT o.slot) AS neighbours FROM f JOIN i ON i.frame = f.frame AND i.cell = f.cell JOIN o ON o.frame = f.frame AND abs(o.cell - f.cell) <= 2
  AND (o.d-i.d)*(o.d-i.d)+(o.l-i.l)*(o.l-i.l)+(o.h-i.h)*(o.h-i.h) <= power(0.35e0 + 0.008e0 * d_near, 2) GROUP BY ALL),
g AS (SELECT f.*, coalesce(above, 0) AS above, coalesce(near_n, 0) AS outside, coalesce(neighbours, 0) AS neighbours FROM f LEFT JOIN s USING (frame, cell) LEFT JOIN w USING (frame, cell)),
x AS (SELECT *, {", ".join(f"coalesce({c}, false) AS {n}" for n, c in EXEMPT.items())} FROM g),
y AS (SELECT *, {chain("").replace("if(d_near < 100, 5, 4)", "CASE WHEN d_near < 100 THEN 5 ELSE 4 END")} AS plain, {chain("P").replace("if(d_near < 100, 5, 4)", "CASE WHEN d_near < 100 THEN 5 ELSE 4 END")} AS as_plate, {chain("W")} AS as_weak, {chain("C")} AS as_compact FROM x),
z AS (SELECT *, CASE WHEN plate_across THEN as_plate ELSE plain END AS reason FROM y)
SELECT {_NAMES} AS verdict, count(*) AS clusters, sum(n)::BIGINT AS points, {", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in _FLAGS.items())} FROM z GROUP BY 1"""))
def judge_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters judged by all thirteen rules, and again with rules masked: plates, weak and compact clusters are flagged.

    A cluster's surroundings are met in cells of distance, so both joins are equi-joins.
    """
    a = points(spark, sf_dir).select("frame", "slot", "d", "l", "h", C.floor_bin(F.col("d"), 2.0).alias("cell"), F.expr(re.sub(r"(?<=[0-9])e0", "D", _BOX)).alias("box"))
    i, o = a.where("box"), a.where("not box")
    m = i.groupBy("frame", "cell").agg(
        F.percentile("d", 0.5).alias("d_near"), (F.max("d") - F.min("d")).alias("ext_d"), (F.max("l") - F.min("l")).alias("ext_l"), (F.max("h") - F.min("h")).alias("ext_h"), F.avg("l").alias("mean_l"),
        F.avg("h").alias("mean_h"), F.avg("d").alias("mean_d"), F.min("h").alias("min_h"), F.max("h").alias("top"), F.max(F.abs("l")).alias("max_l"), F.min("l").alias("low_l"), F.max("l").alias("high_l"),
        F.min("d").alias("d0"), F.max("d").alias("d1"), F.min(1.4 - 0.003 * F.col("d")).alias("min_hw"),
    )
    flat = fit.planarity(i, ["frame", "cell"], ["d", "l", "h"]).select("frame", "cell", "n", (F.col("l1") / F.nullif(F.col("l1") + F.col("l2") + F.col("l3"), F.lit(0.0))).alias("flatness"))
    norm = F.sqrt(F.col("mean_d") * F.col("mean_d") + F.col("mean_l") * F.col("mean_l") + F.col("mean_h") * F.col("mean_h"))
    side = F.sqrt(F.col("ext_l") * F.col("ext_l") + F.col("ext_d") * F.col("ext_d"))
    f = m.join(flat, ["frame", "cell"]).withColumn("facing", F.abs(F.col("mean_d") * F.col("ext_l")) / F.nullif(norm * side, F.lit(0.0)))
    near = o.select("frame", F.explode(F.sequence(F.col("cell") - 2, F.col("cell") + 2)).alias("cell"), F.col("slot").alias("os"), F.col("d").alias("od"), F.col("l").alias("ol"), F.col("h").alias("oh"))
    over = "od between d0 - 0.8D and d1 + 0.8D and ol between low_l - 0.4D and high_l + 0.4D and oh > top + 0.1D and oh <= top + 1.3D"
    s = f.join(near, ["frame", "cell"]).groupBy("frame", "cell").agg(F.count_if(F.expr(over)).alias("above"), F.count(F.lit(1)).alias("outside"))
    within = "(od-d)*(od-d)+(ol-l)*(ol-l)+(oh-h)*(oh-h) <= power(0.35D + 0.008D * d_near, 2)"
    w = i.select("frame", "cell", "d", "l", "h").join(f.select("frame", "cell", "d_near"), ["frame", "cell"]).join(near, ["frame", "cell"]).where(within).groupBy("frame", "cell").agg(F.count_distinct("os").alias("neighbours"))
    g = f.join(s, ["frame", "cell"], "left").join(w, ["frame", "cell"], "left").fillna(0, ["above", "outside", "neighbours"])
    x = g.withColumns({n: F.coalesce(F.expr(c), F.lit(False)) for n, c in EXEMPT.items()})
    y = x.withColumns({n: F.expr(chain(k)) for n, k in (("plain", ""), ("as_plate", "P"), ("as_weak", "W"), ("as_compact", "C"))})
    z = y.withColumn("reason", F.expr("if(plate_across, as_plate, plain)"))
    return z.groupBy(F.expr(_NAMES).alias("verdict")).agg(F.count(F.lit(1)).alias("clusters"), F.sum("n").alias("points"), *[F.count_if(F.expr(c)).alias(n) for n, c in _FLAGS.items()])


@query(f"""WITH {PT}, g AS (SELECT frame, floor(d / 4)::BIGINT AS cell, count(*) AS px, median(d) AS d, avg(l) AS l, max(d) - min(d) AS ext_d, avg(r) / 50e0 AS score FROM pt WHERE h > 1 GROUP BY ALL),
j AS (SELECT *, CASE WHEN d > 170e0 THEN 'beyond range' WHEN abs(l) > 1.4e0 - 0.003e0 * d THEN 'outside corridor' WHEN ext_d > 3.5e0 THEN 'too deep' ELSE 'kept' END AS verdict, CASE WHEN px < 10 THEN score * 0.3e0 ELSE score END AS s FROM g)
SELECT verdict, count(*) AS n, round(sum(s), 4) AS score, count(*) FILTER (px < 10) AS small FROM j GROUP BY verdict""")
def network_post_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Network candidates filtered by range, corridor and depth; the scores of small ones are lowered."""
    g = points(spark, sf_dir).where("h > 1").groupBy("frame", C.floor_bin(F.col("d"), 4.0).alias("cell")).agg(
        F.count(F.lit(1)).alias("px"), F.percentile("d", 0.5).alias("d"), F.avg("l").alias("l"), (F.max("d") - F.min("d")).alias("ext_d"), (F.avg("r") / 50.0).alias("score")
    )
    verdict = F.when(F.col("d") > 170.0, "beyond range").when(F.abs("l") > 1.4 - 0.003 * F.col("d"), "outside corridor").when(F.col("ext_d") > 3.5, "too deep").otherwise("kept")
    small = F.col("px") < 10
    return g.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.when(small, F.col("score") * 0.3).otherwise(F.col("score"))), 4).alias("score"), F.count_if(small).alias("small"))


@query(f"""WITH {FR}, s AS (SELECT *, CASE WHEN k % 5 <> 0 THEN 100e0 + k * 4e0 END AS support FROM fr), p AS (SELECT * FROM s WHERE support IS NOT NULL),
m AS (SELECT bag, i, median(support) OVER (PARTITION BY bag ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS med FROM p),
v AS (SELECT s.*, last_value(med IGNORE NULLS) OVER (PARTITION BY s.bag ORDER BY s.i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS med FROM s LEFT JOIN m USING (bag, i)),
w AS (SELECT *, least(300e0, least(med + 15e0, CASE WHEN k % 7 = 0 THEN 250e0 ELSE 400e0 END)) AS verified FROM v)
SELECT bag, count(*) FILTER (med IS NULL) AS unverified, count(*) FILTER (dist <= verified) AS kept, count(*) FILTER (dist > verified) AS dropped, round(avg(verified), 4) AS mean_verified FROM w GROUP BY bag""")
def verified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified range from the last five supports with a margin, capped by the rail's reach, and candidates split by it; none is deleted."""
    fr = frames(spark, sf_dir).withColumn("support", F.when(F.col("k") % 5 != 0, 100.0 + F.col("k") * 4.0))
    w = Window.partitionBy("bag").orderBy("i")
    m = fr.where("support is not null").select("bag", "i", F.percentile("support", 0.5).over(w.rowsBetween(-4, 0)).alias("m"))
    v = fr.join(m, ["bag", "i"], "left").withColumn("med", F.last("m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    reach = F.when(F.col("k") % 7 == 0, 250.0).otherwise(400.0)
    v = v.withColumn("verified", F.when(F.col("med").isNotNull(), F.least(F.lit(300.0), F.col("med") + 15.0, reach)).otherwise(F.least(F.lit(300.0), reach)))
    return v.groupBy("bag").agg(
        F.count_if(F.col("med").isNull()).alias("unverified"), F.count_if(F.col("dist") <= F.col("verified")).alias("kept"), F.count_if(F.col("dist") > F.col("verified")).alias("dropped"), F.round(F.avg("verified"), 4).alias("mean_verified")
    )


@query(f"""WITH {PT}, o0 AS (SELECT frame, floor(d / 10)::BIGINT AS cell, min(l) AS a, max(l) AS b, min(h) AS bot, max(h) AS top, avg(r) > 20 AS known FROM pt GROUP BY ALL),
o AS (SELECT frame, a + (frame % 5 - 2) AS lo, b + (frame % 5 - 2) AS hi, bot, top, known FROM o0),
g AS (SELECT *, lo <= 1.4e0 AND hi >= -1.4e0 AND bot <= 3.4e0 AND top >= 0.10e0 AS over, CASE WHEN known THEN lo <= 1.4e0 AND hi >= -1.4e0 AND bot <= 3.4e0 AND top >= 0.10e0 END AS in_gauge FROM o)
SELECT frame, count(*) AS objects, count(*) FILTER (over) AS overlapping, count(*) FILTER (in_gauge) AS inside, count(*) FILTER (in_gauge IS NULL) AS unknown FROM g GROUP BY frame""")
def gauge_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects whose extent meets the gauge, three-valued: unknown where the extent is."""
    shift = F.col("frame") % 5 - 2
    o = points(spark, sf_dir).groupBy("frame", C.floor_bin(F.col("d"), 10.0).alias("cell")).agg(
        (F.min("l") + shift).alias("lo"), (F.max("l") + shift).alias("hi"), F.min("h").alias("bot"), F.max("h").alias("top"), (F.avg("r") > 20).alias("known")
    )
    over = C.gauge_overlap(F.col("lo"), F.col("hi"), F.col("bot"), F.col("top"))
    g = o.withColumn("over", over).withColumn("in_gauge", F.when(F.col("known"), over))
    return g.groupBy("frame").agg(F.count(F.lit(1)).alias("objects"), F.count_if("over").alias("overlapping"), F.count_if(F.coalesce("in_gauge", F.lit(False))).alias("inside"), F.count_if(F.col("in_gauge").isNull()).alias("unknown"))


@query(f"""WITH {PT}, s AS (SELECT frame, CASE WHEN h < 0.5e0 THEN 'floor' WHEN h > 2.7e0 THEN 'ceiling' WHEN abs(l) >= 0.8e0 THEN 'wall' ELSE 'other' END AS surface, (d >= 20)::INT + (d >= 50)::INT + (d >= 100)::INT AS bin, r, slot % 40 AS ring FROM pt),
t AS (SELECT surface, bin::BIGINT AS bin, count(*) AS n, round(quantile_cont(r, 0.1), 4) AS p10, round(quantile_cont(r, 0.5), 4) AS p50, round(quantile_cont(r, 0.9), 4) AS p90, round(quantile_cont(r, 0.999), 4) AS p999, round(avg((r < 5)::INT), 6) AS no_return FROM s GROUP BY ALL) SELECT * FROM t""")
def surface_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surfaces classed by height and side, and realism figures of each by range."""
    surface = F.when(F.col("h") < 0.5, "floor").when(F.col("h") > 2.7, "ceiling").when(F.abs("l") >= 0.8, "wall").otherwise("other")
    s = points(spark, sf_dir).select(surface.alias("surface"), C.digitize(F.col("d"), [20.0, 50.0, 100.0]).alias("bin"), "r")
    return s.groupBy("surface", "bin").agg(
        F.count(F.lit(1)).alias("n"), *[F.round(F.percentile("r", p), 4).alias(n) for n, p in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9), ("p999", 0.999))], F.round(F.avg((F.col("r") < 5).cast("int")), 6).alias("no_return")
    )


@query(f"""WITH {FR}, o AS (SELECT bag, i, event_type = 'purchase' AS is_obstacle, CASE WHEN k % 4 <> 0 THEN k % 3 <> 0 END AS visible, k AS n_hits, CASE WHEN k % 6 <> 0 THEN (k % 10) / 10e0 END AS top, CASE WHEN k % 9 <> 0 THEN k % 2 END AS second FROM fr)
SELECT bag, count(*) FILTER (is_obstacle AND coalesce(visible, true) AND n_hits >= 3 AND coalesce(top, 9.9e0) >= 0.3e0) AS positives, count(*) FILTER (coalesce(second, 0) = 0) AS first_returns, count(*) FILTER (second IS NULL) AS single FROM o GROUP BY bag""")
def positive_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which labels count as positives, with defaults of what labels leave out; and first returns, of beams without a flag all."""
    k = F.col("k")
    o = frames(spark, sf_dir).select(
        "bag", (F.col("event_type") == "purchase").alias("is_obstacle"), F.when(k % 4 != 0, k % 3 != 0).alias("visible"), k.alias("n_hits"),
        F.when(k % 6 != 0, (k % 10) / 10.0).alias("top"), F.when(k % 9 != 0, k % 2).alias("second"),
    )
    positive = F.col("is_obstacle") & F.coalesce("visible", F.lit(True)) & (F.col("n_hits") >= 3) & (F.coalesce("top", F.lit(9.9)) >= 0.3)
    return o.groupBy("bag").agg(F.count_if(positive).alias("positives"), F.count_if(F.coalesce("second", F.lit(0)) == 0).alias("first_returns"), F.count_if(F.col("second").isNull()).alias("single"))


@query(f"""WITH {V3}, p AS (SELECT *, 0.15e0 + 0.02e0 * (vec_id % 8) AS eps FROM v3)
SELECT a.vec_id AS a, b.vec_id AS b, round(sqrt((a.e0-b.e0)*(a.e0-b.e0)+(a.e1-b.e1)*(a.e1-b.e1)+(a.e2-b.e2)*(a.e2-b.e2)), 6) AS distance FROM p a JOIN p b ON a.vec_id < b.vec_id
WHERE sqrt((a.e0-b.e0)*(a.e0-b.e0)+(a.e1-b.e1)*(a.e1-b.e1)+(a.e2-b.e2)*(a.e2-b.e2)) <= greatest(a.eps, b.eps)""")
def variable_radius_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs within the larger of two points' own radii: a grid of the largest radius, then each pair's."""
    eps = lambda c: 0.15 + 0.02 * (F.col(c) % 8)
    pairs = radius_pairs(vectors(spark, sf_dir), [], ["e0", "e1", "e2"], "vec_id", 0.15 + 0.02 * 7)
    return pairs.where(F.col("distance") <= F.greatest(eps("a"), eps("b"))).select("a", "b", F.round("distance", 6).alias("distance"))


@query(f"""WITH {FR}, a AS (SELECT bag, i, dist AS d, (k % 5) * 0.3e0 AS l, k % 2 = 0 AS weak FROM fr WHERE event_type = 'click'), b AS (SELECT bag, i, dist AS d, (k % 5) * 0.3e0 AS l FROM fr WHERE event_type IN ('view', 'purchase'))
SELECT bag, count(*) AS candidates, count(*) FILTER (EXISTS (SELECT 1 FROM b WHERE b.bag = a.bag AND abs(b.i - a.i) <= 3 AND abs(b.d - a.d) <= CASE WHEN weak THEN 25e0 ELSE 15e0 END AND abs(b.l - a.l) <= CASE WHEN weak THEN 1.2e0 ELSE 0.5e0 END)) AS supported FROM a GROUP BY bag""")
def detector_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of one detector that another supports nearby, within limits of their kind; both meet by neighbouring frames."""
    fr = frames(spark, sf_dir).select("bag", "i", "event_type", F.col("dist").alias("d"), ((F.col("k") % 5) * 0.3).alias("l"), (F.col("k") % 2 == 0).alias("weak"))
    a = fr.where("event_type = 'click'")
    b = fr.where("event_type in ('view', 'purchase')").select("bag", F.explode(F.sequence(F.col("i") - 3, F.col("i") + 3)).alias("i"), F.col("d").alias("bd"), F.col("l").alias("bl"))
    near = (F.abs(F.col("bd") - F.col("d")) <= F.when(F.col("weak"), 25.0).otherwise(15.0)) & (F.abs(F.col("bl") - F.col("l")) <= F.when(F.col("weak"), 1.2).otherwise(0.5))
    hit = a.join(b, ["bag", "i"]).where(near).select("bag", "i").distinct().withColumn("hit", F.lit(1))
    return a.join(hit, ["bag", "i"], "left").groupBy("bag").agg(F.count(F.lit(1)).alias("candidates"), F.count("hit").alias("supported"))


_EVENTS = [(1, "obstacle", 5, 40, 100.0, 260.0), (2, "uncertain", 30, 45, 0.0, 500.0), (3, "obstacle", 35, 80, 300.0, 340.0)]
_EVENT_ROWS = ", ".join(f"({e}, '{x}', {a}, {b}, {p}e0, {q}e0)" for e, x, a, b, p, q in _EVENTS)


@query(f"""WITH {FR}, v(event, label, f_lo, f_hi, d0, d1) AS (VALUES {_EVENT_ROWS}), c AS (SELECT * FROM fr WHERE status = 'detected' AND NOT EXISTS (SELECT 1 FROM v WHERE label = 'uncertain' AND i BETWEEN f_lo AND f_hi))
SELECT v.event::BIGINT AS event, count(*) AS candidates, count(*) FILTER (dist BETWEEN d0 - 10 AND d1 + 10) AS hits, count(DISTINCT bag) FILTER (dist BETWEEN d0 - 10 AND d1 + 10) AS recordings FROM c JOIN v ON i BETWEEN f_lo AND f_hi WHERE label = 'obstacle' GROUP BY v.event""")
def annotated_obstacle_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates within an annotated obstacle's distances in its frames; uncertain frames are left out.  Three events are broadcast."""
    v = spark.createDataFrame(_EVENTS, "event long, label string, f_lo long, f_hi long, d0 double, d1 double")
    inside = F.col("i").between(F.col("f_lo"), F.col("f_hi"))
    c = frames(spark, sf_dir).where("status = 'detected'").join(F.broadcast(v.where("label = 'uncertain'")), inside, "left_anti")
    j = c.join(F.broadcast(v.where("label = 'obstacle'")), inside)
    hit = F.col("dist").between(F.col("d0") - 10, F.col("d1") + 10)
    return j.groupBy("event").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(hit).alias("hits"), F.count_distinct(F.when(hit, F.col("bag"))).alias("recordings"))


@query(f"""WITH {PT}, s AS (SELECT frame, slot, d, l, h FROM pt), m AS (SELECT frame, max(CASE WHEN axis = 'd' THEN p98 END) AS reach, arg_max(axis, p98) AS along FROM (
  SELECT frame, 'd' AS axis, quantile_cont(abs(d), 0.98) AS p98 FROM s GROUP BY frame UNION ALL SELECT frame, 'l', quantile_cont(abs(l), 0.98) FROM s GROUP BY frame UNION ALL SELECT frame, 'h', quantile_cont(abs(h), 0.98) FROM s GROUP BY frame) GROUP BY frame)
SELECT m.frame, along, round(reach, 4) AS reach, round(max(-l), 4) AS side_max, round(min(h), 4) AS up_min FROM m JOIN s ON s.frame = m.frame GROUP BY ALL""")
def axis_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The axis of longest reach, and coordinates under a signed permutation of axes."""
    s = points(spark, sf_dir)
    d, side, up = C.permuted_axes(F.col("d"), F.col("l"), F.col("h"), ("+x", "-y", "+z"))
    g = s.groupBy("frame").agg(*[F.percentile(F.abs(c), 0.98).alias(f"p{c}") for c in "dlh"], F.max(side).alias("side_max"), F.min(up).alias("up_min"))
    along = F.array_max(F.array(*[F.struct(F.col(f"p{c}").alias("p"), F.lit(c).alias("axis")) for c in "dlh"]))["axis"]
    return g.select("frame", along.alias("along"), F.round("pd", 4).alias("reach"), F.round("side_max", 4).alias("side_max"), F.round("up_min", 4).alias("up_min"))


def sql_rules(rules: list[tuple[str, str]], other: str) -> Column:
    """The first rule's name whose condition holds."""
    return F.coalesce(*[F.when(F.expr(c), F.lit(n)) for n, c in rules], F.lit(other))


#: Classes of beam groups, first match wins: class, condition, factor of the score.
BEAM = [
    ("dust", "(n >= 3 and see_through >= 0.5D) or roughness >= 2.5D", 1.0),
    ("obstacle", "ext_l >= 1.5D and ext_d <= 1D and n >= 12 and ext_h >= 1.5D and min_h <= 1.5D and abs(mean_l) <= 0.9D", 1.0),
    ("structure", "ext_h < 0.12D and greatest(ext_d, ext_l) >= 0.4D and mean_h >= 1.5D and n_rows >= 2", 0.1),
    ("structure", "ext_d >= 3D and ext_l <= 1D and ext_d >= 3D * greatest(ext_l, 0.05D) and abs(mean_l) >= hw - 0.6D", 0.1),
    ("structure", "n_bg = 0 and n_known >= 6", 0.1),
    ("structure", "extends_above >= 0.5D", 0.1),
    ("structure", "ext_l <= 0.35D and ext_d >= 1.5D and abs(mean_l) >= hw - 0.5D", 0.1),
    ("structure", "ext_l <= 0.2D and ext_h >= 2D * greatest(ext_l, 0.05D) and abs(mean_l) >= hw - 0.45D and n >= 3", 0.1),
    ("hanging", "d_near >= 50 and min_h >= 1.5D", 0.25),
]
_BEAM_CLASS = "CASE " + " ".join(f"WHEN {c} THEN '{x}'" for x, c, _ in BEAM) + " ELSE 'obstacle' END"
_BEAM_FACTOR = "CASE " + " ".join(f"WHEN {c} THEN {f}D" for _, c, f in BEAM) + " ELSE 1D END"
_BEAM_DROP = "d_near > 190D or ext_d > 6D or (d_near >= 60 and ext_d > 2.5D)"


@query(in_sql(f"""WITH {PT}, px AS (SELECT frame, floor(d / 2)::BIGINT AS row, floor(l / 0.25e0)::BIGINT AS col, min(r) AS r, max(r) AS r_far, avg(h) AS h, avg(d) AS d, avg(l) AS l, max(h) AS top FROM pt GROUP BY ALL),
g AS (SELECT *, floor(row / 2)::BIGINT AS grp FROM px WHERE r BETWEEN 20 AND 30), a AS (SELECT frame, grp, count(*) AS n, count(DISTINCT row) AS n_rows, median(d) AS d_near, median(r) AS r_med, max(d) - min(d) AS ext_d, max(l) - min(l) AS ext_l, max(h) - min(h) AS ext_h,
  avg(l) AS mean_l, avg(h) AS mean_h, min(h) AS min_h, avg((r_far > r + greatest(1e0, 0.03e0 * r))::INT) AS see_through, 1.4e0 - 0.003e0 * median(d) AS hw FROM g GROUP BY ALL),
k AS (SELECT g.frame, g.grp, g.row, g.col, g.r, median(o.r) AS med FROM g JOIN px o ON o.frame = g.frame AND abs(o.row - g.row) <= 1 AND abs(o.col - g.col) <= 1 GROUP BY ALL), rg AS (SELECT k.frame, k.grp, median(abs(r - med) / (0.3e0 + 0.3e0 * r)) AS rough FROM k GROUP BY ALL),
x AS (SELECT DISTINCT g.frame, g.grp, o.row, o.col, o.r, o.h FROM g JOIN px o ON o.frame = g.frame AND abs(o.row - g.row) <= 1 AND abs(o.col - g.col) <= 1 LEFT JOIN g s ON s.frame = o.frame AND s.row = o.row AND s.col = o.col AND s.grp = g.grp WHERE s.frame IS NULL),
y AS (SELECT x.frame, x.grp, count(*) AS n_ring, count(*) FILTER (abs(x.r - r_med) <= 0.5e0 + 0.1e0 * r_med AND x.h > 2.2e0) AS n_attached, count(*) FILTER (x.r > r_med + greatest(3e0, 0.05e0 * r_med)) AS n_bg, count(*) FILTER (abs(x.r - r_med) <= 0.5e0 + 0.1e0 * r_med AND x.h <= 2.2e0) AS n_same
  FROM x JOIN a USING (frame, grp) GROUP BY ALL),
u AS (SELECT g.frame, g.grp, g.col, min(g.row) AS first_row FROM g GROUP BY ALL),
v AS (SELECT u.frame, u.grp, u.col, arg_min(o.r, u.first_row - o.row) AS up_r, arg_min(o.top, u.first_row - o.row) AS up_top FROM u LEFT JOIN px o ON o.frame = u.frame AND o.col = u.col AND o.row < u.first_row AND o.row >= u.first_row - 4 GROUP BY ALL),
w AS (SELECT v.frame, v.grp, avg(coalesce(abs(up_r - r_med) <= 0.5e0 + 0.1e0 * r_med AND up_top > 2.6e0, false)::INT) AS extends_above FROM v JOIN a USING (frame, grp) GROUP BY ALL),
f AS (SELECT a.*, CASE WHEN a.n >= 6 THEN rough ELSE 0e0 END AS roughness, coalesce(n_ring, 0) AS n_ring, coalesce(n_attached, 0) AS n_attached, coalesce(n_bg, 0) AS n_bg, coalesce(n_attached, 0) + coalesce(n_bg, 0) + coalesce(n_same, 0) AS n_known, extends_above FROM a LEFT JOIN rg USING (frame, grp) LEFT JOIN y USING (frame, grp) LEFT JOIN w USING (frame, grp)),
q AS (SELECT *, n_attached / greatest(n_known, 1)::DOUBLE AS attached_frac, greatest(1e0, 0.5e0 / (0.002e0 * d_near) * 0.5e0 / (0.02e0 * d_near)) AS n_exp FROM f),
z AS (SELECT *, least(1e0, n / n_exp) * (1 - attached_frac) AS score, CASE WHEN {_BEAM_DROP} THEN 'dropped' WHEN attached_frac > 0.35e0 THEN 'attached' ELSE {_BEAM_CLASS} END AS cls, {_BEAM_FACTOR} AS factor FROM q)
SELECT cls, count(*) AS groups, sum(n)::BIGINT AS pixels, round(sum(score * factor), 4) AS score, sum(n_ring)::BIGINT AS ring, round(avg(extends_above), 6) AS above FROM z GROUP BY cls"""))
def beam_group_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel groups with their ring, roughness and what stands above, scored by support and classed by nine rules."""
    px = points(spark, sf_dir).groupBy("frame", C.floor_bin(F.col("d"), 2.0).alias("row"), C.floor_bin(F.col("l"), 0.25).alias("col")).agg(
        F.min("r").alias("r"), F.max("r").alias("r_far"), C.exact_avg(F.col("h")).alias("h"), C.exact_avg(F.col("d")).alias("d"), C.exact_avg(F.col("l")).alias("l"), F.max("h").alias("top")
    )
    g = px.where("r between 20 and 30").withColumn("grp", F.floor(F.col("row") / 2).cast("long"))
    through = (F.col("r_far") > F.col("r") + F.greatest(F.lit(1.0), 0.03 * F.col("r"))).cast("int")
    a = g.groupBy("frame", "grp").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("row").alias("n_rows"), F.percentile("d", 0.5).alias("d_near"), F.percentile("r", 0.5).alias("r_med"), (F.max("d") - F.min("d")).alias("ext_d"), (F.max("l") - F.min("l")).alias("ext_l"),
        (F.max("h") - F.min("h")).alias("ext_h"), C.exact_avg(F.col("l")).alias("mean_l"), C.exact_avg(F.col("h")).alias("mean_h"), F.min("h").alias("min_h"), F.avg(through).alias("see_through"), (1.4 - 0.003 * F.percentile("d", 0.5)).alias("hw"),
    )
    step = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1)])).alias("s")
    around = g.select("frame", "grp", F.col("row").alias("row0"), F.col("col").alias("col0"), F.col("r").alias("r0"), step).select("frame", "grp", "row0", "col0", "r0", (F.col("row0") + F.col("s.x")).alias("row"), (F.col("col0") + F.col("s.y")).alias("col"))
    met = around.join(px.select("frame", "row", "col", "r", "h"), ["frame", "row", "col"])
    k = met.groupBy("frame", "grp", "row0", "col0", "r0").agg(F.percentile("r", 0.5).alias("med"))
    rough = k.groupBy("frame", "grp").agg(F.percentile(F.abs(F.col("r0") - F.col("med")) / (0.3 + 0.3 * F.col("r0")), 0.5).alias("rough"))
    ring = met.select("frame", "grp", "row", "col", "r", "h").distinct().join(g.select("frame", "grp", "row", "col"), ["frame", "grp", "row", "col"], "left_anti")
    same = F.abs(F.col("r") - F.col("r_med")) <= 0.5 + 0.1 * F.col("r_med")
    y = ring.join(a.select("frame", "grp", "r_med"), ["frame", "grp"]).groupBy("frame", "grp").agg(
        F.count(F.lit(1)).alias("n_ring"), F.count_if(same & (F.col("h") > 2.2)).alias("n_attached"), F.count_if(F.col("r") > F.col("r_med") + F.greatest(F.lit(3.0), 0.05 * F.col("r_med"))).alias("n_bg"), F.count_if(same & (F.col("h") <= 2.2)).alias("n_same")
    )
    u = g.groupBy("frame", "grp", "col").agg(F.min("row").alias("first_row"))
    steps = u.withColumn("up", F.explode(F.array(*[F.lit(x).cast("long") for x in range(1, 5)]))).withColumn("row", F.col("first_row") - F.col("up"))
    hit = steps.join(px.select("frame", "row", "col", F.col("r").alias("ur"), F.col("top").alias("ut")), ["frame", "row", "col"]).groupBy("frame", "grp", "col").agg(F.min_by(F.struct("ur", "ut"), "up").alias("b"))
    v = u.join(hit, ["frame", "grp", "col"], "left").join(a.select("frame", "grp", "r_med"), ["frame", "grp"])
    reaches = F.coalesce((F.abs(F.col("b.ur") - F.col("r_med")) <= 0.5 + 0.1 * F.col("r_med")) & (F.col("b.ut") > 2.6), F.lit(False))
    w = v.groupBy("frame", "grp").agg(F.avg(reaches.cast("int")).alias("extends_above"))
    f = a.join(rough, ["frame", "grp"], "left").join(y, ["frame", "grp"], "left").join(w, ["frame", "grp"], "left").fillna(0, ["n_ring", "n_attached", "n_bg", "n_same"])
    f = f.withColumn("roughness", F.when(F.col("n") >= 6, F.col("rough")).otherwise(0.0)).withColumn("n_known", F.col("n_attached") + F.col("n_bg") + F.col("n_same"))
    f = f.withColumn("attached_frac", F.col("n_attached") / F.greatest(F.col("n_known"), F.lit(1))).withColumn("n_exp", F.greatest(F.lit(1.0), 0.5 / (0.002 * F.col("d_near")) * 0.5 / (0.02 * F.col("d_near"))))
    z = f.withColumn("score", F.least(F.lit(1.0), F.col("n") / F.col("n_exp")) * (1 - F.col("attached_frac")))
    cls = F.when(F.expr(_BEAM_DROP), "dropped").when(F.col("attached_frac") > 0.35, "attached").otherwise(F.expr(_BEAM_CLASS))
    return z.groupBy(cls.alias("cls")).agg(
        F.count(F.lit(1)).alias("groups"), F.sum("n").alias("pixels"), F.round(F.sum(F.col("score") * F.expr(_BEAM_FACTOR)), 4).alias("score"), F.sum("n_ring").alias("ring"), F.round(F.avg("extends_above"), 6).alias("above")
    )
