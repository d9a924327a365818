"""Queries of track geometry: rail profile, troughs, wall intervals, gated chains, joint fits, sweep limits, motion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import islands as isl
from ..operators import profiles as pr
from ..operators.quantiles import rank_quantiles
from . import scene_queries
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


def fit_sql(source: str, name: str, keep: str = "keep", cm: str = "0e0", key: str = "frame") -> str:
    """CTE ``name`` of ``source`` with the weighted quadratic of the kept rows as ``{name}a, b, c, n``."""
    w = f"CASE WHEN {keep} THEN w ELSE 0e0 END"
    p = ["1e0", "x", "x*x", "x*x*x", "x*x*x*x"]
    sums = ", ".join([f"sum({w}*{p[k]}) OVER o AS s{k}" for k in range(5)] + [f"sum({w}*y*{p[k]}) OVER o AS t{k}" for k in range(3)])
    return f"""{name}1 AS (SELECT *, count(*) FILTER ({keep}) OVER o AS {name}n, {sums} FROM {source} WINDOW o AS (PARTITION BY {key})),
{name}2 AS (SELECT *, CASE WHEN {cm} = 0 THEN 0e0 ELSE greatest(-({cm}), least({cm}, coalesce((s0*(s2*t2-t1*s3) - s1*(s1*t2-t1*s2) + t0*(s1*s3-s2*s2)) / nullif(s0*(s2*s4-s3*s3) - s1*(s1*s4-s3*s2) + s2*(s1*s3-s2*s2), 0), 0e0))) END AS {name}c FROM {name}1),
{name} AS (SELECT * EXCLUDE (s0, s1, s2, s3, s4, t0, t1, t2), ((t0-{name}c*s2)*s2 - (t1-{name}c*s3)*s1) / nullif(s0*s2-s1*s1, 0) AS {name}a, ((t1-{name}c*s3)*s0 - (t0-{name}c*s2)*s1) / nullif(s0*s2-s1*s1, 0) AS {name}b FROM {name}2)"""


_RAIL = """r0 AS (SELECT frame, floor(d / 4)::BIGINT AS bin, h, row_number() OVER (PARTITION BY frame, floor(d / 4) ORDER BY h) - 1 AS i, count(*) OVER (PARTITION BY frame, floor(d / 4)) AS n FROM pt WHERE abs(l) <= 0.9e0),
bins AS (SELECT frame, bin, bin * 4e0 + 2e0 AS x, 0.1e0 * (bin % 3) + max(h) FILTER (i = floor((n - 1) * 0.3e0)) AS y, least(max(n), 500)::DOUBLE AS w, max(n) >= 8 AS dense FROM r0 GROUP BY frame, bin HAVING max(n) >= CASE WHEN bin * 4 + 2 <= 45 THEN 6 ELSE 4 END)"""


def _rail_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).where("abs(l) <= 0.9D").select("frame", C.floor_bin(F.col("d"), 4.0).alias("bin"), "h")
    q = rank_quantiles(p, ["frame", "bin"], "h", {"q": (0.3, "floor")}).withColumn("x", F.col("bin") * 4.0 + 2.0)
    q = q.where(F.col("n") >= F.when(F.col("x") <= 45, 6).otherwise(4))
    return q.select("frame", "bin", "x", (0.1 * (F.col("bin") % 3) + F.col("q")).alias("y"), F.least(F.col("n"), F.lit(500)).cast("double").alias("w"), (F.col("n") >= 8).alias("dense"))


def _rail_sql() -> str:
    res, passes = 0.43, ""
    prev = "p0"
    for k, limit in enumerate((2 * res, res, res), 1):
        passes += f"""{fit_sql(prev, f"q{k}", cm="cm")},
p{k}a AS (SELECT * REPLACE (going AND q{k}n >= 4 AS going) FROM q{k}), p{k}b AS (SELECT * REPLACE (CASE WHEN going THEN q{k}a ELSE ka END AS ka, CASE WHEN going THEN q{k}b ELSE kb END AS kb, CASE WHEN going THEN q{k}c ELSE kc END AS kc),
  coalesce(near AND abs(y - (q{k}a + q{k}b * x + q{k}c * x * x)) <= {limit}e0, false) AS new FROM p{k}a),
p{k}c AS (SELECT * REPLACE (going AND count(*) FILTER (new) OVER (PARTITION BY frame) >= 4 AS going) FROM p{k}b), p{k} AS (SELECT * EXCLUDE (new, q{k}a, q{k}b, q{k}c, q{k}n) REPLACE (CASE WHEN going THEN new ELSE keep END AS keep) FROM p{k}c), """
        prev = f"p{k}"
    gate = "(0.5e0 + 0.005e0 * greatest(0e0, x - lim))"
    return f"""WITH RECURSIVE {PT}, {_RAIL}, nb AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY x) AS k FROM bins),
run AS (SELECT frame, 0::BIGINT AS k, NULL::DOUBLE AS lim, 0e0 AS yl, 0e0 AS xp, false AS ended FROM (SELECT DISTINCT frame FROM nb)
  UNION ALL SELECT b.frame, b.k, CASE WHEN ended THEN lim WHEN lim IS NULL THEN CASE WHEN dense THEN x END WHEN NOT dense OR x - xp > 8e0 THEN lim WHEN y - yl > 0.8e0 THEN lim ELSE x END,
    CASE WHEN ended THEN yl WHEN lim IS NULL THEN y WHEN NOT dense OR x - xp > 8e0 OR y - yl > 0.8e0 THEN yl ELSE y END, CASE WHEN ended THEN xp WHEN lim IS NULL THEN x WHEN NOT dense OR x - xp > 8e0 THEN xp ELSE x END,
    ended OR (lim IS NOT NULL AND (NOT dense OR x - xp > 8e0)) FROM run JOIN nb b ON b.frame = run.frame AND b.k = run.k + 1),
lm AS (SELECT frame, least(45e0, coalesce(arg_max(lim, k), 45e0)) AS lim FROM run GROUP BY frame),
a0 AS (SELECT nb.* EXCLUDE (k), lim, x <= lim AS near, CASE WHEN lim >= 30e0 AND max(x) OVER (PARTITION BY nb.frame) >= 60e0 THEN 5e-4 ELSE 0e0 END AS cm FROM nb JOIN lm ON lm.frame = nb.frame),
a1 AS (SELECT *, coalesce(median(y) FILTER (near) OVER (PARTITION BY frame), median(y) OVER (PARTITION BY frame)) AS middle FROM a0),
p0 AS (SELECT *, near AND abs(y - middle) <= {4 * res}e0 AS keep, true AS going, NULL::DOUBLE AS ka, NULL::DOUBLE AS kb, NULL::DOUBLE AS kc FROM a1), {passes}
f0 AS (SELECT *, ka IS NOT NULL AND count(*) FILTER (keep) OVER o >= 4 AS ok, max(x) FILTER (keep) OVER o AS last_x, coalesce(NOT near AND abs(y - (ka + kb * x + kc * x * x)) <= {gate}, false) AS may FROM p3 WINDOW o AS (PARTITION BY frame)),
fn AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY x) AS k FROM f0),
ch AS (SELECT frame, 0::BIGINT AS k, NULL::DOUBLE AS pos, false AS far FROM (SELECT DISTINCT frame FROM fn) UNION ALL
  SELECT b.frame, b.k, CASE WHEN may AND x - coalesce(pos, last_x) <= 20e0 THEN x ELSE pos END, coalesce(may AND x - coalesce(pos, last_x) <= 20e0, false) FROM ch JOIN fn b ON b.frame = ch.frame AND b.k = ch.k + 1),
g0 AS (SELECT fn.*, far, keep OR far AS two FROM fn JOIN ch USING (frame, k)), {fit_sql("g0", "g", "two", "cm")},
h0 AS (SELECT * REPLACE (coalesce(two AND abs(y - (ga + gb * x + gc * x * x)) <= CASE WHEN near THEN {res}e0 ELSE {gate} END, false) AS two), bool_or(far) OVER (PARTITION BY frame) AS any_far FROM g), {fit_sql("h0", "h", "two", "cm")},
z AS (SELECT frame, x, y, ok, CASE WHEN any_far AND hn >= 4 THEN two ELSE keep END AS keep, CASE WHEN any_far AND hn >= 4 THEN ha ELSE ka END AS a, CASE WHEN any_far AND hn >= 4 THEN hb ELSE kb END AS b, CASE WHEN any_far AND hn >= 4 THEN hc ELSE kc END AS c FROM h)
SELECT frame, bool_and(ok) AS ok, round(max(a) FILTER (ok), 4) AS a, round(max(b) FILTER (ok), 6) AS b, round(max(c) FILTER (ok), 8) AS c, count(*) FILTER (keep) AS used,
  round(CASE WHEN bool_and(ok) THEN sqrt(avg(power(y - (a + b * x + c * x * x), 2)) FILTER (keep)) END, 5) AS rms, max(x) FILTER (ok AND keep) AS reach FROM z GROUP BY frame"""


@query(_rail_sql())
def rail_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rail's height along the track: dense run, trimming passes, far bins by gate and continuity, refits."""
    got = pr.rail_fit(_rail_bins(spark, sf_dir), ["frame"], residual=0.43, far_gate=0.5)
    return got.select("frame", "ok", F.round("a", 4).alias("a"), F.round("b", 6).alias("b"), F.round("c", 8).alias("c"), "used", F.round("rms", 5).alias("rms"), "reach")


@query(f"""WITH {PT}, t AS (SELECT frame, l, floor(l / 0.1e0)::BIGINT AS bin FROM pt WHERE h < 2), n AS (SELECT frame, count(*) AS n FROM t GROUP BY frame HAVING count(*) >= 150), c AS (SELECT frame, bin, count(*) AS c FROM t GROUP BY ALL),
w AS (SELECT frame, bin, sum(c) OVER (PARTITION BY frame ORDER BY bin RANGE BETWEEN CURRENT ROW AND 7 FOLLOWING) AS s FROM c), b AS (SELECT frame, max(s) AS s, min(bin) FILTER (s = m) AS bin FROM (SELECT *, max(s) OVER (PARTITION BY frame) AS m FROM w) GROUP BY frame)
SELECT b.frame, b.s::BIGINT AS inside, s >= 0.4e0 * n AS ok, round(CASE WHEN s >= 0.4e0 * n THEN (SELECT median(l) FROM t WHERE t.frame = b.frame AND t.bin BETWEEN b.bin AND b.bin + 7) END, 4) AS centre FROM b JOIN n USING (frame)""")
def trough_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median inside the densest window of the track bed, where the window holds enough of it."""
    t = points(spark, sf_dir).where("h < 2").select("frame", "l", C.floor_bin(F.col("l"), 0.1).alias("bin"))
    n = t.groupBy("frame").agg(F.count(F.lit(1)).alias("n")).where("n >= 150")
    c = t.groupBy("frame", "bin").agg(F.count(F.lit(1)).alias("c"))
    w = c.withColumn("s", F.sum("c").over(Window.partitionBy("frame").orderBy("bin").rangeBetween(0, 7)))
    b = w.groupBy("frame").agg(F.max(F.struct("s", (-F.col("bin")).alias("m"))).alias("b")).select("frame", F.col("b.s").alias("inside"), (-F.col("b.m")).alias("lo"))
    m = t.join(b, "frame").where("bin between lo and lo + 7").groupBy("frame").agg(F.percentile("l", 0.5).alias("centre"))
    g = b.join(n, "frame").join(m, "frame").withColumn("ok", F.col("inside") >= 0.4 * F.col("n"))
    return g.select("frame", "inside", "ok", F.round(F.when(F.col("ok"), F.col("centre")), 4).alias("centre"))


@query(f"""WITH {PT}, a AS (SELECT frame, floor(d / 30)::BIGINT AS bin, floor(l / 0.2e0 + 0.5e0)::BIGINT AS cell, l FROM pt WHERE h BETWEEN 0.8e0 AND 2.4e0 AND r > 25), n AS (SELECT frame, bin, count(*) AS n FROM a GROUP BY ALL HAVING count(*) >= 12),
g AS (SELECT frame, bin, n, unnest(range(-5, 6)) AS cell FROM n), c AS (SELECT g.frame, g.bin, g.n, g.cell, count(a.l) AS c FROM g LEFT JOIN a ON a.frame = g.frame AND a.bin = g.bin AND a.cell = g.cell GROUP BY ALL),
s AS (SELECT *, sum(c) OVER (PARTITION BY frame, bin ORDER BY cell ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS sm FROM c), o AS (SELECT *, sm / greatest(2e0, 0.25e0 * n) AS level FROM s WHERE sm >= greatest(2e0, 0.25e0 * n)),
p AS (SELECT *, lead(cell) OVER w AS nxt, lead(level) OVER w AS nlevel FROM o WINDOW w AS (PARTITION BY frame, bin ORDER BY cell)),
wall AS (SELECT frame, bin, 'wall' AS kind, 0.5e0 * (cell + nxt) * 0.2e0 AS centre, least(1e0, n / 100e0) * least(2e0, least(level, nlevel)) AS weight FROM p WHERE nxt - cell > 1 AND (nxt - cell) * 0.2e0 BETWEEN 0.3e0 AND 1.9e0),
q AS (SELECT frame, floor(d / 30)::BIGINT AS bin, quantile_cont(l, 0.05) AS a, quantile_cont(l, 0.95) AS b, count(*) AS n FROM pt WHERE h > 2.4e0 GROUP BY ALL HAVING count(*) >= 8)
SELECT frame, bin, kind, round(centre, 4) + 0e0 AS centre, round(weight, 4) AS weight FROM wall UNION ALL SELECT frame, bin, 'ceiling', round(0.5e0 * (a + b), 4) + 0e0, round(0.5e0 * least(1e0, n / 60e0), 4) FROM q WHERE b - a BETWEEN 0.3e0 AND 1.95e0""")
def wall_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate centres a bin: free intervals between occupied cells of wall height, and the ceiling's middle."""
    p = points(spark, sf_dir)
    a = p.where("h between 0.8D and 2.4D and r > 25").select("frame", C.floor_bin(F.col("d"), 30.0).alias("bin"), F.floor(F.col("l") / 0.2 + 0.5).cast("long").alias("cell"))
    n = a.groupBy("frame", "bin").agg(F.count(F.lit(1)).alias("n")).where("n >= 12")
    g = n.withColumn("cell", F.explode(F.sequence(F.lit(-5).cast("long"), F.lit(5).cast("long"))))
    c = g.join(a.groupBy("frame", "bin", "cell").agg(F.count(F.lit(1)).alias("c")), ["frame", "bin", "cell"], "left").fillna(0, ["c"])
    w = Window.partitionBy("frame", "bin").orderBy("cell")
    least = F.greatest(F.lit(2.0), 0.25 * F.col("n"))
    o = c.withColumn("sm", F.sum("c").over(w.rowsBetween(-1, 1))).where(F.col("sm") >= least).withColumn("level", F.col("sm") / least)
    q = o.withColumn("nxt", F.lead("cell").over(w)).withColumn("nlevel", F.lead("level").over(w)).where("nxt - cell > 1")
    wall = q.where(((F.col("nxt") - F.col("cell")) * 0.2).between(0.3, 1.9)).select(
        "frame", "bin", F.lit("wall").alias("kind"), (F.round(0.5 * (F.col("cell") + F.col("nxt")) * 0.2, 4) + 0.0).alias("centre"),
        F.round(F.least(F.lit(1.0), F.col("n") / 100.0) * F.least(F.lit(2.0), "level", "nlevel"), 4).alias("weight"),
    )
    top = p.where("h > 2.4D").groupBy("frame", C.floor_bin(F.col("d"), 30.0).alias("bin")).agg(F.percentile("l", 0.05).alias("a"), F.percentile("l", 0.95).alias("b"), F.count(F.lit(1)).alias("n")).where("n >= 8")
    top = top.where((F.col("b") - F.col("a")).between(0.3, 1.95))
    return wall.unionByName(top.select("frame", "bin", F.lit("ceiling").alias("kind"), (F.round(0.5 * (F.col("a") + F.col("b")), 4) + 0.0).alias("centre"), F.round(0.5 * F.least(F.lit(1.0), F.col("n") / 60.0), 4).alias("weight")))


@query(f"""WITH {PT}, b AS (SELECT frame, floor(d / 20)::BIGINT AS bin, floor(l / 0.2e0 + 0.5e0)::BIGINT AS cell, avg(r) AS y FROM pt GROUP BY ALL), s AS (SELECT unnest(range(-3, 4)) AS shift),
x AS (SELECT a.frame, a.bin, shift, corr(a.y, c.y) AS score, count(*) AS n FROM b a CROSS JOIN s JOIN b c ON c.frame = a.frame AND c.bin = a.bin + 1 AND c.cell = a.cell + shift GROUP BY ALL HAVING count(*) >= 5),
r AS (SELECT *, row_number() OVER (PARTITION BY frame, bin ORDER BY round(score, 9) DESC, abs(shift), shift) AS rn FROM x WHERE score IS NOT NULL), t AS (SELECT frame, bin, CASE WHEN score >= 0.35e0 THEN shift END AS own, score FROM r WHERE rn = 1),
f AS (SELECT *, coalesce(own, last_value(own IGNORE NULLS) OVER (PARTITION BY frame ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM t)
SELECT frame, bin, used::BIGINT AS shift, own IS NULL AS predicted, round(sum(used * 0.2e0) OVER (PARTITION BY frame ORDER BY bin), 4) + 0e0 AS position FROM f""")
def chain_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lateral shifts between neighbouring bins' profiles by cross-correlation, a weak one replaced by the last strong one, summed along the track."""
    b = points(spark, sf_dir).groupBy("frame", C.floor_bin(F.col("d"), 20.0).alias("bin"), F.floor(F.col("l") / 0.2 + 0.5).cast("long").alias("cell")).agg(F.avg("r").alias("y"))
    a = b.withColumn("shift", F.explode(F.sequence(F.lit(-3).cast("long"), F.lit(3).cast("long"))))
    nxt = b.select("frame", (F.col("bin") - 1).alias("bin"), F.col("cell").alias("at"), F.col("y").alias("z"))
    x = a.withColumn("at", F.col("cell") + F.col("shift")).join(nxt, ["frame", "bin", "at"]).groupBy("frame", "bin", "shift").agg(F.corr("y", "z").alias("score"), F.count(F.lit(1)).alias("n")).where("n >= 5 and score is not null and not isnan(score)")
    best = x.groupBy("frame", "bin").agg(F.max(F.struct(F.round("score", 9).alias("s"), (-F.abs("shift")).alias("m"), (-F.col("shift")).alias("k"), "score", "shift")).alias("b"))
    t = best.select("frame", "bin", F.when(F.col("b.score") >= 0.35, F.col("b.shift")).alias("own"))
    w = Window.partitionBy("frame").orderBy("bin")
    before = F.last("own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    f = t.withColumn("shift", F.coalesce("own", before, F.lit(0).cast("long")))
    return f.select("frame", "bin", "shift", F.col("own").isNull().alias("predicted"), (F.round(F.sum(F.col("shift") * 0.2).over(w.rowsBetween(Window.unboundedPreceding, 0)), 4) + 0.0).alias("position"))


_JOINT = """ob AS (SELECT frame, floor(d / 15) * 15e0 + 7.5e0 AS x, l, h FROM pt), ow AS (SELECT frame, x, avg(l) AS m, count(*) AS c FROM ob WHERE h BETWEEN 0.8e0 AND 2e0 GROUP BY ALL HAVING count(*) >= 3),
ot AS (SELECT frame, x, median(l) AS m, count(*) AS c FROM ob WHERE h < 0.8e0 GROUP BY ALL HAVING count(*) >= 3),
o AS (SELECT frame, 'wall' AS kind, x, m + 0.01e0 * (frame % 7) AS y, c::DOUBLE AS w FROM ow UNION ALL SELECT frame, 'trough', x, m, 2e0 * c FROM ot UNION ALL SELECT frame, 'prior', 0e0, 0e0, 40e0 FROM (SELECT DISTINCT frame FROM pt))"""


def _joint_sql() -> str:
    parts, prev = "", "j0"
    for k in range(1, 5):
        parts += f"""{fit_sql(prev, f"m{k}", cm="2e-5")}, e{k} AS (SELECT *, abs(y - (m{k}a + m{k}b * x + m{k}c * x * x)) AS miss FROM m{k}),
i{k} AS (SELECT *, sqrt(avg(miss * miss) FILTER (keep) OVER (PARTITION BY frame)) AS sd FROM e{k}), j{k} AS (SELECT * EXCLUDE (miss, sd, m{k}a, m{k}b, m{k}c, m{k}n) REPLACE (coalesce(miss <= greatest(0.12e0, 1.5e0 * sd), false) AS keep) FROM i{k}), """
        prev = f"j{k}"
    return f"""WITH {PT}, {_JOINT}, j0 AS (SELECT *, abs(y) <= CASE kind WHEN 'trough' THEN 0.9e0 ELSE 0.6e0 END AS keep FROM o), {parts} {fit_sql("j4", "f", cm="2e-5")}
SELECT frame, count(*) FILTER (keep) AS used, count(*) FILTER (keep AND kind = 'wall') AS walls, count(*) FILTER (keep AND kind = 'trough') AS troughs, round(greatest(-0.5e0, least(0.5e0, max(fa))), 5) AS l0,
  round(greatest(-0.045e0, least(0.045e0, max(fb))), 7) AS a, round(max(fc), 9) AS b, max(x) FILTER (keep) AS reach FROM f GROUP BY frame"""


@query(_joint_sql())
def joint_centre_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One centre line of walls, trough and prior together: gates by kind, four trims by the spread that is left, clipped parameters."""
    x = lambda: (C.floor_bin(F.col("d"), 15.0) * 15.0 + 7.5).alias("x")
    p = points(spark, sf_dir)
    wall = p.where("h between 0.8D and 2D").groupBy("frame", x()).agg((F.avg("l") + 0.01 * (F.col("frame") % 7)).alias("y"), F.count(F.lit(1)).cast("double").alias("w")).where("w >= 3").withColumn("kind", F.lit("wall"))
    trough = p.where("h < 0.8D").groupBy("frame", x()).agg(F.percentile("l", 0.5).alias("y"), (2.0 * F.count(F.lit(1))).alias("w")).where("w >= 6").withColumn("kind", F.lit("trough"))
    prior = p.select("frame").distinct().select("frame", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(40.0).alias("w"), F.lit("prior").alias("kind"))
    d = wall.unionByName(trough).unionByName(prior).withColumn("keep", F.abs("y") <= F.when(F.col("kind") == "trough", 0.9).otherwise(0.6))
    over = Window.partitionBy("frame")
    for _ in range(4):
        d = pr.fit_kept(d, ["frame"], F.lit(2e-5)).withColumn("miss", F.abs(F.col("y") - pr.poly()))
        sd = F.sqrt(F.avg(F.when(F.col("keep"), F.col("miss") * F.col("miss"))).over(over))
        d = d.withColumn("sd", sd).withColumn("keep", F.coalesce(F.col("miss") <= F.greatest(F.lit(0.12), 1.5 * F.col("sd")), F.lit(False)))
    d = pr.fit_kept(d, ["frame"], F.lit(2e-5))
    clip = lambda c, m: F.greatest(F.lit(-m), F.least(F.lit(m), F.max(c)))
    return d.groupBy("frame").agg(
        F.count_if("keep").alias("used"), F.count_if(F.col("keep") & (F.col("kind") == "wall")).alias("walls"), F.count_if(F.col("keep") & (F.col("kind") == "trough")).alias("troughs"),
        F.round(clip("fa", 0.5), 5).alias("l0"), F.round(clip("fb", 0.045), 7).alias("a"), F.round(F.max("fc"), 9).alias("b"), F.max(F.when(F.col("keep"), F.col("x"))).alias("reach"),
    )


@query(f"""WITH {FR}, f AS (SELECT bag, i, CASE WHEN k % 4 <> 0 THEN dist / 1000 END AS l0, CASE WHEN k % 4 <> 0 THEN k * 1e-4 END AS b, k FROM fr),
c AS (SELECT bag, i, l0 IS NOT NULL AS own, last_value(l0 IGNORE NULLS) OVER w AS l0, last_value(b IGNORE NULLS) OVER w AS b, max(CASE WHEN l0 IS NOT NULL THEN i END) OVER w AS pos FROM f WINDOW w AS (PARTITION BY bag ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT bag, i, own, round(coalesce(l0, 0e0), 6) AS l0, round(CASE WHEN own THEN b WHEN i - pos <= 3 THEN b * (1 - 0.25e0 * (i - pos)) ELSE 0e0 END, 8) AS b, coalesce(i - pos, -1) AS age FROM c""")
def carried_centre_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame without a fit takes the last one's offset, and its bend for a few frames, fading."""
    good = F.col("k") % 4 != 0
    f = frames(spark, sf_dir).select("bag", "i", F.when(good, F.col("dist") / 1000).alias("l0"), F.when(good, F.col("k") * 1e-4).alias("b"))
    w = isl.by(["bag"], ["i"]).rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col("l0").isNotNull(), F.struct("l0", "b", "i")), ignorenulls=True).over(w)
    c = f.select("bag", "i", F.col("l0").isNotNull().alias("own"), held.alias("m"))
    age = F.col("i") - F.col("m.i")
    b = F.when(F.col("own"), F.col("m.b")).when(age <= 3, F.col("m.b") * (1 - 0.25 * age)).otherwise(0.0)
    return c.select("bag", "i", "own", F.round(F.coalesce("m.l0", F.lit(0.0)), 6).alias("l0"), F.round(b, 8).alias("b"), F.coalesce(age, F.lit(-1).cast("long")).alias("age"))


_CEIL = """ca AS (SELECT frame, floor(d / 5)::BIGINT AS bin, max(h) AS top, count(*) AS n FROM pt WHERE h > 1.2e0 GROUP BY ALL HAVING count(*) >= 4),
cb AS (SELECT frame, bin, bin * 5e0 + 2.5e0 AS x, top + 0.02e0 * (bin % 4) AS y, sqrt(least(n, 200)) AS w FROM ca),
ck AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY x) AS k, x <= 60 AS near FROM cb),
cn AS (SELECT frame, median(y) FILTER (near) AS height, count(*) FILTER (near) AS n_near, max(x) FILTER (near) AS reach FROM ck GROUP BY frame), cm AS (SELECT cn.*, (SELECT median(abs(y - height)) FROM ck WHERE ck.frame = cn.frame AND near) AS spread FROM cn WHERE n_near >= 2)"""


@query(f"""WITH RECURSIVE {PT}, {_CEIL}, st AS (SELECT frame, sum(w*w) AS s0, sum(w*w*x) AS s1, sum(w*w*x*x) AS s2, sum(w*w*y) AS t0, sum(w*w*x*y) AS t1 FROM ck WHERE near GROUP BY frame),
gr AS (SELECT m.frame, (SELECT max(k) FROM ck WHERE ck.frame = m.frame AND near) AS k, s0, s1, s2, t0, t1, reach AS last_x, 0 AS added, false AS ended, height FROM cm m JOIN st USING (frame) WHERE spread <= 0.6e0
  UNION ALL SELECT b.frame, b.ck, CASE WHEN take THEN s0 + w*w ELSE s0 END, CASE WHEN take THEN s1 + w*w*x ELSE s1 END, CASE WHEN take THEN s2 + w*w*x*x ELSE s2 END, CASE WHEN take THEN t0 + w*w*y ELSE t0 END, CASE WHEN take THEN t1 + w*w*x*y ELSE t1 END,
    CASE WHEN take THEN x ELSE last_x END, added + take::INT, stop, height FROM (SELECT gr.*, c.x, c.y, c.w, c.k AS ck, gr.ended OR c.x - gr.last_x > 20e0 OR abs(c.y - height) > 0.8e0 + 0.004e0 * (c.x - 60) AS stop,
    NOT (gr.ended OR c.x - gr.last_x > 20e0 OR abs(c.y - height) > 0.8e0 + 0.004e0 * (c.x - 60)) AND abs(c.y - ((t0*s2 - t1*s1)/(s0*s2 - s1*s1) + (t1*s0 - t0*s1)/(s0*s2 - s1*s1) * c.x)) <= 0.35e0 + 0.002e0 * (c.x - 60) AS take
    FROM gr JOIN ck c ON c.frame = gr.frame AND c.k = gr.k + 1) b),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY k DESC) AS rn FROM gr) WHERE rn = 1)
SELECT c.frame, coalesce(added, 0)::BIGINT AS far_bins, coalesce(added >= 3 AND abs((t0*s2 - t1*s1)/(s0*s2 - s1*s1) + (t1*s0 - t0*s1)/(s0*s2 - s1*s1) * 60e0 - f.height) <= 0.6e0, false) AS extended, coalesce(last_x, -1e0) AS reach FROM cn c LEFT JOIN f USING (frame)""")
def ceiling_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rail carried on by a ceiling of constant height: bins join one by one while they fit, with a refit each time.

    A frame's bins (some sixty rows) are folded in one pass; points were aggregated to bins before.
    """
    p = points(spark, sf_dir).where("h > 1.2D")
    bin_ = C.floor_bin(F.col("d"), 5.0)
    b = p.groupBy("frame", bin_.alias("bin")).agg(F.max("h").alias("top"), F.count(F.lit(1)).alias("n")).where("n >= 4")
    b = b.select("frame", (F.col("bin") * 5.0 + 2.5).alias("x"), (F.col("top") + 0.02 * (F.col("bin") % 4)).alias("y"), F.sqrt(F.least(F.col("n"), F.lit(200))).alias("w"))

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("x")
        x, y, w = (g[c].to_numpy() for c in "xyw")
        near = x <= 60
        out = {"frame": g["frame"].iloc[0], "far_bins": 0, "extended": False, "reach": -1.0}
        if near.sum() < 2:
            return pd.DataFrame([out])
        height, last = float(np.median(y[near])), float(x[near].max())
        if np.median(np.abs(y[near] - height)) > 0.6:
            return pd.DataFrame([out])
        keep = near.copy()
        line = lambda: np.polyfit(x[keep], y[keep], 1, w=w[keep])
        at = line()
        for k in np.flatnonzero(~near):
            if x[k] - last > 20 or abs(y[k] - height) > 0.8 + 0.004 * (x[k] - 60):
                break
            if abs(y[k] - np.polyval(at, x[k])) <= 0.35 + 0.002 * (x[k] - 60):
                keep[k], last = True, float(x[k])
                at = line()
        far = int((keep & ~near).sum())
        return pd.DataFrame([out | {"far_bins": far, "extended": bool(far >= 3 and abs(np.polyval(at, 60.0) - height) <= 0.6), "reach": last}])

    return b.groupBy("frame").applyInPandas(one, "frame long, far_bins long, extended boolean, reach double")


@query(f"""WITH {PT}, s AS (SELECT frame, floor(d / 5)::BIGINT AS bin, CASE WHEN l > 0 THEN 1 ELSE -1 END AS side, abs(l) AS a, h FROM pt WHERE l <> 0 AND h BETWEEN 0.5e0 AND 3e0), e AS (SELECT frame, side, bin, quantile_cont(a, 0.2) AS edge FROM s GROUP BY ALL HAVING count(*) >= 4),
w AS (SELECT e.frame, e.side, e.bin, edge FROM e JOIN s ON s.frame = e.frame AND s.side = e.side AND s.bin = e.bin AND a <= edge + 0.5e0 GROUP BY ALL HAVING max(h) - min(h) >= 1.2e0),
t AS (SELECT frame, side, bin AS k0, edge AS o0, lead(bin, 1) OVER v AS k1, lead(edge, 1) OVER v AS o1, lead(bin, 2) OVER v AS k2, lead(edge, 2) OVER v AS o2 FROM w WINDOW v AS (PARTITION BY frame, side ORDER BY bin)),
q AS (SELECT *, CASE WHEN o0 < 0.55e0 THEN k0 WHEN o1 < 0.55e0 THEN k1 WHEN o2 < 0.55e0 THEN k2 END * 5e0 AS lim FROM t WHERE k1 - k0 <= 2 AND k2 - k1 <= 2 AND o0 - o1 >= 0.05e0 * (k1 - k0) AND o1 - o2 >= 0.05e0 * (k2 - k1) AND (o0 - o2 >= 0.4e0 OR (o0 - o2 >= 0.2e0 AND o2 <= 0.35e0))),
l AS (SELECT frame, side, min(lim) AS lim, count(*) AS sweeps FROM q WHERE lim >= 20 GROUP BY ALL)
SELECT frame, min(lim) AS sweep_limit, sum(sweeps)::BIGINT AS sweeps, arg_min(side, lim * 10 - side)::BIGINT AS side FROM l GROUP BY frame""")
def wall_sweep_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a wall sweeps into the corridor: three edges in a row that close in enough, together or deep inside."""
    s = points(spark, sf_dir).where("l <> 0 and h between 0.5D and 3D").select("frame", C.floor_bin(F.col("d"), 5.0).alias("bin"), F.when(F.col("l") > 0, 1).otherwise(-1).alias("side"), F.abs("l").alias("a"), "h")
    e = rank_quantiles(s, ["frame", "side", "bin"], "a", {"edge": (0.2, "fused")}).where("n >= 4")
    w = s.join(e, ["frame", "side", "bin"]).where("a <= edge + 0.5D").groupBy("frame", "side", "bin", "edge").agg((F.max("h") - F.min("h")).alias("span")).where("span >= 1.2D")
    v = Window.partitionBy("frame", "side").orderBy("bin")
    t = w.select("frame", "side", F.col("bin").alias("k0"), F.col("edge").alias("o0"), *[f(c, k).over(v).alias(f"{n}{k}") for k in (1, 2) for c, n, f in (("bin", "k", F.lead), ("edge", "o", F.lead))])
    sweep = "k1 - k0 <= 2 and k2 - k1 <= 2 and o0 - o1 >= 0.05D * (k1 - k0) and o1 - o2 >= 0.05D * (k2 - k1) and (o0 - o2 >= 0.4D or (o0 - o2 >= 0.2D and o2 <= 0.35D))"
    lim = F.when(F.col("o0") < 0.55, F.col("k0")).when(F.col("o1") < 0.55, F.col("k1")).when(F.col("o2") < 0.55, F.col("k2")) * 5.0
    q = t.where(sweep).withColumn("lim", lim).where("lim >= 20").groupBy("frame", "side").agg(F.min("lim").alias("lim"), F.count(F.lit(1)).alias("sweeps"))
    best = F.min(F.struct("lim", (-F.col("side")).alias("m")))
    return q.groupBy("frame").agg(best.alias("b"), F.sum("sweeps").alias("sweeps")).select("frame", F.col("b.lim").alias("sweep_limit"), "sweeps", (-F.col("b.m")).cast("long").alias("side"))


@query(f"""WITH {PT}, c0 AS (SELECT frame, floor(d / 10) * 10e0 + 5e0 AS x, avg(l) AS m FROM pt WHERE r > 20 GROUP BY ALL), c AS (SELECT frame, x, m - 0.0005e0 * x AS res FROM c0),
o AS (SELECT frame, median(res) AS off, count(*) AS n FROM c WHERE x BETWEEN 20 AND 60 GROUP BY frame HAVING count(*) >= 2), t AS (SELECT c.*, off, lag(x) OVER (PARTITION BY c.frame ORDER BY x) AS prev FROM c JOIN o USING (frame) WHERE x >= 20),
b AS (SELECT *, coalesce(prev, 20e0) < x - 15e0 OR abs(res - off) > 0.25e0 AS fails FROM t), u AS (SELECT *, bool_or(fails) OVER (PARTITION BY frame ORDER BY x) AS ended FROM b)
SELECT frame, coalesce(max(x) FILTER (NOT ended), 0e0) AS shape_range, count(*) FILTER (NOT ended) AS samples FROM u GROUP BY frame""")
def chain_shape_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the line follows the chain's shape: to the first sample off the usual residual, or a gap."""
    x = C.floor_bin(F.col("d"), 10.0) * 10.0 + 5.0
    c = points(spark, sf_dir).where("r > 20").groupBy("frame", x.alias("x")).agg(C.exact_avg(F.col("l")).alias("l")).select("frame", "x", (F.col("l") - 0.0005 * F.col("x")).alias("res"))
    o = c.where("x between 20 and 60").groupBy("frame").agg(F.percentile("res", 0.5).alias("off"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    w = Window.partitionBy("frame").orderBy("x")
    t = c.join(o, "frame").where("x >= 20").withColumn("prev", F.lag("x").over(w))
    fails = (F.coalesce("prev", F.lit(20.0)) < F.col("x") - 15.0) | (F.abs(F.col("res") - F.col("off")) > 0.25)
    u = t.withColumn("ended", F.max(fails).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return u.groupBy("frame").agg(F.coalesce(F.max(F.when(~F.col("ended"), F.col("x"))), F.lit(0.0)).alias("shape_range"), F.count_if(~F.col("ended")).alias("samples"))


_AXES = [("+x", "+z", "d", "h"), ("-y", "+z", "-l", "h"), ("+z", "+x", "h", "d"), ("+x", "-z", "d", "-h"), ("+y", "+z", "l", "h")]


@query(f"""WITH {PT}, a AS ({" UNION ALL ".join(f"SELECT frame, {k} AS rank, '{f}{u}' AS axes, {x} AS along, {z} AS up, slot FROM pt" for k, (f, u, x, z) in enumerate(_AXES))}),
s AS (SELECT frame, rank, axes, quantile_cont(along, 0.98) AS extent, quantile_cont(up, 0.5) AS level FROM a GROUP BY ALL), n AS (SELECT a.frame, a.rank, count(*) FILTER (abs(up - level) <= 0.25e0) AS surface, count(*) FILTER (up - level < -0.25e0 AND up - level > -1e0) AS beyond, count(DISTINCT floor(along / 20)) AS bins FROM a JOIN s USING (frame, rank) GROUP BY ALL),
b AS (SELECT *, max(bins) OVER (PARTITION BY frame) AS most FROM s JOIN n USING (frame, rank)), k AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY (beyond > 0.1e0 * surface) DESC, rank) AS rn FROM b WHERE bins >= 0.4e0 * most)
SELECT frame, axes, round(extent, 4) AS extent, bins::BIGINT AS bins, beyond, surface FROM k WHERE rn = 1""")
def axis_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axes of an unknown sensor: of the conventions with enough bins, one with returns beyond its surface, then the likeliest."""
    p = points(spark, sf_dir).select("frame", "d", "l", "h").repartition("frame")  # points move once, as themselves and not once a convention
    s = p.groupBy("frame").agg(*[F.percentile(F.expr(x), 0.98).alias(f"extent{k}") for k, (_, _, x, _) in enumerate(_AXES)], *[F.percentile(F.expr(z), 0.5).alias(f"level{k}") for k, (_, _, _, z) in enumerate(_AXES)])

    def counted(k: int) -> list[Column]:
        off = F.expr(_AXES[k][3]) - F.col(f"level{k}")
        bins = F.collect_set(C.floor_bin(F.expr(_AXES[k][2]), 20.0))  # of a frame
        return [F.first(f"extent{k}").alias(f"extent{k}"), F.count_if(F.abs(off) <= 0.25).alias(f"surface{k}"), F.count_if((off < -0.25) & (off > -1.0)).alias(f"beyond{k}"), F.size(bins).cast("long").alias(f"bins{k}")]

    n = p.join(s, "frame").groupBy("frame").agg(*[c for k in range(len(_AXES)) for c in counted(k)])
    sides = F.array(*[F.struct(F.lit(k).alias("rank"), F.lit(f + u).alias("axes"), *[F.col(f"{c}{k}").alias(c) for c in ("extent", "surface", "beyond", "bins")]) for k, (f, u, _, _) in enumerate(_AXES)])
    b = n.withColumn("most", F.greatest(*[F.col(f"bins{k}") for k in range(len(_AXES))])).select("frame", "most", F.inline(sides)).where(F.col("bins") >= 0.4 * F.col("most"))
    best = b.groupBy("frame").agg(F.min(F.struct((~(F.col("beyond") > 0.1 * F.col("surface"))).alias("m"), "rank", "axes", "extent", "bins", "beyond", "surface")).alias("b"))
    return best.select("frame", F.col("b.axes").alias("axes"), F.round("b.extent", 4).alias("extent"), F.col("b.bins").alias("bins"), F.col("b.beyond").alias("beyond"), F.col("b.surface").alias("surface"))


@query(f"""WITH {PT}, s AS (SELECT frame, count(*) AS n, sum(d) sd, sum(l) sl, sum(h) sh, sum(d*d) dd, sum(l*l) ll, sum(d*l) dl, sum(d*h) dh, sum(l*h) lh FROM pt WHERE h <= 1.6e0 GROUP BY frame),
m AS (SELECT *, n*(dd*ll-dl*dl) - sd*(sd*ll-dl*sl) + sl*(sd*dl-dd*sl) AS det FROM s),
f AS (SELECT *, (sh*(dd*ll-dl*dl) - sd*(dh*ll-dl*lh) + sl*(dh*dl-dd*lh)) / det AS a, (n*(dh*ll-dl*lh) - sh*(sd*ll-dl*sl) + sl*(sd*lh-dh*sl)) / det AS b, (n*(dd*lh-dh*dl) - sd*(sd*lh-dh*sl) + sh*(sd*dl-dd*sl)) / det AS c FROM m),
r AS (SELECT f.frame, f.n, a, b, c, sqrt(avg(power(pt.h - (a + b * pt.d + c * pt.l), 2))) AS rms FROM f JOIN pt ON pt.frame = f.frame AND pt.h <= 1.6e0 GROUP BY ALL)
SELECT frame, n, round(a, 4) AS a, round(b, 7) AS b, round(c, 5) AS c, round(rms, 5) AS rms, rms BETWEEN 0.8e0 * 0.55e0 AND 1.2e0 * 0.55e0 AS within FROM r""")
def plane_fit_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plane through each frame's bed, and whether its roughness is within a fifth of the reference's."""
    p = points(spark, sf_dir).where("h <= 1.6D")
    one, d, s, h = F.lit(1.0), F.col("d"), F.col("l"), F.col("h")
    basis = {"n": one, "sd": d, "sl": s, "sh": h, "dd": d * d, "ll": s * s, "dl": d * s, "dh": d * h, "lh": s * h}
    g = p.groupBy("frame").agg(*[F.sum(v).alias(k) for k, v in basis.items()])
    e = F.expr
    det = e("n*(dd*ll-dl*dl) - sd*(sd*ll-dl*sl) + sl*(sd*dl-dd*sl)")
    f = g.select(
        "frame", F.col("n").cast("long").alias("n"), (e("sh*(dd*ll-dl*dl) - sd*(dh*ll-dl*lh) + sl*(dh*dl-dd*lh)") / det).alias("a"),
        (e("n*(dh*ll-dl*lh) - sh*(sd*ll-dl*sl) + sl*(sd*lh-dh*sl)") / det).alias("b"), (e("n*(dd*lh-dh*dl) - sd*(sd*lh-dh*sl) + sh*(sd*dl-dd*sl)") / det).alias("c"),
    )
    r = p.join(f, "frame").withColumn("off", h - (F.col("a") + F.col("b") * d + F.col("c") * s)).groupBy("frame", "n", "a", "b", "c").agg(F.sqrt(F.avg(F.col("off") * F.col("off"))).alias("rms"))
    return r.select("frame", "n", F.round("a", 4).alias("a"), F.round("b", 7).alias("b"), F.round("c", 5).alias("c"), F.round("rms", 5).alias("rms"), F.col("rms").between(0.8 * 0.55, 1.2 * 0.55).alias("within"))


@query(f"""WITH {FR}, x AS (SELECT bag, i, abs(k - 25) * 1e-5 AS b, dist > 420 AS moved FROM fr), e AS (SELECT *, sum(moved::INT) OVER (PARTITION BY bag ORDER BY i)::BIGINT AS epoch FROM x)
SELECT bag, i, epoch, round(median(b) OVER w, 9) AS bend, count(*) OVER w AS held FROM e WINDOW w AS (PARTITION BY bag, epoch ORDER BY i ROWS BETWEEN 299 PRECEDING AND CURRENT ROW)""")
def bend_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median bend of the last frames at one place; the window is cleared when the scene moves."""
    x = frames(spark, sf_dir).select("bag", "i", (F.abs(F.col("k") - 25) * 1e-5).alias("b"), (F.col("dist") > 420).cast("long").alias("moved"))
    e = x.withColumn("epoch", F.sum("moved").over(isl.by(["bag"], ["i"]).rowsBetween(Window.unboundedPreceding, 0)))
    w = isl.by(["bag", "epoch"], ["i"]).rowsBetween(-299, 0)
    return e.select("bag", "i", "epoch", F.round(F.percentile("b", 0.5).over(w), 9).alias("bend"), F.count(F.lit(1)).over(w).alias("held"))


@query(f"""WITH {FR}, x AS (SELECT bag, i, dist AS model, i % 40 < 33 AS still FROM fr), e AS (SELECT *, sum((NOT still)::INT) OVER (PARTITION BY bag ORDER BY i) AS g FROM x),
p AS (SELECT *, sum(still::INT) OVER (PARTITION BY bag, g ORDER BY i) AS run FROM e), m AS (SELECT *, median(model) OVER (PARTITION BY bag, g ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS med FROM p),
f AS (SELECT *, CASE WHEN still AND run = 5 THEN med END AS start FROM m), z AS (SELECT *, last_value(start IGNORE NULLS) OVER (PARTITION BY bag, g ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS frozen FROM f)
SELECT bag, i, still AND run >= 5 AS is_frozen, round(CASE WHEN still AND run >= 5 THEN frozen WHEN still THEN med ELSE model END, 6) AS model FROM z""")
def frozen_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In a still scene the model is the median of the last fits, and after five still frames it is frozen."""
    x = frames(spark, sf_dir).select("bag", "i", F.col("dist").alias("model"), (F.col("i") % 40 < 33).alias("still"))
    up = isl.by(["bag"], ["i"]).rowsBetween(Window.unboundedPreceding, 0)
    e = x.withColumn("g", F.sum((~F.col("still")).cast("long")).over(up))
    w = isl.by(["bag", "g"], ["i"])
    p = e.withColumn("run", F.sum(F.col("still").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("med", F.percentile("model", 0.5).over(w.rowsBetween(-4, 0)))
    frozen = F.last(F.when(F.col("still") & (F.col("run") == 5), F.col("med")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    on = F.col("still") & (F.col("run") >= 5)
    return p.withColumn("frozen", frozen).select("bag", "i", on.alias("is_frozen"), F.round(F.when(on, F.col("frozen")).when(F.col("still"), F.col("med")).otherwise(F.col("model")), 6).alias("model"))


@query(f"""WITH RECURSIVE {FR}, x AS (SELECT bag, i, CASE WHEN k % 6 = 0 THEN 0 ELSE i * 3 + k * 8 END AS given FROM fr),
a AS (SELECT bag, i, given AS offs, 0 AS bad FROM x WHERE i = 0 UNION ALL SELECT x.bag, x.i, CASE WHEN given = 0 THEN offs WHEN given >= offs THEN given ELSE given + 128 * ceil((offs - given) / 128e0)::BIGINT END, CASE WHEN given <> 0 AND given < offs THEN 1 ELSE 0 END FROM a JOIN x ON x.bag = a.bag AND x.i = a.i + 1)
SELECT bag, i, offs::BIGINT AS offs, bad = 1 AS repaired FROM a""")
def repaired_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot offsets that never decrease: smaller ones grow by steps of 128, zeros inherit.  An ordered fold that streams through its task."""
    given = F.when(F.col("k") % 6 == 0, F.lit(0)).otherwise(F.col("i") * 3 + F.col("k") * 8)
    x = frames(spark, sf_dir).select("bag", "i", given.cast("long").alias("given")).repartition("bag").sortWithinPartitions("bag", "i")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bag, offs = None, 0
        for b in batches:
            out, bad = [], []
            for now, given in zip(b["bag"], b["given"], strict=True):
                if now != bag:
                    bag, offs = now, given
                    bad.append(False)
                else:
                    bad.append(bool(0 < given < offs))
                    offs = offs if not given else given + 128 * max(0, -(-(offs - given) // 128))
                out.append(offs)
            yield b[["bag", "i"]].assign(offs=out, repaired=bad)

    return x.mapInPandas(run, "bag long, i long, offs long, repaired boolean")


@query(f"""WITH {FR}, f AS (SELECT bag, i, i % 45 < 38 AS still FROM fr), x AS (SELECT * FROM f WHERE still), y AS (SELECT *, i - row_number() OVER (PARTITION BY bag ORDER BY i) AS g FROM x),
s AS (SELECT bag, min(i) AS first_i, max(i) AS last_i, count(*) AS n FROM y GROUP BY bag, g HAVING count(*) >= 30), l AS (SELECT bag, max(i) FILTER (k <> 7 AND i < 12) AS last_on, max(i) AS last_i FROM fr GROUP BY bag)
SELECT l.bag, coalesce(count(s.first_i), 0) AS segments, coalesce(sum(n), 0)::BIGINT AS still_frames, last_on, l.last_i - last_on AS tail, l.last_i - last_on >= 50 AS off FROM l LEFT JOIN s USING (bag) GROUP BY l.bag, last_on, l.last_i""")
def still_segments_and_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least thirty still frames, and recordings whose network was off for the last fifty frames."""
    fr = frames(spark, sf_dir)
    runs = isl.islands(fr.where("i % 45 < 38").select("bag", "i"), ["bag"], "i", 1).groupBy("bag", "run").agg(F.count(F.lit(1)).alias("n")).where("n >= 30")
    s = runs.groupBy("bag").agg(F.count(F.lit(1)).alias("segments"), F.sum("n").alias("still_frames"))
    m = fr.groupBy("bag").agg(F.max(F.when((F.col("k") != 7) & (F.col("i") < 12), F.col("i"))).alias("last_on"), F.max("i").alias("last_i"))
    tail = F.col("last_i") - F.col("last_on")
    return m.join(s, "bag", "left").fillna(0, ["segments", "still_frames"]).select("bag", "segments", "still_frames", "last_on", tail.alias("tail"), (tail >= 50).alias("off"))


_BINS = "b0 AS (SELECT frame, floor(d / 4)::BIGINT AS bin, quantile_cont(h, 0.2) AS y, least(count(*), 500)::DOUBLE AS w FROM pt GROUP BY ALL)"


def _gated_sql() -> str:
    """The chain of accepted bins, each against the line through the last four, by recursion over bins."""
    n, sx, sy = "len(xs)", "list_sum(xs)", "list_sum(ys)"
    sxx, sxy = "list_sum(list_transform(xs, lambda v: v * v))", "list_sum(list_transform(list_zip(xs, ys), lambda p: p[1] * p[2]))"
    slope = f"(({n} * {sxy} - {sx} * {sy}) / ({n} * {sxx} - {sx} * {sx}))"
    guess = f"CASE WHEN {n} >= 2 THEN {slope} * x + ({sy} - {slope} * {sx}) / {n} WHEN {n} = 1 THEN ys[1] ELSE y END"
    return f"""WITH RECURSIVE {PT}, {_BINS}, nb AS (SELECT *, bin * 1e0 AS x, row_number() OVER (PARTITION BY frame ORDER BY bin) AS k FROM b0),
a AS (SELECT frame, 0::BIGINT AS k, 0::BIGINT AS bin, []::DOUBLE[] AS xs, []::DOUBLE[] AS ys, false AS accepted FROM (SELECT DISTINCT frame FROM nb)
  UNION ALL SELECT frame, k, bin, CASE WHEN ok THEN list_append(xs, x)[-4:] ELSE xs END, CASE WHEN ok THEN list_append(ys, y)[-4:] ELSE ys END, ok
  FROM (SELECT nb.frame, nb.k, nb.bin, x, y, xs, ys, abs(y - ({guess})) <= 0.3e0 + 1e-9 AS ok FROM a JOIN nb ON nb.frame = a.frame AND nb.k = a.k + 1))
SELECT frame, bin, accepted FROM a WHERE k > 0"""


ORACLE_SQL["gated_profile"] = _gated_sql()
QUERIES["gated_profile"] = scene_queries.QUERIES["gated_profile"]


def _trimmed_sql() -> str:
    parts, prev = "", "t0"
    for k, limit in enumerate((0.5, 0.25, 0.25), 1):
        parts += f"""{fit_sql(prev, f"q{k}", cm="2e-3")}, t{k} AS (SELECT * EXCLUDE (q{k}a, q{k}b, q{k}c, q{k}n) REPLACE (keep AND coalesce(abs(y - (q{k}a + q{k}b * x + q{k}c * x * x)) <= {limit}e0, false) AS keep, ok AND q{k}n >= 4 AS ok) FROM q{k}), """
        prev = f"t{k}"
    return f"""WITH {PT}, {_BINS}, t0 AS (SELECT *, bin * 4e0 + 2e0 AS x, true AS keep, true AS ok FROM b0), {parts} {fit_sql("t3", "f", cm="2e-3")}
SELECT frame, bool_and(ok AND fn >= 4) AS ok, round(max(CASE WHEN ok AND fn >= 4 THEN fa ELSE 0e0 END), 5) AS a, round(max(CASE WHEN ok AND fn >= 4 THEN fb ELSE -1e9 END), 7) AS b, round(max(CASE WHEN ok AND fn >= 4 THEN fc ELSE -1e9 END), 9) AS c,
  count(*) FILTER (keep) AS used, round(sqrt(avg(power(y - (fa + fb * x + fc * x * x), 2)) FILTER (keep)), 6) AS rms FROM f GROUP BY frame"""


@query(_trimmed_sql())
def trimmed_profile_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quadratic profile of a frame's bins with three trimming passes, as windows over the frame."""
    d = scene_queries._bins(spark, sf_dir).select("frame", (F.col("bin") * 4.0 + 2.0).alias("x"), "y", "w", F.lit(True).alias("keep"), F.lit(True).alias("ok"))
    for limit in (0.5, 0.25, 0.25):
        d = pr.fit_kept(d, ["frame"], F.lit(2e-3)).withColumn("ok", F.col("ok") & (F.col("fn") >= 4))
        d = d.withColumn("keep", F.col("keep") & F.coalesce(F.abs(F.col("y") - pr.poly()) <= limit, F.lit(False)))
    d = pr.fit_kept(d, ["frame"], F.lit(2e-3)).withColumn("ok", F.col("ok") & (F.col("fn") >= 4))
    miss = F.when(F.col("keep"), F.col("y") - pr.poly())
    part = lambda c, other: F.max(F.when(F.col("ok"), F.col(c)).otherwise(other))
    return d.groupBy("frame").agg(
        F.bool_and("ok").alias("ok"), F.round(part("fa", 0.0), 5).alias("a"), F.round(part("fb", -1e9), 7).alias("b"), F.round(part("fc", -1e9), 9).alias("c"), F.count_if("keep").alias("used"), F.round(F.sqrt(F.avg(miss * miss)), 6).alias("rms")
    )


#: Least-cost path over sixteen shifts: each state's total and its path, carried from frame to frame.
ORACLE_SQL["motion_path"] = f"""WITH RECURSIVE {FR}, c AS (SELECT bag, i, list_transform(range(0, 16), lambda j: abs(dist - j * 32e0) / 32e0) AS cost FROM fr),
v AS (SELECT bag, i, cost AS total, list_transform(range(0, 16), lambda j: [j]) AS paths FROM c WHERE i = 0 UNION ALL
  SELECT bag, i, list_transform(range(0, 16), lambda j: cost[j + 1] + via[j + 1][back[j + 1]]), list_transform(range(0, 16), lambda j: list_append(paths[back[j + 1]], j)) FROM (
    SELECT *, list_transform(via, lambda r: list_position(r, list_min(r))) AS back FROM (
      SELECT c.bag, c.i, c.cost, v.paths, list_transform(range(0, 16), lambda j: list_transform(range(0, 16), lambda q: v.total[q + 1] + 0.5e0 * (j - q) * (j - q))) AS via FROM v JOIN c ON c.bag = v.bag AND c.i = v.i + 1))),
e AS (SELECT bag, arg_max(total, i) AS total, arg_max(paths, i) AS paths FROM v GROUP BY bag), p AS (SELECT bag, paths[list_position(total, list_min(total))] AS path FROM e)
SELECT bag, unnest(range(0, len(path))) AS i, unnest(path) AS shift FROM p"""
QUERIES["motion_path"] = scene_queries.QUERIES["motion_path"]
