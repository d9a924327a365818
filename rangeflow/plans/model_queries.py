"""Queries of models over frames: class rules, symmetry, held models, hysteresis, interpolation tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
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


#: Ordered class rules of beam groups: (class, condition, score factor); the first that holds decides.
CLASS_RULES = [
    ("dust", "n >= 3 and see_through >= 0.5D", 1.0),
    ("obstacle", "ext_l >= 1.5D and ext_d <= 1D and n >= 12 and ext_h >= 1.5D and min_h <= 1.5D", 1.0),
    ("structure", "ext_h < 0.12D and greatest(ext_d, ext_l) >= 0.4D and mean_h >= 1.5D", 0.1),
    ("structure", "ext_d >= 3D and ext_l <= 1D and ext_d >= 3D * greatest(ext_l, 0.05D)", 0.1),
    ("structure", "ext_l <= 0.35D and ext_d >= 1.5D", 0.1),
    ("structure", "ext_l <= 0.2D and ext_h >= 2D * greatest(ext_l, 0.05D) and n >= 3", 0.1),
    ("hanging", "d_near >= 50 and min_h >= 1.5D", 0.25),
]

def _sql_case(values: list[str], other: str) -> str:
    whens = " ".join(f"WHEN {re.sub(r'(?<=[0-9])D', 'e0', c)} THEN {v}" for (_, c, _), v in zip(CLASS_RULES, values, strict=True))
    return f"CASE {whens} ELSE {other} END"


@query(f"""WITH {PT}, g AS (SELECT frame, floor(d)::BIGINT AS cell, count(*) AS n, median(d) AS d_near, max(d) - min(d) AS ext_d, max(l) - min(l) AS ext_l, max(h) - min(h) AS ext_h, avg(h) AS mean_h, min(h) AS min_h,
  avg((r > 45)::INT) AS see_through FROM pt GROUP BY ALL), c AS (SELECT *, {_sql_case([f"'{x}'" for x, _, _ in CLASS_RULES], "'obstacle'")} AS cls, {_sql_case([f"{f}e0" for _, _, f in CLASS_RULES], "1e0")} AS factor FROM g)
SELECT cls, count(*) AS clusters, round(sum(least(1e0, n / 6e0) * factor), 4) AS score FROM c GROUP BY cls""")
def beam_class_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups classed by an ordered table of rules, their scores multiplied by the rule's factor."""
    g = points(spark, sf_dir).groupBy("frame", C.floor_bin(F.col("d"), 1.0).alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.percentile("d", 0.5).alias("d_near"), (F.max("d") - F.min("d")).alias("ext_d"), (F.max("l") - F.min("l")).alias("ext_l"),
        (F.max("h") - F.min("h")).alias("ext_h"), F.avg("h").alias("mean_h"), F.min("h").alias("min_h"), F.avg((F.col("r") > 45).cast("int")).alias("see_through"),
    )
    rule = F.coalesce(*[F.when(F.expr(c), F.struct(F.lit(x).alias("cls"), F.lit(f).alias("factor"))) for x, c, f in CLASS_RULES], F.struct(F.lit("obstacle").alias("cls"), F.lit(1.0).alias("factor")))
    c = g.withColumn("rule", rule)
    return c.groupBy(F.col("rule.cls").alias("cls")).agg(F.count(F.lit(1)).alias("clusters"), F.round(F.sum(F.least(F.lit(1.0), F.col("n") / 6.0) * F.col("rule.factor")), 4).alias("score"))


@query(f"""WITH {PT}, p AS (SELECT flag, floor(l / 0.2e0)::BIGINT AS cell, quantile_cont(h, 0.2) AS y FROM pt GROUP BY ALL HAVING count(*) >= 3), a AS (SELECT unnest(range(-6, 7)) AS axis),
x AS (SELECT p.flag, axis, count(*) AS n, avg(abs(p.y - q.y)) AS off FROM p CROSS JOIN a JOIN p q ON q.flag = p.flag AND q.cell = 2 * axis - 1 - p.cell WHERE p.cell >= axis AND p.cell < axis + 12 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY flag ORDER BY off, axis) AS rn FROM x WHERE n >= 3) SELECT flag, axis, n, round(off, 6) AS off FROM r WHERE rn = 1""")
def symmetry_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mirror axis of a lateral profile: least mean difference over candidates that are covered well."""
    p = points(spark, sf_dir).groupBy("flag", C.floor_bin(F.col("l"), 0.2).alias("cell")).agg(F.percentile("h", 0.2).alias("y"), F.count(F.lit(1)).alias("c")).where("c >= 3").drop("c")
    a = p.withColumn("axis", F.explode(F.sequence(F.lit(-6).cast("long"), F.lit(6).cast("long")))).where("cell >= axis and cell < axis + 12")
    q = p.select("flag", F.col("cell").alias("other"), F.col("y").alias("yo"))
    x = a.withColumn("other", 2 * F.col("axis") - 1 - F.col("cell")).join(q, ["flag", "other"]).groupBy("flag", "axis").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("y") - F.col("yo"))).alias("off")).where("n >= 3")
    best = x.groupBy("flag").agg(F.min(F.struct("off", "axis", "n")).alias("b"))
    return best.select("flag", F.col("b.axis").alias("axis"), F.col("b.n").alias("n"), F.round("b.off", 6).alias("off"))


@query(f"""WITH {FR}, m AS (SELECT bag, i, CASE WHEN k % 3 <> 0 THEN dist END AS model FROM fr)
SELECT bag, i, coalesce(last_value(model IGNORE NULLS) OVER w, -1e0) AS held, model IS NULL AND last_value(model IGNORE NULLS) OVER w IS NOT NULL AS is_held FROM m WINDOW w AS (PARTITION BY bag ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def held_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A failed model is replaced by the last good one of two frames at most."""
    w = Window.partitionBy("bag").orderBy("i").rowsBetween(-2, 0)
    m = frames(spark, sf_dir).select("bag", "i", F.when(F.col("k") % 3 != 0, F.col("dist")).alias("model"))
    held = F.last("model", ignorenulls=True).over(w)
    return m.select("bag", "i", F.coalesce(held, F.lit(-1.0)).alias("held"), (F.col("model").isNull() & held.isNotNull()).alias("is_held"))


@query(f"""WITH {FR} SELECT bag, i, coalesce(last_value(CASE WHEN dist > 350 THEN true WHEN dist < 150 THEN false END IGNORE NULLS) OVER (PARTITION BY bag ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS extended FROM fr""")
def extension_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On above one threshold, off below a lower one, unchanged between."""
    w = Window.partitionBy("bag").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    flip = F.when(F.col("dist") > 350, True).when(F.col("dist") < 150, False)
    return frames(spark, sf_dir).select("bag", "i", F.coalesce(F.last(flip, ignorenulls=True).over(w), F.lit(False)).alias("extended"))


STEPS = [(0.0, 0.0), (50.0, 1.0), (100.0, 4.0), (300.0, 5.0)]
_STEP_SQL = " ".join(f"WHEN dist < {b[0]}e0 THEN {a[1]}e0 + ({b[1]}e0 - {a[1]}e0) * (dist - {a[0]}e0) / ({b[0]}e0 - {a[0]}e0)" for a, b in zip(STEPS, STEPS[1:]))


@query(f"""SELECT event_type, round(avg(CASE WHEN dist <= 0 THEN 0e0 {_STEP_SQL} ELSE 5e0 END), 6) AS mean_step, count(*) AS n FROM (SELECT event_type, value AS dist FROM events) GROUP BY event_type""")
def step_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clamped piecewise-linear table as an expression."""
    x = F.col("dist")
    y = F.when(x <= STEPS[0][0], F.lit(STEPS[0][1]))
    for (a, u), (b, v) in zip(STEPS, STEPS[1:]):
        y = y.when(x < b, u + (v - u) * (x - a) / (b - a))
    return frames(spark, sf_dir).groupBy("event_type").agg(F.round(F.avg(y.otherwise(F.lit(STEPS[-1][1]))), 6).alias("mean_step"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {PT}, s AS (SELECT flag, (d >= 50)::INT + (d >= 100)::INT + (d >= 150)::INT + (d >= 210)::INT AS band, frame, h FROM pt)
SELECT flag, count(DISTINCT frame) AS scenes, count(*) FILTER (band = 0) AS near, count(*) FILTER (band = 1) AS mid, count(*) FILTER (band = 2) AS far, count(*) FILTER (band >= 3) AS farthest, bool_or(h > 3) AS has_high, round(sum(h) / 1e3, 4) AS mass FROM s GROUP BY flag""")
def scene_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by class and band, flags and totals of a set of scenes."""
    band = C.digitize(F.col("d"), [50.0, 100.0, 150.0, 210.0])
    return points(spark, sf_dir).withColumn("band", band).groupBy("flag").agg(
        F.count_distinct("frame").alias("scenes"), F.count_if(F.col("band") == 0).alias("near"), F.count_if(F.col("band") == 1).alias("mid"), F.count_if(F.col("band") == 2).alias("far"),
        F.count_if(F.col("band") >= 3).alias("farthest"), F.bool_or(F.col("h") > 3).alias("has_high"), F.round(F.sum("h") / 1e3, 4).alias("mass"),
    )
