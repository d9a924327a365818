"""Queries on synthetic scenes and learning inputs: echoes, insertion, occlusion, channels, losses, fits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import robust
from .image_queries import _ID as PIXEL_ID
from .image_queries import components_within
from .views import FR, PT, band_sql, frames, points

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {PT}, e AS (SELECT frame, slot, d AS near, d + h AS far, l, r FROM pt),
c AS (SELECT *, CASE WHEN abs(l) > 0.95e0 THEN 'blocked' WHEN far - near < 0.4e0 THEN 'merged' WHEN r < 10 THEN 'far only' WHEN r > 40 THEN 'near only' WHEN far - near < 1.5e0 THEN 'mixed' ELSE 'both' END AS kind FROM e)
SELECT kind, count(*) AS n, round(sum(CASE kind WHEN 'far only' THEN far WHEN 'mixed' THEN (near + far) / 2 WHEN 'blocked' THEN 0e0 ELSE near END), 2) AS first_echo, count(*) FILTER (kind = 'both') AS seconds FROM c GROUP BY kind""")
def echo_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near and far surfaces of a beam composed to echoes by an ordered table of cases."""
    near, far, gap = F.col("d"), F.col("d") + F.col("h"), F.col("d") + F.col("h") - F.col("d")
    kind = (
        F.when(F.abs("l") > 0.95, "blocked").when(gap < 0.4, "merged").when(F.col("r") < 10, "far only")
        .when(F.col("r") > 40, "near only").when(gap < 1.5, "mixed").otherwise("both")
    )
    c = points(spark, sf_dir).select(kind.alias("kind"), near.alias("near"), far.alias("far"))
    first = F.when(F.col("kind") == "far only", F.col("far")).when(F.col("kind") == "mixed", (F.col("near") + F.col("far")) / 2).when(F.col("kind") == "blocked", F.lit(0.0)).otherwise(F.col("near"))
    return c.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(first), 2).alias("first_echo"), F.count_if(F.col("kind") == "both").alias("seconds"))


@query(f"""WITH {PT}, e AS (SELECT frame, slot, unnest(CASE WHEN r > 40 THEN [2, 1] ELSE [1] END) AS echo FROM pt)
SELECT frame, slot, echo::BIGINT AS echo, row_number() OVER (PARTITION BY frame ORDER BY slot, echo DESC) - 1 AS place FROM e""")
def second_return_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beams with two echoes give two rows, the second just before the first."""
    e = points(spark, sf_dir).select("frame", "slot", F.explode(F.when(F.col("r") > 40, F.array(F.lit(2), F.lit(1))).otherwise(F.array(F.lit(1)))).alias("echo"))
    w = Window.partitionBy("frame").orderBy("slot", F.desc("echo"))
    return e.select("frame", "slot", F.col("echo").cast("long").alias("echo"), (F.row_number().over(w) - 1).cast("long").alias("place"))


@query(f"""WITH {PT}, o AS (SELECT frame, slot, 60e0 + (slot % 7) AS od FROM pt WHERE slot % 5 = 0 AND abs(l) < 0.5e0),
j AS (SELECT pt.frame, pt.slot, d, od, od IS NOT NULL AND od < d AS hit, od IS NOT NULL AND od >= d AS hidden FROM pt LEFT JOIN o USING (frame, slot))
SELECT frame, count(*) AS n, count(*) FILTER (hit) AS replaced, round(sum(CASE WHEN hit THEN od ELSE d END), 3) AS total, round(avg(CASE WHEN od IS NOT NULL THEN hidden::INT END), 6) AS occluded FROM j GROUP BY frame""")
def in_place_insertion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object's returns replace those behind them; the share of it that is hidden, null if no beam hits."""
    p = points(spark, sf_dir)
    o = p.where("slot % 5 = 0 and abs(l) < 0.5D").select("frame", "slot", (F.lit(60.0) + F.col("slot") % 7).alias("od"))
    j = p.join(o, ["frame", "slot"], "left")
    hit = F.coalesce(F.col("od") < F.col("d"), F.lit(False))
    return j.groupBy("frame").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("replaced"), F.round(F.sum(F.when(hit, F.col("od")).otherwise(F.col("d"))), 3).alias("total"),
        F.round(F.avg((F.col("od") >= F.col("d")).cast("int")), 6).alias("occluded"),
    )


@query(f"""WITH {PT}, x AS (SELECT frame, {band_sql("d")} AS band, r > 25 AS truth, l > 0 AS pred FROM pt)
SELECT band, count(*) FILTER (truth AND pred) AS tp, count(*) FILTER (NOT truth AND pred) AS fp, count(*) FILTER (truth AND NOT pred) AS fn,
  round(count(*) FILTER (truth AND pred) / nullif(count(*) FILTER (truth), 0)::DOUBLE - least(1e0, count(*) FILTER (NOT truth AND pred) / (count(DISTINCT frame) * 1000e0)), 6) AS score FROM x WHERE band IS NOT NULL GROUP BY band""")
def banded_pixel_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel counts a band and a selection score of recall less false positives a frame."""
    t, p = F.col("r") > 25, F.col("l") > 0
    x = points(spark, sf_dir).withColumn("band", C.band_label(F.col("d"))).where("band is not null")
    score = F.count_if(t & p) / F.nullif(F.count_if(t), F.lit(0)) - F.least(F.lit(1.0), F.count_if(~t & p) / (F.count_distinct("frame") * 1000.0))
    return x.groupBy("band").agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.round(score, 6).alias("score"))


@query(f"""WITH {PT}, x AS (SELECT frame, r > 25 AS y, 1e0 / (1e0 + exp(-(l * 3e0))) AS p FROM pt)
SELECT frame, round(avg(CASE WHEN y THEN -0.75e0 * power(1 - p, 2) * ln(greatest(p, 1e-6)) ELSE -0.25e0 * power(p, 2) * ln(greatest(1 - p, 1e-6)) END), 6) AS focal,
  round(1 - (2 * sum(CASE WHEN y THEN p ELSE 0e0 END) + 1) / (sum(p) + sum(y::INT) + 1), 6) AS dice FROM x GROUP BY frame""")
def focal_dice_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Focal and dice losses as aggregates over probabilities."""
    y, p = F.col("r") > 25, F.col("p")
    x = points(spark, sf_dir).withColumn("p", C.logistic(F.col("l") * 3.0))
    focal = F.when(y, -0.75 * F.pow(1 - p, 2) * F.log(F.greatest(p, F.lit(1e-6)))).otherwise(-0.25 * F.pow(p, 2) * F.log(F.greatest(1 - p, F.lit(1e-6))))
    dice = 1 - (2 * F.sum(F.when(y, p).otherwise(0.0)) + 1) / (F.sum("p") + F.sum(y.cast("int")) + 1)
    return x.groupBy("frame").agg(F.round(F.avg(focal), 6).alias("focal"), F.round(dice, 6).alias("dice"))


@query(f"""WITH {PT}, a AS (SELECT frame, slot, l, r, (slot * 7919 + frame * 104729) % 1000 AS u FROM pt)
SELECT frame, count(*) FILTER (u >= 50) AS kept, round(sum(CASE WHEN u >= 50 THEN CASE WHEN frame % 2 = 0 THEN -l ELSE l END END), 4) AS side, round(sum(CASE WHEN u >= 50 THEN least(1e0, r / 50e0 * (0.8e0 + (u % 10) * 0.04e0)) END), 4) AS intensity FROM a GROUP BY frame""")
def hashed_augmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flips, drops and intensity changes that follow from keys, so that every run draws alike."""
    a = points(spark, sf_dir).withColumn("u", (F.col("slot") * 7919 + F.col("frame") * 104729) % 1000).where("u >= 50")
    g = a.groupBy("frame").agg(
        F.count(F.lit(1)).alias("kept"), F.round(F.sum(F.when(F.col("frame") % 2 == 0, -F.col("l")).otherwise(F.col("l"))), 4).alias("side"),
        F.round(F.sum(F.least(F.lit(1.0), F.col("r") / 50.0 * (0.8 + (F.col("u") % 10) * 0.04))), 4).alias("intensity"),
    )
    return g


@query(f"""WITH RECURSIVE {PT}, c AS (SELECT DISTINCT frame, floor(d / 0.4e0)::BIGINT AS row, floor(l / 0.1e0)::BIGINT AS col FROM pt), k AS (SELECT *, {PIXEL_ID} AS id FROM c),
e AS (SELECT a.id AS s, b.id AS t FROM k a JOIN k b ON a.frame = b.frame AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 AND a.id <> b.id),
w AS (SELECT id, id AS reach FROM k UNION SELECT e.t, w.reach FROM w JOIN e ON e.s = w.id WHERE w.reach < e.t), m AS (SELECT id, min(reach) AS comp FROM w GROUP BY id)
SELECT comp AS component, count(*) AS pixels, min(row) AS row_lo, max(row) AS row_hi, min(col) AS col_lo, max(col) AS col_hi FROM m JOIN k USING (id) GROUP BY comp""")
def pixel_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight-connected components of occupied cells, with their boxes."""
    c = points(spark, sf_dir).select("frame", C.floor_bin(F.col("d"), 0.4).alias("row"), C.floor_bin(F.col("l"), 0.1).alias("col")).distinct()
    m = components_within(c, 1)
    return m.groupBy("component").agg(F.count(F.lit(1)).alias("pixels"), F.min("row").alias("row_lo"), F.max("row").alias("row_hi"), F.min("col").alias("col_lo"), F.max("col").alias("col_hi"))


def _bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = points(spark, sf_dir).select("frame", C.floor_bin(F.col("d"), 4.0).alias("bin"), "h")
    return p.groupBy("frame", "bin").agg(F.percentile("h", 0.2).alias("y"), F.least(F.count(F.lit(1)), F.lit(500)).cast("double").alias("w"))


@query()
def gated_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins accepted from near to far by extrapolation of the last accepted."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("bin")
        return g[["frame", "bin"]].assign(accepted=robust.gated_chain(g["bin"].to_numpy() * 1.0, g["y"].to_numpy(), 0.3 + 1e-9))

    return _bins(spark, sf_dir).groupBy("frame").applyInPandas(one, "frame long, bin long, accepted boolean")


@query()
def motion_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shift of each frame of a recording: the least-cost path over a grid of shifts."""
    c = frames(spark, sf_dir).select("bag", "i", "dist", "k")

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("i")
        shifts = np.arange(16) * 32.0
        cost = np.abs(g["dist"].to_numpy()[:, None] - shifts[None, :]) / 32.0
        return g[["bag", "i"]].assign(shift=robust.best_path(cost, 0.5))

    return c.groupBy("bag").applyInPandas(one, "bag long, i long, shift long")


@query()
def linked_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of a recording linked over frames, nearest pairs first; a gap counts frames."""
    c = frames(spark, sf_dir).where("status = 'detected'").select("bag", "i", F.col("dist").alias("d"), ((F.col("k") % 5) * 0.3).alias("l"))

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("i")
        ids = robust.link([[(d, s)] for d, s in zip(g["d"], g["l"], strict=True)], 25.0, 25, g["i"].tolist())
        return g[["bag", "i"]].assign(track=[x[0] for x in ids])

    return c.groupBy("bag").applyInPandas(one, "bag long, i long, track long")


#: The same by recursion over a recording's detections, with the tracks in a list.
ORACLE_SQL["linked_components"] = f"""WITH RECURSIVE {FR}, c AS (SELECT bag, i, dist AS d, (k % 5) * 0.3e0 AS l, row_number() OVER (PARTITION BY bag ORDER BY i) AS n FROM fr WHERE status = 'detected'),
a AS (SELECT bag, 0::BIGINT AS n, 0::BIGINT AS i, []::STRUCT(id BIGINT, d DOUBLE, l DOUBLE, seen BIGINT)[] AS tr, -1::BIGINT AS track FROM (SELECT DISTINCT bag FROM c)
  UNION ALL SELECT bag, n, i, CASE WHEN best.dist <= 25e0 THEN list_transform(tr, lambda x: CASE WHEN x.id = best.id THEN struct_pack(id := x.id, d := d, l := l, seen := i) ELSE x END) ELSE list_append(tr, struct_pack(id := len(tr), d := d, l := l, seen := i)) END,
    CASE WHEN best.dist <= 25e0 THEN best.id ELSE len(tr) END FROM (
      SELECT c.bag, c.n, c.i, c.d, c.l, a.tr, list_sort(list_transform(list_filter(a.tr, lambda x: c.i - x.seen <= 25), lambda x: struct_pack(dist := sqrt(power(x.d - c.d, 2) + power(x.l - c.l, 2)), id := x.id)))[1] AS best
      FROM a JOIN c ON c.bag = a.bag AND c.n = a.n + 1))
SELECT bag, i, track FROM a WHERE n > 0"""
