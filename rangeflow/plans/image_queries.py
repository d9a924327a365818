"""Queries on range images kept as long tables: components across gaps, bridged fragments, regions, first returns, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import cells as cl
from ..operators.graph import grouped_components
from ..operators.growth import grow_regions
from ..session import discard, written
from .views import PT, points

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Rows and columns of an image lie within half of this about zero, and frames below 2 ** 23.
_SIDE = 1 << 20


def pixel_id(frame: Column | str, row: Column | str, col: Column | str) -> Column:
    """One number a pixel, increasing with frame, row and column; a pixel outside the sides that fit is an error."""
    f, r, c = (F.col(x) if isinstance(x, str) else x for x in (frame, row, col))
    inside = (f >= 0) & (f < 1 << 23) & (F.abs(r) < _SIDE // 2) & (F.abs(c) < _SIDE // 2)
    number = (f.cast("long") * _SIDE + r + _SIDE // 2) * _SIDE + c + _SIDE // 2
    return F.when(f.isNull() | r.isNull() | c.isNull() | inside, number).otherwise(F.raise_error(F.lit("a pixel outside the sides that one number holds")).cast("long"))


_ID = f"((frame * {_SIDE} + row + {_SIDE // 2}) * {_SIDE} + col + {_SIDE // 2})"


def components_within(pixels: DataFrame, reach: int) -> DataFrame:
    """``pixels`` (``frame, row, col`` and more) with ``id`` and ``component``, the least id that steps of ``reach`` cells lead to."""
    k = written(pixels.withColumn("id", pixel_id("frame", "row", "col")), "pixels")
    runs = written(cl.row_runs(k.select("frame", "row", "col", "id"), ["frame"], reach), "runs")
    c = grouped_components(cl.run_links(runs, ["frame"], reach), "frame", "run", "o_run")
    at = runs.select("id", "run").join(c.withColumnRenamed("id", "run"), "run", "left")
    return k.join(at.select("id", F.coalesce("component", "run").alias("component")), "id")


def components_alike(pixels: DataFrame, reach: int, same: Column, seen: list[str]) -> DataFrame:
    """The same where ``same`` holds on both ends of a step too: the columns ``seen``, the neighbour's with a leading ``o_``."""
    k = written(pixels.withColumn("id", pixel_id("frame", "row", "col")), "pixels")
    here = k.select("frame", "row", "col", "id", *seen)
    ahead = [(a, b) for a in range(reach + 1) for b in range(-reach, reach + 1) if (a, b) > (0, 0)]
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ahead])).alias("_s")
    near = here.select("frame", "row", "col", F.col("id").alias("o_id"), *[F.col(c).alias(f"o_{c}") for c in seen], step)
    near = near.withColumn("row", F.col("row") + F.col("_s.a")).withColumn("col", F.col("col") + F.col("_s.b")).drop("_s")
    e = near.join(here, ["frame", "row", "col"]).where(same)
    c = grouped_components(e, "frame", "id", "o_id")
    return k.join(c, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _reach_sql(pixels: str, reach: int, same: str = "true") -> str:
    """CTEs ``m(id, comp)`` of components over ``pixels``."""
    return f"""kk AS (SELECT *, {_ID} AS id FROM {pixels}),
ee AS (SELECT a.id AS s, b.id AS t FROM kk a JOIN kk b ON a.frame = b.frame AND abs(a.row - b.row) <= {reach} AND abs(a.col - b.col) <= {reach} AND a.id <> b.id AND {same}),
ww AS (SELECT id, id AS reach FROM kk UNION SELECT ee.t, ww.reach FROM ww JOIN ee ON ee.s = ww.id WHERE ww.reach < ee.t), m AS (SELECT id, min(reach) AS comp FROM ww GROUP BY id)"""


_CELLS = "c AS (SELECT frame, floor(d / 0.5e0)::BIGINT AS row, floor(l / 0.1e0)::BIGINT AS col, min(r) AS r, count(*) AS px, min(d) AS d0, max(d) AS d1, min(l) AS l0, max(l) AS l1, min(h) AS h0, max(h) AS h1 FROM pt GROUP BY ALL)"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).groupBy("frame", C.floor_bin(F.col("d"), 0.5).alias("row"), C.floor_bin(F.col("l"), 0.1).alias("col")).agg(
        F.min("r").alias("r"), F.count(F.lit(1)).alias("px"), F.min("d").alias("d0"), F.max("d").alias("d1"), F.min("l").alias("l0"), F.max("l").alias("l1"), F.min("h").alias("h0"), F.max("h").alias("h1")
    )


@query(f"""WITH RECURSIVE {PT}, {_CELLS}, {_reach_sql("c", 3)} SELECT comp AS component, count(*) AS pixels, sum(px)::BIGINT AS points, min(row) AS row_lo, max(row) AS row_hi, min(col) AS col_lo, max(col) AS col_hi FROM m JOIN kk USING (id) GROUP BY comp""")
def gap_merged_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of pixels at most two empty cells apart: what dilating by one, labelling and restoring gives."""
    m = components_within(_cells(spark, sf_dir).select("frame", "row", "col", "px"), 3)
    return m.groupBy("component").agg(
        F.count(F.lit(1)).alias("pixels"), F.sum("px").alias("points"), F.min("row").alias("row_lo"), F.max("row").alias("row_hi"), F.min("col").alias("col_lo"), F.max("col").alias("col_hi")
    )


@query(f"""WITH RECURSIVE {PT}, {_CELLS}, {_reach_sql("c", 1)}, f AS (SELECT kk.*, comp AS frag FROM m JOIN kk USING (id)), {_reach_sql("c", 3).replace("kk", "k3").replace("ee", "e3").replace("ww", "w3").replace("m AS", "m3 AS")},
j AS (SELECT f.*, m3.comp AS big FROM f JOIN m3 USING (id)), s AS (SELECT frame, big, frag, count(*) AS n FROM j GROUP BY ALL),
g AS (SELECT frame, big, count(*) AS frags, max(n) AS largest, sum(n)::BIGINT AS total FROM s GROUP BY ALL), x AS (SELECT big, max(d1) - min(d0) AS ext_d, max(l1) - min(l0) AS ext_l, max(h1) - min(h0) AS ext_h, min(h0) AS bottom, median((l0 + l1) / 2) AS centre FROM j GROUP BY big),
v AS (SELECT g.*, largest <= 8 AND total >= 12 AND frags >= 2 AND ext_l >= 0.8e0 AND ext_d <= 30e0 AND ext_h >= 1.5e0 AND bottom <= 1.5e0 AND abs(centre) <= 0.9e0 AS bridged FROM g JOIN x USING (big))
SELECT bridged, count(*) AS components, sum(frags)::BIGINT AS fragments, sum(total)::BIGINT AS pixels, sum(CASE WHEN bridged THEN 1 ELSE frags END)::BIGINT AS labels FROM v GROUP BY bridged""")
def face_bridging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small fragments across gaps that together make a face become one label; all others keep theirs."""
    c = _cells(spark, sf_dir).drop("px")
    frag = components_within(c, 1).withColumnRenamed("component", "frag")
    big = components_within(frag.select("frame", "row", "col"), 3).select("id", F.col("component").alias("big"))
    j = frag.join(big, "id")
    s = j.groupBy("big", "frag").agg(F.count(F.lit(1)).alias("n")).groupBy("big").agg(F.count(F.lit(1)).alias("frags"), F.max("n").alias("largest"), F.sum("n").alias("total"))
    x = j.groupBy("big").agg(
        (F.max("d1") - F.min("d0")).alias("ext_d"), (F.max("l1") - F.min("l0")).alias("ext_l"), (F.max("h1") - F.min("h0")).alias("ext_h"), F.min("h0").alias("bottom"), F.percentile((F.col("l0") + F.col("l1")) / 2, 0.5).alias("centre")
    )
    face = F.expr("largest <= 8 and total >= 12 and frags >= 2 and ext_l >= 0.8D and ext_d <= 30D and ext_h >= 1.5D and bottom <= 1.5D and abs(centre) <= 0.9D")
    v = s.join(x, "big").withColumn("bridged", face)
    return v.groupBy("bridged").agg(F.count(F.lit(1)).alias("components"), F.sum("frags").alias("fragments"), F.sum("total").alias("pixels"), F.sum(F.when(F.col("bridged"), 1).otherwise(F.col("frags"))).alias("labels"))


@query(f"""WITH RECURSIVE {PT}, {_CELLS}, {_reach_sql("c", 2, "(abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 OR NOT EXISTS (SELECT 1 FROM kk z WHERE z.frame = a.frame AND z.row = (a.row + b.row) // 2 AND z.col = (a.col + b.col) // 2))")},
f AS (SELECT kk.*, comp FROM m JOIN kk USING (id)), o AS (SELECT *, r - lag(r) OVER (PARTITION BY comp ORDER BY r, id) AS gap FROM f),
p AS (SELECT *, sum((coalesce(gap, 0) > greatest(1e0, 0.02e0 * r))::INT) OVER (PARTITION BY comp ORDER BY r, id) AS part FROM o)
SELECT comp AS component, part::BIGINT AS part, count(*) AS pixels, round(min(r), 4) AS r_min, round(max(r), 4) AS r_max FROM p GROUP BY ALL""")
def bin_bridging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels joined over an empty bin between them, and the groups cut where sorted ranges jump.

    A bin between two pixels that is not empty is next to both, so it joins them itself: the groups are those of steps of two cells.
    """
    f = components_within(_cells(spark, sf_dir).select("frame", "row", "col", "r"), 2)
    w = Window.partitionBy("component").orderBy("r", "id")
    jump = F.coalesce((F.col("r") - F.lag("r").over(w) > F.greatest(F.lit(1.0), 0.02 * F.col("r"))).cast("long"), F.lit(0).cast("long"))
    p = f.withColumn("jump", jump).withColumn("part", F.sum("jump").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return p.groupBy("component", "part").agg(F.count(F.lit(1)).alias("pixels"), F.round(F.min("r"), 4).alias("r_min"), F.round(F.max("r"), 4).alias("r_max"))


@query(f"""WITH RECURSIVE {PT}, {_CELLS}, s AS (SELECT frame, arg_min(row, r * 1e6 + row * 1000 + col) AS row0, arg_min(col, r * 1e6 + row * 1000 + col) AS col0, min(r) AS r0 FROM c GROUP BY frame),
b AS (SELECT c.* FROM c JOIN s USING (frame) WHERE abs(c.r - r0) <= 0.5e0 + 0.1e0 * r0 AND abs(row - row0) <= 6 AND abs(col - col0) <= 24), {_reach_sql("b", 1)},
o AS (SELECT kk.frame, m.comp FROM m JOIN kk USING (id) JOIN s ON s.frame = kk.frame AND s.row0 = kk.row AND s.col0 = kk.col)
SELECT o.frame, count(*) AS pixels, round(max(d1) - min(d0), 4) AS ext_d, round(max(l1) - min(l0), 4) AS ext_l, max(d1) - min(d0) <= 2.5e0 AND count(*) <= 6 AS straddles FROM o JOIN m ON m.comp = o.comp JOIN kk ON kk.id = m.id GROUP BY o.frame""")
def region_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest pixel's region: connected pixels of its range within a window, and whether it is compact enough to straddle an edge."""
    c = _cells(spark, sf_dir)
    s = c.groupBy("frame").agg(F.min(F.struct("r", "row", "col")).alias("s")).select("frame", F.col("s.r").alias("r0"), F.col("s.row").alias("row0"), F.col("s.col").alias("col0"))
    band = (F.abs(F.col("r") - F.col("r0")) <= 0.5 + 0.1 * F.col("r0")) & (F.abs(F.col("row") - F.col("row0")) <= 6) & (F.abs(F.col("col") - F.col("col0")) <= 24)
    m = components_within(c.join(s, "frame").where(band), 1)
    own = m.where("row = row0 and col = col0").select(F.col("component"))
    g = m.join(own, "component").groupBy("frame").agg(F.count(F.lit(1)).alias("pixels"), (F.max("d1") - F.min("d0")).alias("e"), (F.max("l1") - F.min("l0")).alias("f"))
    return g.select("frame", "pixels", F.round("e", 4).alias("ext_d"), F.round("f", 4).alias("ext_l"), ((F.col("e") <= 2.5) & (F.col("pixels") <= 6)).alias("straddles"))


@query(f"""WITH RECURSIVE {PT}, {_CELLS}, s AS (SELECT frame, arg_min(row, {{'r': r, 'row': row, 'col': col}}) AS row, arg_min(col, {{'r': r, 'row': row, 'col': col}}) AS col FROM c GROUP BY frame),
g AS (SELECT frame, row, col FROM s UNION SELECT c.frame, c.row, c.col FROM g JOIN c ON c.frame = g.frame AND abs(c.row - g.row) <= 2 AND abs(c.col - g.col) <= 2),
x AS (SELECT frame, count(*) AS pixels, sum(px)::BIGINT AS points, max(l1) - min(l0) AS ext FROM g JOIN c USING (frame, row, col) GROUP BY frame)
SELECT frame, CASE WHEN ok THEN pixels END AS pixels, CASE WHEN ok THEN points END AS points, CASE WHEN ok THEN round(ext, 4) END AS ext_l FROM (SELECT *, ext <= 1e0 AND points <= 3000 AS ok FROM x)""")
def frontier_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth from the nearest pixel by fronts until none is left; a region that gets wide or large runs into structure and gives nothing."""
    c = written(_cells(spark, sf_dir), "cells")
    front = c.groupBy("frame").agg(F.min(F.struct("r", "row", "col")).alias("s")).select("frame", F.col("s.row").alias("row"), F.col("s.col").alias("col"))
    front, before = written(front, "grown"), None
    lo_hi = lambda f: f.join(c, ["frame", "row", "col"]).groupBy("frame").agg(F.count(F.lit(1)).alias("pixels"), F.sum("px").alias("points"), F.min("l0").alias("lo"), F.max("l1").alias("hi"))
    found = written(lo_hi(front), "grown-found")
    ext = F.col("hi") - F.col("lo")
    ok = (ext <= 1.0) & (F.col("points") <= 3000)
    while True:
        wide = cl.neighbour_cells(front.join(found.where(ok).select("frame"), "frame", "left_semi"), "row", "col", 2, own=False).distinct()
        # what is near a front was reached with it, with the front before, or not at all
        seen = front if before is None else front.unionByName(before)
        new = written(wide.join(c.select("frame", "row", "col"), ["frame", "row", "col"], "left_semi").join(seen, ["frame", "row", "col"], "left_anti"), "grown")
        if before is not None:
            discard(before)
        before, front = front, new
        if new.isEmpty():
            break
        both = found.unionByName(lo_hi(new)).groupBy("frame").agg(F.sum("pixels").alias("pixels"), F.sum("points").alias("points"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        last, found = found, written(both, "grown-found")
        discard(last)
    discard(before, front)
    return found.select("frame", F.when(ok, F.col("pixels")).alias("pixels"), F.when(ok, F.col("points")).alias("points"), F.when(ok, F.round(ext, 4)).alias("ext_l"))


@query(f"""WITH RECURSIVE {PT}, {_CELLS}, i AS (SELECT frame, row, col, r FROM c WHERE r > 46), {_reach_sql("i", 2, "abs(a.r - b.r) < 1e0")} SELECT comp AS component, count(*) AS pixels, round(min(r), 4) AS r_min, round(max(r), 4) AS r_max FROM m JOIN kk USING (id) GROUP BY comp""")
def insertion_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserted pixels joined within two rows and columns where their ranges differ by less than a metre."""
    i = _cells(spark, sf_dir).select("frame", "row", "col", "r").where("r > 46")
    m = components_alike(i, 2, F.abs(F.col("r") - F.col("o_r")) < 1.0, ["r"])
    return m.groupBy("component").agg(F.count(F.lit(1)).alias("pixels"), F.round(F.min("r"), 4).alias("r_min"), F.round(F.max("r"), 4).alias("r_max"))


@query(f"""WITH {PT} SELECT frame, slot % 40 AS row, (slot // 40) % 8 AS col, min(slot) AS first_slot, count(*) AS returns, arg_min(d, slot) AS d FROM pt WHERE r > 2 GROUP BY ALL""")
def organised_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An organised image: the first slot of each pixel."""
    ring, col, _ = C.ring_column_firing(F.col("slot"), 40, 8)
    return points(spark, sf_dir).where("r > 2").groupBy("frame", ring.alias("row"), col.alias("col")).agg(F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("returns"), F.min_by("d", "slot").alias("d"))


@query(f"""WITH {PT}, b AS (SELECT flag, CASE WHEN d = 200 THEN 9 ELSE floor(d / 20)::BIGINT END AS i, CASE WHEN l = 1 THEN 4 ELSE floor((l + 1) / 0.4e0)::BIGINT END AS j FROM pt WHERE d BETWEEN 0 AND 200 AND l BETWEEN -1 AND 1)
SELECT flag, i, {", ".join(f"count(*) FILTER (j = {j}) AS l{j}" for j in range(5))}, count(*) AS total FROM b GROUP BY ALL""")
def histogram_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by distance and side; the last bin of each axis is closed at both ends."""
    p = points(spark, sf_dir).where("d between 0 and 200 and l between -1 and 1")
    i, j = C.histogram_bin(F.col("d"), 0.0, 200.0, 10), C.histogram_bin(F.col("l"), -1.0, 1.0, 5)
    return p.groupBy("flag", i.alias("i")).agg(*[F.count_if(j == k).alias(f"l{k}") for k in range(5)], F.count(F.lit(1)).alias("total"))


@query(f"""WITH {PT}, a AS (SELECT frame, floor(d / 5)::BIGINT AS bin, d, l, h FROM pt WHERE abs(l) < 0.9e0), q AS (SELECT frame, bin, quantile_cont(d, 0.05) AS near, count(*) AS n FROM a GROUP BY ALL HAVING count(*) >= 8),
s AS (SELECT a.frame, a.bin, count(*) AS n, max(l) - min(l) AS width, max(h) - min(h) AS height FROM a JOIN q USING (frame, bin) WHERE d <= near + 1e0 GROUP BY ALL)
SELECT frame, count(*) AS bins, count(*) FILTER (n >= 5 AND width >= 0.8e0 AND height >= 1e0) AS faces, min(bin * 5) FILTER (n >= 5 AND width >= 0.8e0 AND height >= 1e0) AS face_at FROM s GROUP BY frame""")
def face_veto(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins whose nearest slab is wide and high: a face across the corridor."""
    a = points(spark, sf_dir).where("abs(l) < 0.9D").select("frame", C.floor_bin(F.col("d"), 5.0).alias("bin"), "d", "l", "h")
    q = a.groupBy("frame", "bin").agg(F.percentile("d", 0.05).alias("near"), F.count(F.lit(1)).alias("c")).where("c >= 8")
    s = a.join(q, ["frame", "bin"]).where("d <= near + 1D").groupBy("frame", "bin").agg(F.count(F.lit(1)).alias("n"), (F.max("l") - F.min("l")).alias("width"), (F.max("h") - F.min("h")).alias("height"))
    face = F.expr("n >= 5 and width >= 0.8D and height >= 1D")
    return s.groupBy("frame").agg(F.count(F.lit(1)).alias("bins"), F.count_if(face).alias("faces"), F.min(F.when(face, F.col("bin") * 5)).alias("face_at"))


@query(f"""WITH {PT}, c AS (SELECT frame, floor(d / 10)::BIGINT AS row, floor(l / 0.25e0)::BIGINT AS col, min(r) AS r FROM pt GROUP BY ALL), s AS (SELECT frame, row, col FROM c WHERE r > 40),
x AS (SELECT s.frame, s.row, s.col, arg_min(c.r, c.row - s.row) AS above, min(c.row - s.row) AS steps FROM s LEFT JOIN c ON c.frame = s.frame AND c.col = s.col AND c.row > s.row AND c.row <= s.row + 4 AND c.r <= 40 GROUP BY ALL)
SELECT frame, row, col, coalesce(above, -1e0) AS above, coalesce(steps, -1)::BIGINT AS steps FROM x""")
def first_valid_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first valid cell above in the same column, within four rows."""
    c = points(spark, sf_dir).groupBy("frame", C.floor_bin(F.col("d"), 10.0).alias("row"), C.floor_bin(F.col("l"), 0.25).alias("col")).agg(F.min("r").alias("r"))
    s = c.where("r > 40").select("frame", "row", "col")
    steps = s.withColumn("steps", F.explode(F.array(*[F.lit(k).cast("long") for k in range(1, 5)]))).withColumn("at", F.col("row") + F.col("steps"))
    hit = steps.join(c.where("r <= 40").select("frame", "col", F.col("row").alias("at"), "r"), ["frame", "col", "at"])
    best = hit.groupBy("frame", "row", "col").agg(F.min_by("r", "steps").alias("above"), F.min("steps").alias("steps"))
    return s.join(best, ["frame", "row", "col"], "left").fillna(-1.0, ["above"]).fillna(-1, ["steps"]).select("frame", "row", "col", "above", "steps")


#: Growth in space: radius and its slope by distance, the widest compact object, the most points of one.
GROW, GROW_SLOPE, COMPACT, MOST = 0.45, 0.002, 2.5, 12


@query(f"""WITH RECURSIVE {PT}, s AS (SELECT frame, slot AS region, {GROW}e0 + {GROW_SLOPE}e0 * d AS radius FROM pt WHERE r >= 49),
e AS (SELECT a.frame, a.slot AS s, b.slot AS t, power(b.d - a.d, 2) + power(b.l - a.l, 2) + power(b.h - a.h, 2) AS far FROM pt a JOIN pt b ON a.frame = b.frame AND abs(a.d - b.d) <= 1 AND a.slot <> b.slot),
g AS (SELECT frame, region, radius, region AS point FROM s UNION SELECT g.frame, g.region, g.radius, e.t FROM g JOIN e ON e.frame = g.frame AND e.s = g.point AND e.far <= g.radius * g.radius),
x AS (SELECT g.frame, region, count(*) AS n, max(d) - min(d) AS ed, max(l) - min(l) AS el, max(h) - min(h) AS eh FROM g JOIN pt ON pt.frame = g.frame AND pt.slot = g.point GROUP BY ALL)
SELECT frame, region, CASE WHEN ok THEN n END AS points, CASE WHEN ok THEN round(ed, 4) END AS ext_d, CASE WHEN ok THEN round(el, 4) END AS ext_l, CASE WHEN ok THEN round(eh, 4) END AS ext_h FROM (SELECT *, greatest(ed, el, eh) <= {COMPACT}e0 AND n <= {MOST} AS ok FROM x)""")
def compact_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions grown from every strong point through all points near them, to their end or past the limits of a compact object."""
    p = points(spark, sf_dir)
    s = p.where("r >= 49")
    box = [F.lit(None).cast("double").alias(f"{c}_{e}") for c in "dlh" for e in ("lo", "hi")]
    regions = s.select("frame", F.col("slot").alias("region"), (GROW + GROW_SLOPE * F.col("d")).alias("radius"), *box)
    g = grow_regions(p.withColumnRenamed("slot", "point"), regions, s.select("frame", F.col("slot").alias("region"), F.col("slot").alias("point")), "frame", 1.0, COMPACT, MOST)
    ok = F.col("ext_d").isNotNull()
    return g.select("frame", "region", F.when(ok, F.col("n")).alias("points"), *[F.round(f"ext_{c}", 4).alias(f"ext_{c}") for c in "dlh"])
