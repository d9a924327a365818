"""Queries of running a pipeline: budgets, profiles, markers, layouts, beam models, object metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import islands as isl
from ..streaming.folds import stream_gaps
from . import stream_queries
from .state_queries import run_stream
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


@query(f"""WITH {FR}, s AS (SELECT bag, i, dist > 300 AS slow, k % 17 = 0 AS failed, i % 3 = 0 AS turn FROM fr), t AS (SELECT *, slow AND coalesce(lag(slow, 1) OVER w, false) AND coalesce(lag(slow, 2) OVER w, false) AS third, sum(failed::INT) OVER (PARTITION BY bag ORDER BY i) AS failures FROM s WINDOW w AS (PARTITION BY bag ORDER BY i)),
o AS (SELECT *, coalesce(max((third OR failures >= 3)::INT) OVER (PARTITION BY bag ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS off FROM t)
SELECT bag, min(i) FILTER (off) AS off_from, count(*) FILTER (NOT off AND turn) AS runs, max(failures)::BIGINT AS failures, CASE WHEN count(*) FILTER (off) = 0 THEN 'on' WHEN max(failures) FILTER (NOT off) >= 3 THEN 'failures' ELSE 'slow' END AS why FROM o GROUP BY bag""")
def network_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a stage that may be left out is: after three slow frames in a row or so many failures; until then it runs every third frame."""
    w = isl.by(["bag"], ["i"])
    s = frames(spark, sf_dir).select("bag", "i", (F.col("dist") > 300).alias("slow"), (F.col("k") % 17 == 0).cast("long").alias("failed"))
    before = lambda k: F.coalesce(F.lag("slow", k).over(w), F.lit(False))
    t = s.withColumn("third", F.col("slow") & before(1) & before(2)).withColumn("failures", F.sum("failed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    o = t.withColumn("off", F.coalesce(F.max(F.col("third") | (F.col("failures") >= 3)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    off = F.col("off")
    why = F.when(F.count_if(off) == 0, "on").when(F.max(F.when(~off, F.col("failures"))) >= 3, "failures").otherwise("slow")
    return o.groupBy("bag").agg(F.min(F.when(off, F.col("i"))).alias("off_from"), F.count_if(~off & (F.col("i") % 3 == 0)).alias("runs"), F.max("failures").alias("failures"), why.alias("why"))


@query(f"""WITH {PT}, m AS (SELECT frame, flag, count(*) AS n, max(slot) % 3 AS step FROM pt GROUP BY frame, flag), p AS (SELECT flag, n, step, min(frame) AS profile FROM m WHERE frame % 2 = 0 GROUP BY ALL), q AS (SELECT flag, step, min(frame) AS profile FROM m WHERE frame % 2 = 0 GROUP BY ALL)
SELECT m.frame, m.flag, coalesce(p.profile, q.profile, -1) AS profile, CASE WHEN p.profile IS NOT NULL THEN 'exact' WHEN q.profile IS NOT NULL THEN 'loose' ELSE 'new' END AS found FROM m LEFT JOIN p USING (flag, n, step) LEFT JOIN q USING (flag, step)""")
def profile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream's profile by its whole signature, else by what of it does not vary from message to message."""
    m = points(spark, sf_dir).groupBy("frame", "flag").agg(F.count(F.lit(1)).alias("n"), (F.max("slot") % 3).alias("step"))
    known = m.where("frame % 2 = 0")
    exact, loose = (known.groupBy(*k).agg(F.min("frame").alias(a)) for k, a in ((["flag", "n", "step"], "exact"), (["flag", "step"], "loose")))
    j = m.join(exact, ["flag", "n", "step"], "left").join(loose, ["flag", "step"], "left")
    found = F.when(F.col("exact").isNotNull(), "exact").when(F.col("loose").isNotNull(), "loose").otherwise("new")
    return j.select("frame", "flag", F.coalesce("exact", "loose", F.lit(-1).cast("long")).alias("profile"), found.alias("found"))


@query(f"""WITH {FR}, s AS (SELECT bag, i, dist / 5000e0 AS l0, k * 1e-5 AS b, unnest(range(0, 60)) AS j FROM fr WHERE k % 4 <> 0), c AS (SELECT *, 5e0 + j * 2.5e0 AS d FROM s), e AS (SELECT *, l0 + b * d * d - (1.4e0 - 0.003e0 * d) AS lo, l0 + b * d * d + (1.4e0 - 0.003e0 * d) AS hi FROM c)
SELECT bag, i, count(*) AS samples, round(max(hi), 9) AS right_edge, round(min(lo), 9) AS left_edge, round(sum(hi - lo) * 2.5e0, 4) AS area FROM e GROUP BY bag, i""")
def corridor_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corridor's outline as sixty samples along each frame's model, as a display would draw it."""
    s = frames(spark, sf_dir).where("k % 4 <> 0").select("bag", "i", (F.col("dist") / 5000.0).alias("l0"), (F.col("k") * 1e-5).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(59))).alias("j"))
    d = 5.0 + F.col("j") * 2.5
    c = s.withColumn("d", d)
    centre, half = F.col("l0") + F.col("b") * F.col("d") * F.col("d"), 1.4 - 0.003 * F.col("d")
    e = c.withColumn("lo", centre - half).withColumn("hi", centre + half)
    return e.groupBy("bag", "i").agg(F.count(F.lit(1)).alias("samples"), F.round(F.max("hi"), 9).alias("right_edge"), F.round(F.min("lo"), 9).alias("left_edge"), F.round(F.sum(F.col("hi") - F.col("lo")) * 2.5, 4).alias("area"))


@query(f"""WITH {PT}, a AS (SELECT frame, slot, slot % 40 AS ring, slot // 40 AS col, d FROM pt), n AS (SELECT frame, max(col) + 1 AS cols FROM a GROUP BY frame), b AS (SELECT a.*, ring * cols + col AS by_ring, (ring * 2048 + col) * 64 + slot % 2 AS packed FROM a JOIN n USING (frame))
SELECT frame, count(*) AS n, max(by_ring) AS last_place, arg_min(slot, by_ring) AS first_slot, arg_max(slot, packed) AS last_packed, bool_and(packed // 64 // 2048 = ring AND packed // 64 % 2048 = col AND packed % 64 = slot % 2) AS back FROM b GROUP BY frame""")
def message_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cloud in the two layouts of sensors: rings one after the other, and packed keys of line, index and flags, and back."""
    ring, col = F.col("slot") % 40, F.floor(F.col("slot") / 40).cast("long")
    a = points(spark, sf_dir).select("frame", "slot", ring.alias("ring"), col.alias("col"))
    b = a.withColumn("cols", F.max("col").over(Window.partitionBy("frame")) + 1)
    b = b.withColumn("by_ring", F.col("ring") * F.col("cols") + F.col("col")).withColumn("packed", (F.col("ring") * 2048 + F.col("col")) * 64 + F.col("slot") % 2)
    back = F.expr("packed div 64 div 2048 = ring and packed div 64 % 2048 = col and packed % 64 = slot % 2")
    return b.groupBy("frame").agg(F.count(F.lit(1)).alias("n"), F.max("by_ring").alias("last_place"), F.min_by("slot", "by_ring").alias("first_slot"), F.max_by("slot", "packed").alias("last_packed"), F.bool_and(back).alias("back"))


@query(f"""WITH {PT}, b AS (SELECT slot % 16 AS ring, slot // 16 AS col, degrees(atan2(l, d)) AS az, degrees(asin(h / sqrt(d * d + l * l + h * h))) AS el FROM pt WHERE d > 5),
f AS (SELECT ring, count(*) AS n, regr_slope(az, col) AS slope, regr_intercept(az, col) AS start, median(el) AS el FROM b GROUP BY ring HAVING count(*) >= 30), r AS (SELECT f.*, median(b.az - (start + slope * b.col)) AS shift, avg(abs(b.az - (start + slope * b.col))) AS miss FROM f JOIN b USING (ring) GROUP BY ALL)
SELECT ring, n, round(slope, 7) AS slope, round(start, 5) AS start, round(el, 5) AS elevation, round(shift, 5) AS shift, round(miss, 5) AS miss FROM r""")
def beam_model_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ring's azimuth over its columns as a line, the shift of its beams from it, and its elevation."""
    d, s, h = F.col("d"), F.col("l"), F.col("h")
    b = points(spark, sf_dir).where("d > 5").select((F.col("slot") % 16).alias("ring"), F.floor(F.col("slot") / 16).cast("double").alias("col"), C.azimuth_deg(d, s).alias("az"), C.elevation_deg(h, C.range_of(d, s, h)).alias("el"))
    f = b.groupBy("ring").agg(F.count(F.lit(1)).alias("n"), F.regr_slope("az", "col").alias("slope"), F.regr_intercept("az", "col").alias("start"), F.percentile("el", 0.5).alias("el")).where("n >= 30")
    miss = F.col("az") - (F.col("start") + F.col("slope") * F.col("col"))
    r = b.drop("el").join(f, "ring").groupBy("ring", "n", "slope", "start", "el").agg(F.percentile(miss, 0.5).alias("shift"), F.avg(F.abs(miss)).alias("miss"))
    return r.select("ring", "n", F.round("slope", 7).alias("slope"), F.round("start", 5).alias("start"), F.round("el", 5).alias("elevation"), F.round("shift", 5).alias("shift"), F.round("miss", 5).alias("miss"))


_OBJECTS = f"p AS (SELECT frame, CASE WHEN slot % 40 < 12 THEN slot // 40 ELSE -1 END AS obj, slot // 40 % 4 = 3 AS dust, r > 38 AS pred, d, floor(d / 10)::BIGINT AS cell FROM pt), o AS (SELECT frame, obj, dust, min(d) AS near, count(*) FILTER (pred) AS hits, count(*) AS px FROM p WHERE obj >= 0 GROUP BY ALL), b AS (SELECT *, {band_sql('near')} AS band FROM o)"


def _objects(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    block = F.floor(F.col("slot") / 40).cast("long")
    p = points(spark, sf_dir).select("frame", F.when(F.col("slot") % 40 < 12, block).otherwise(F.lit(-1).cast("long")).alias("obj"), (block % 4 == 3).alias("dust"), (F.col("r") > 38).alias("pred"), "d", C.floor_bin(F.col("d"), 10.0).alias("cell"))
    o = p.where("obj >= 0").groupBy("frame", "obj", "dust").agg(F.min("d").alias("near"), F.count_if("pred").alias("hits"), F.count(F.lit(1)).alias("px"))
    return p, o.withColumn("band", C.band_label(F.col("near")))


@query(f"""WITH {PT}, {_OBJECTS} SELECT band, count(*) FILTER (NOT dust) AS objects, count(*) FILTER (NOT dust AND hits >= 3) AS found, round(count(*) FILTER (NOT dust AND hits >= 3) / nullif(count(*) FILTER (NOT dust), 0)::DOUBLE, 6) AS recall,
  count(*) FILTER (dust) AS dust, count(*) FILTER (dust AND hits >= 3) AS dust_as_obstacle FROM b GROUP BY band""")
def object_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects found by the band of their nearest point, and dust taken for obstacles."""
    _, b = _objects(spark, sf_dir)
    solid, found = ~F.col("dust"), F.col("hits") >= 3
    return b.groupBy("band").agg(
        F.count_if(solid).alias("objects"), F.count_if(solid & found).alias("found"), F.round(F.count_if(solid & found) / F.nullif(F.count_if(solid), F.lit(0)), 6).alias("recall"), F.count_if(~solid).alias("dust"), F.count_if(~solid & found).alias("dust_as_obstacle")
    )


@query(f"""WITH {PT}, {_OBJECTS}, f AS (SELECT count(*) AS fp FROM (SELECT frame, cell FROM p GROUP BY frame, cell HAVING bool_and(obj < 0 OR NOT pred) AND count(*) FILTER (pred) >= 6)), n AS (SELECT count(DISTINCT frame) AS n FROM pt),
r AS (SELECT band, count(*) FILTER (hits >= 3) / count(*)::DOUBLE AS recall FROM b WHERE NOT dust AND near >= 20 GROUP BY band HAVING count(*) >= 5)
SELECT (SELECT count(*) FROM r) AS bands, fp, round((SELECT avg(recall) FROM r) - least(1e0, fp / n::DOUBLE), 6) AS score FROM f, n""")
def selection_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's score: mean recall of the bands from 20 m on with enough objects, less false components a frame.  Two rows of figures are joined."""
    p, b = _objects(spark, sf_dir)
    cells = p.groupBy("frame", "cell").agg(F.bool_and((F.col("obj") < 0) | ~F.col("pred")).alias("free"), F.count_if("pred").alias("px"))
    f = cells.agg(F.count_if(F.col("free") & (F.col("px") >= 6)).alias("fp"), F.count_distinct("frame").alias("n"))
    r = b.where("not dust and near >= 20").groupBy("band").agg(F.count_if(F.col("hits") >= 3).alias("found"), F.count(F.lit(1)).alias("c")).where("c >= 5").agg(F.count(F.lit(1)).alias("bands"), F.avg(F.col("found") / F.col("c")).alias("recall"))
    return f.join(F.broadcast(r), how="cross").select("bands", "fp", F.round(F.col("recall") - F.least(F.lit(1.0), F.col("fp") / F.col("n")), 6).alias("score"))


@query(f"""WITH {PT}, a AS (SELECT frame, slot % 40 AS row, slot // 40 AS col, r, h FROM pt WHERE r > 4), g AS (SELECT DISTINCT frame FROM pt), w AS (SELECT frame, rw AS row, cl AS col FROM g, (SELECT unnest(range(8, 24)) AS rw), (SELECT unnest(range(2, 10)) AS cl))
SELECT w.frame, count(*) AS pixels, count(*) FILTER (a.r IS NULL) AS filled, round(sum(coalesce(a.r, 0e0)), 4) AS ranges, round(avg(coalesce(a.h, -1e0)), 8) AS heights FROM w LEFT JOIN a USING (frame, row, col) GROUP BY w.frame""")
def native_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block of an organised image as it is, missing pixels filled."""
    p = points(spark, sf_dir)
    a = p.where("r > 4").select("frame", (F.col("slot") % 40).alias("row"), F.floor(F.col("slot") / 40).cast("long").alias("col"), "r", "h")
    span = lambda lo, hi: F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(hi - 1).cast("long")))
    w = p.select("frame").distinct().withColumn("row", span(8, 24)).withColumn("col", span(2, 10))
    return w.join(a, ["frame", "row", "col"], "left").groupBy("frame").agg(
        F.count(F.lit(1)).alias("pixels"), F.count_if(F.col("r").isNull()).alias("filled"), F.round(F.sum(F.coalesce("r", F.lit(0.0))), 4).alias("ranges"), F.round(F.avg(F.coalesce("h", F.lit(-1.0))), 8).alias("heights")
    )


@query(stream_queries.ORACLE_SQL["stale_ticks"])
def stale_ticks_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of silence as a stream: the last stamp of each recording is the state."""
    src = frames(spark, sf_dir).select("bag", "i", "t").repartition(4, "bag").sortWithinPartitions("bag", "i")
    return run_stream(spark, src, lambda s: stream_gaps(s, "bag", "i", "t", 43_200_000_000))


@query(f"""WITH {FR}, f AS (SELECT bag % 10 AS scene, bag, i FROM fr WHERE status = 'detected' AND event_type <> 'purchase' AND dist > 100), o AS (SELECT *, lag(i) OVER w AS last_i, lag(bag) OVER w AS last_bag FROM f WINDOW w AS (PARTITION BY scene ORDER BY bag, i)),
e AS (SELECT *, (last_i IS NULL OR last_bag <> bag OR i - last_i > 2)::INT AS new FROM o), n AS (SELECT *, sum(new) OVER (PARTITION BY scene ORDER BY bag, i) AS episode FROM e)
SELECT scene, episode::BIGINT AS episode, bag, min(i) AS first_i, max(i) AS last_i, count(*) AS frames FROM n GROUP BY scene, episode, bag""")
def fp_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False alarms in episodes: a new one where the recording changes or more than two frames lie between."""
    f = frames(spark, sf_dir).where("status = 'detected' and event_type <> 'purchase' and dist > 100").select((F.col("bag") % 10).alias("scene"), "bag", "i")
    w = Window.partitionBy("scene").orderBy("bag", "i")
    new = F.coalesce(((F.lag("bag").over(w) != F.col("bag")) | (F.col("i") - F.lag("i").over(w) > 2)).cast("long"), F.lit(1).cast("long"))
    n = f.withColumn("new", new).withColumn("episode", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return n.groupBy("scene", "episode", "bag").agg(F.min("i").alias("first_i"), F.max("i").alias("last_i"), F.count(F.lit(1)).alias("frames"))


@query(f"""WITH {PT}, b AS (SELECT frame, floor(d / 5)::BIGINT AS bin, h, row_number() OVER (PARTITION BY frame, floor(d / 5) ORDER BY h) - 1 AS i, count(*) OVER (PARTITION BY frame, floor(d / 5)) AS n FROM pt WHERE h > 1.2e0)
SELECT frame, bin, max(n) AS n, round(max(h) FILTER (i = floor((n - 1) * 0.9e0)), 6) AS top, round(sqrt(least(max(n), 200)), 6) AS weight FROM b GROUP BY frame, bin HAVING max(n) >= 4""")
def ceiling_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ceiling's height in bins of 5 m by the floor-index quantile, weighted by the root of its points."""
    from ..operators.quantiles import rank_quantiles

    p = points(spark, sf_dir).where("h > 1.2D").select("frame", C.floor_bin(F.col("d"), 5.0).alias("bin"), "h")
    q = rank_quantiles(p, ["frame", "bin"], "h", {"top": (0.9, "floor")}).where("n >= 4")
    return q.select("frame", "bin", "n", F.round("top", 6).alias("top"), F.round(F.sqrt(F.least(F.col("n"), F.lit(200))), 6).alias("weight"))


@query(f"""WITH {FR} SELECT bag, i, '{{"frame_index":' || i::VARCHAR || ',"status":"' || status || '"' || CASE WHEN k % 7 <> 0 THEN ',"distance_cm":' || round_even(dist * 100, 0)::BIGINT::VARCHAR ELSE '' END || ',"confirmed":' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END || '}}' AS line FROM fr""")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as JSON objects: numbers rounded half to even, NaN and missing values left out."""
    fr = frames(spark, sf_dir)
    dist = F.when(F.col("k") % 7 != 0, F.col("dist")).otherwise(F.lit(float("nan")))
    cm = F.when(~F.isnan(dist), F.rint(dist * 100).cast("long"))
    line = F.to_json(F.struct(F.col("i").alias("frame_index"), "status", cm.alias("distance_cm"), (F.col("k") % 2 == 0).alias("confirmed")))
    return fr.select("bag", "i", line.alias("line"))


@query(f"""WITH {PT}, e AS (SELECT frame, slot, d, h, r, coalesce(lead(d) OVER w - d, 0e0) AS ahead, coalesce(d - lag(d) OVER w, 0e0) AS behind FROM pt WINDOW w AS (PARTITION BY frame, slot % 40 ORDER BY slot)),
m AS (SELECT *, greatest(abs(ahead), abs(behind)) BETWEEN 0.5e0 AND 40e0 AND r % 4 = 1 AS mixed, CASE WHEN abs(ahead) >= abs(behind) THEN d + ahead ELSE d - behind END AS other FROM e)
SELECT frame, count(*) FILTER (mixed) AS mixed, round(sum(CASE WHEN mixed THEN 0.5e0 * (d + other) ELSE d END), 6) AS ranges FROM m GROUP BY frame""")
def mixed_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels at depth edges between neighbours of a ring, some of which return a range between both surfaces."""
    w = Window.partitionBy("frame", F.col("slot") % 40).orderBy("slot")
    p = points(spark, sf_dir).select("frame", "slot", "d", "r", F.coalesce(F.lead("d").over(Window.partitionBy("frame", F.col("slot") % 40).orderBy("slot")) - F.col("d"), F.lit(0.0)).alias("ahead"), F.coalesce(F.col("d") - F.lag("d").over(w), F.lit(0.0)).alias("behind"))
    mixed = F.greatest(F.abs("ahead"), F.abs("behind")).between(0.5, 40.0) & (F.col("r") % 4 == 1)
    other = F.when(F.abs("ahead") >= F.abs("behind"), F.col("d") + F.col("ahead")).otherwise(F.col("d") - F.col("behind"))
    return p.groupBy("frame").agg(F.count_if(mixed).alias("mixed"), F.round(F.sum(F.when(mixed, 0.5 * (F.col("d") + other)).otherwise(F.col("d"))), 6).alias("ranges"))


@query(f"""WITH {PT}, g AS (SELECT frame, floor(d / 3)::BIGINT AS cell, count(*) AS n, max(l) - min(l) AS w, max(h) - min(h) AS t, max(d) - min(d) AS z, min(h) AS bottom FROM pt GROUP BY ALL),
k AS (SELECT *, CASE WHEN n < 3 THEN 'speck' WHEN t >= 1.4e0 AND w <= 0.9e0 AND z <= 1e0 THEN 'person' WHEN w >= 1.5e0 AND t <= 0.9e0 THEN 'pipe' WHEN t <= 0.9e0 AND bottom <= 0.4e0 THEN 'debris' WHEN bottom >= 1.5e0 THEN 'hanging' ELSE 'box' END AS kind FROM g)
SELECT kind, count(*) AS objects, sum(n)::BIGINT AS points, round(avg(t), 5) AS height, round(avg(w), 5) AS width FROM k GROUP BY kind""")
def typed_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components typed by their extents, in an ordered table of cases."""
    span = lambda c: F.max(c) - F.min(c)
    g = points(spark, sf_dir).groupBy("frame", C.floor_bin(F.col("d"), 3.0).alias("cell")).agg(F.count(F.lit(1)).alias("n"), span("l").alias("w"), span("h").alias("t"), span("d").alias("z"), F.min("h").alias("bottom"))
    rules = [("speck", "n < 3"), ("person", "t >= 1.4D and w <= 0.9D and z <= 1D"), ("pipe", "w >= 1.5D and t <= 0.9D"), ("debris", "t <= 0.9D and bottom <= 0.4D"), ("hanging", "bottom >= 1.5D")]
    kind = F.coalesce(*[F.when(F.expr(c), F.lit(n)) for n, c in rules], F.lit("box"))
    return g.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("objects"), F.sum("n").alias("points"), F.round(F.avg("t"), 5).alias("height"), F.round(F.avg("w"), 5).alias("width"))


@query(f"""WITH {FR}, c AS (SELECT bag, i, j, abs(dist / 20e0 - j) + 0.5e0 * power((j - 12) / 6e0, 2) AS cost FROM fr, (SELECT unnest(range(0, 26)) AS j)),
n AS (SELECT *, lag(cost) OVER w AS before, lead(cost) OVER w AS after, row_number() OVER (PARTITION BY bag, i ORDER BY round(cost, 9), j) AS rn FROM c WINDOW w AS (PARTITION BY bag, i ORDER BY j)),
s AS (SELECT bag, i, j + CASE WHEN before IS NULL OR after IS NULL OR before + after - 2 * cost < 1e-9 THEN 0e0 ELSE greatest(-0.5e0, least(0.5e0, 0.5e0 * (before - after) / (before + after - 2 * cost))) END AS shift FROM n WHERE rn = 1)
SELECT bag, count(*) AS frames, round(sum(shift), 5) AS way, round(max(shift), 5) AS most, round(abs(sum(CASE WHEN i % 2 = 0 THEN shift ELSE -shift END)), 5) AS closure FROM s GROUP BY bag""")
def refined_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shift of each frame with a Gaussian prior, refined by the parabola through its neighbours' costs, and how well shifts there and back close."""
    c = frames(spark, sf_dir).select("bag", "i", F.explode(F.sequence(F.lit(0), F.lit(25))).alias("j"), "dist")
    c = c.withColumn("cost", F.abs(F.col("dist") / 20.0 - F.col("j")) + 0.5 * F.pow((F.col("j") - 12) / 6.0, F.lit(2)))
    w = Window.partitionBy("bag", "i").orderBy("j")
    n = c.withColumn("before", F.lag("cost").over(w)).withColumn("after", F.lead("cost").over(w))
    best = n.groupBy("bag", "i").agg(F.min(F.struct(F.round("cost", 9).alias("r"), "j", "cost", "before", "after")).alias("b")).select("bag", "i", "b.*")
    bend = F.col("before") + F.col("after") - 2 * F.col("cost")
    off = F.when(F.col("before").isNull() | F.col("after").isNull() | (bend < 1e-9), 0.0).otherwise(F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (F.col("before") - F.col("after")) / bend)))
    s = best.select("bag", "i", (F.col("j") + off).alias("shift"))
    back = F.sum(F.when(F.col("i") % 2 == 0, F.col("shift")).otherwise(-F.col("shift")))
    return s.groupBy("bag").agg(F.count(F.lit(1)).alias("frames"), F.round(F.sum("shift"), 5).alias("way"), F.round(F.max("shift"), 5).alias("most"), F.round(F.abs(back), 5).alias("closure"))
