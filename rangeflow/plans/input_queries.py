"""Queries of learning inputs, of ordering and limits, and of small conversions and checks of sets."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Thresholds, parse_override
from ..functions import columns as C
from ..operators import islands as isl
from ..operators.match import as_of_nearest
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


_CHANNELS = "x AS (SELECT frame, slot, least(1e0, r / 50e0) AS c_int, greatest(0e0, least(1e0, d / 150e0)) AS c_range, greatest(-1e0, least(1e0, l / 0.8e0)) AS c_side, greatest(-1e0, least(1e0, (h - 1e0) / 2e0)) AS c_up, CASE WHEN r > 2 THEN 1e0 ELSE 0e0 END AS c_valid, greatest(0e0, least(1e0, (1.4e0 - abs(l)) / 1.4e0)) AS c_gauge, exp(-power(h - (0.05e0 + 0.0005e0 * d), 2)) AS c_bed FROM pt)"
_NAMES = ["c_int", "c_range", "c_side", "c_up", "c_valid", "c_gauge", "c_bed"]


@query(f"""WITH {PT}, {_CHANNELS} SELECT frame, {", ".join(f"round(avg({c} * c_valid), 6) AS {c}" for c in _NAMES)} FROM x GROUP BY frame""")
def input_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven channels of a network's input, scaled and clipped, two of them from models; invalid pixels are zero."""
    d, s, h, r = (F.col(c) for c in "dlhr")
    clip = lambda x, lo, hi: F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))
    valid = F.when(r > 2, 1.0).otherwise(0.0)
    bed = h - (0.05 + 0.0005 * d)
    made = [F.least(F.lit(1.0), r / 50.0), clip(d / 150.0, 0, 1), clip(s / 0.8, -1, 1), clip((h - 1.0) / 2.0, -1, 1), valid, clip((1.4 - F.abs(s)) / 1.4, 0, 1), F.exp(-F.pow(bed, 2))]
    return points(spark, sf_dir).groupBy("frame").agg(*[F.round(F.avg(c * valid), 6).alias(n) for n, c in zip(_NAMES, made, strict=True)])


@query(f"""WITH {PT}, s AS (SELECT frame, slot, slot % 5 AS obj FROM pt WHERE slot % 7 = 0), b AS (SELECT unnest(range(0, 5)) AS obj), o AS (SELECT obj, obj % 2 = 0 AS is_obstacle, CASE WHEN obj <> 3 THEN 0.2e0 + obj * 0.2e0 END AS top FROM b),
t AS (SELECT pt.frame, pt.slot, CASE WHEN s.obj IS NULL THEN 0 WHEN o.is_obstacle AND coalesce(top, 9.9e0) >= 0.3e0 THEN 1 WHEN o.is_obstacle THEN 255 ELSE 2 END AS target, coalesce(s.obj, -1) AS objid FROM pt LEFT JOIN s USING (frame, slot) LEFT JOIN o USING (obj))
SELECT frame, count(*) FILTER (target = 1) AS obstacle, count(*) FILTER (target = 2) AS structure, count(*) FILTER (target = 255) AS ignored, max(objid) AS last_object FROM t GROUP BY frame""")
def target_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of pixels by the label of their object: obstacles high enough, low ones ignored, others structure.  Five labels are broadcast."""
    p = points(spark, sf_dir).select("frame", "slot")
    s = p.where("slot % 7 = 0").withColumn("obj", F.col("slot") % 5)
    o = spark.range(5).select(F.col("id").alias("obj"), (F.col("id") % 2 == 0).alias("is_obstacle"), F.when(F.col("id") != 3, 0.2 + F.col("id") * 0.2).alias("top"))
    j = p.join(s, ["frame", "slot"], "left").join(F.broadcast(o), "obj", "left")
    target = F.when(F.col("obj").isNull(), 0).when(F.col("is_obstacle") & (F.coalesce("top", F.lit(9.9)) >= 0.3), 1).when(F.col("is_obstacle"), 255).otherwise(2)
    t = j.withColumn("target", target)
    return t.groupBy("frame").agg(*[F.count_if(F.col("target") == v).alias(n) for n, v in (("obstacle", 1), ("structure", 2), ("ignored", 255))], F.max(F.coalesce("obj", F.lit(-1).cast("long"))).alias("last_object"))


_OPTIONS = {"crop": [64, 256], "history": 3, "label": "v2"}


@query(f"""SELECT l_suppkey AS scene, sha256('{json.dumps(_OPTIONS, sort_keys=True)}' || ':' || l_suppkey::VARCHAR) AS digest, l_suppkey % 3 = 0 OR count(*) <> max(l_suppkey * 0 + 600) AS stale, count(*) AS rows FROM lineitem GROUP BY l_suppkey""")
def cache_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which scenes a feature cache must make again: another digest of options and scene, or not all rows."""
    li = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("scene")).agg(F.count(F.lit(1)).alias("rows"))
    digest = F.sha2(F.concat_ws(":", F.lit(json.dumps(_OPTIONS, sort_keys=True)), F.col("scene").cast("string")), 256)
    cached = li.where("scene % 3 <> 0").select("scene", digest.alias("kept"), F.lit(600).alias("whole"))
    j = li.withColumn("digest", digest).join(cached, "scene", "left")
    return j.select("scene", "digest", F.coalesce((F.col("kept") != F.col("digest")) | (F.col("rows") != F.col("whole")), F.lit(True)).alias("stale"), "rows")


@query(f"""WITH {FR}, s AS (SELECT bag, count(*) AS rows, max(i) + 1 AS wanted, count(*) FILTER (event_type = 'view') AS labels FROM fr WHERE k <> 3 OR bag % 4 <> 0 GROUP BY bag) SELECT bag, rows, wanted - rows AS missing, labels, rows = wanted AND labels > 0 AS complete FROM s""")
def scene_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes found, and which of them are whole: all frames there and labels among them."""
    s = frames(spark, sf_dir).where("k <> 3 or bag % 4 <> 0").groupBy("bag").agg(F.count(F.lit(1)).alias("rows"), (F.max("i") + 1).alias("wanted"), F.count_if(F.col("event_type") == "view").alias("labels"))
    return s.select("bag", "rows", (F.col("wanted") - F.col("rows")).alias("missing"), "labels", ((F.col("rows") == F.col("wanted")) & (F.col("labels") > 0)).alias("complete"))


_SPECS = ["1:0-20", "2", "3:5-9,15-30", "7:40-"]


@query(f"""WITH {FR}, s AS (SELECT unnest({_SPECS}) AS spec), a AS (SELECT split_part(spec, ':', 1)::BIGINT AS bag, unnest(string_split(CASE WHEN contains(spec, ':') THEN split_part(spec, ':', 2) ELSE '0-' END, ',')) AS part FROM s),
r AS (SELECT bag, split_part(part, '-', 1)::BIGINT AS lo, CASE WHEN split_part(part, '-', 2) = '' THEN 1000000 ELSE split_part(part, '-', 2)::BIGINT END AS hi FROM a)
SELECT r.bag, lo, count(fr.i) AS frames, min(fr.i) AS first_i, max(fr.i) AS last_i FROM r LEFT JOIN fr ON fr.bag = r.bag AND fr.i BETWEEN lo AND hi GROUP BY r.bag, lo""")
def negatives_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames named as negatives by texts such as ``3:5-9,15-30``.  The parsed ranges are a few rows, broadcast."""
    s = spark.createDataFrame([(x,) for x in _SPECS], "spec string")
    ranges = F.split(F.when(F.contains("spec", F.lit(":")), F.substring_index("spec", ":", -1)).otherwise(F.lit("0-")), ",")
    a = s.select(F.substring_index("spec", ":", 1).cast("long").alias("bag"), F.explode(ranges).alias("part"))
    end = F.substring_index("part", "-", -1)
    r = a.select("bag", F.substring_index("part", "-", 1).cast("long").alias("lo"), F.when(end == "", F.lit(1_000_000)).otherwise(end.cast("long")).alias("hi"))
    fr = frames(spark, sf_dir).select("bag", "i")
    hit = fr.join(F.broadcast(r), "bag").where("i between lo and hi").groupBy("bag", "lo").agg(F.count("i").alias("frames"), F.min("i").alias("first_i"), F.max("i").alias("last_i"))
    return r.select("bag", "lo").join(hit, ["bag", "lo"], "left").fillna(0, ["frames"])


@query(f"""WITH {PT}, p AS (SELECT frame, slot, d, l, r, 1e0 / (1e0 + exp(-(r - 30e0) / 6e0)) AS prob FROM pt), c AS (SELECT *, floor(d / 3)::BIGINT AS cell FROM p WHERE prob >= 0.5e0), j AS (SELECT *, r - lag(r) OVER (PARTITION BY frame, cell ORDER BY r, slot) AS gap FROM c),
g AS (SELECT *, sum(coalesce(gap > greatest(2e0, 0.05e0 * r), false)::INT) OVER (PARTITION BY frame, cell ORDER BY r, slot) AS part FROM j), s AS (SELECT frame, cell, part, count(*) AS px, avg(prob) AS score, CASE WHEN count(*) >= 10 THEN quantile_cont(r, 0.1) ELSE min(r) END AS dist FROM g GROUP BY ALL HAVING count(*) >= 2),
k AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY round(score, 9) DESC, cell, part) AS rn FROM s) SELECT frame, cell, part::BIGINT AS part, px, round(score, 6) AS score, round(dist, 6) AS dist, rn AS place FROM k WHERE rn <= 5""")
def network_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities to candidates: components cut at range jumps, small ones left out, the five best of a frame."""
    c = points(spark, sf_dir).withColumn("prob", C.logistic((F.col("r") - 30.0) / 6.0)).where("prob >= 0.5D").withColumn("cell", C.floor_bin(F.col("d"), 3.0))
    w = Window.partitionBy("frame", "cell").orderBy("r", "slot")
    jump = F.coalesce((F.col("r") - F.lag("r").over(w) > F.greatest(F.lit(2.0), 0.05 * F.col("r"))).cast("long"), F.lit(0).cast("long"))
    g = c.withColumn("jump", jump).withColumn("part", F.sum("jump").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = g.groupBy("frame", "cell", "part").agg(F.count(F.lit(1)).alias("px"), F.avg("prob").alias("score"), F.when(F.count(F.lit(1)) >= 10, F.percentile("r", 0.1)).otherwise(F.min("r")).alias("dist")).where("px >= 2")
    k = s.withColumn("place", F.row_number().over(Window.partitionBy("frame").orderBy(F.desc(F.round("score", 9)), "cell", "part")).cast("long")).where("place <= 5")
    return k.select("frame", "cell", "part", "px", F.round("score", 6).alias("score"), F.round("dist", 6).alias("dist"), "place")


@query(f"""WITH {PT}, a AS (SELECT frame, slot, floor(d / 5)::BIGINT + (frame * 31) % 5 - 2 AS row, CASE WHEN (frame * 17) % 2 = 0 THEN -l ELSE l END AS side, r * (0.8e0 + ((frame * 13) % 5) * 0.1e0) AS inten, (slot * 7919 + frame * 104729) % 100 < CASE WHEN frame % 4 = 0 THEN 30 ELSE 5 END AS dropped, frame % 3 = 0 AND r < 10 AS dark, frame % 5 = 0 AND slot % 2 = 1 AS hidden FROM pt)
SELECT frame, count(*) FILTER (NOT dropped AND NOT dark AND NOT hidden) AS kept, count(*) FILTER (dark) AS dark, count(*) FILTER (hidden) AS hidden, sum(row) FILTER (NOT dropped AND NOT dark AND NOT hidden)::BIGINT AS rows, round(sum(side) FILTER (NOT dropped AND NOT dark AND NOT hidden), 4) + 0e0 AS side, round(sum(inten) FILTER (NOT dropped AND NOT dark AND NOT hidden), 4) AS intensity FROM a GROUP BY frame""")
def scene_augmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shifts, flips, drops, intensity, dark surfaces and partly hidden objects, drawn from a scene's number."""
    f = F.col("frame")
    dropped = (F.col("slot") * 7919 + f * 104729) % 100 < F.when(f % 4 == 0, 30).otherwise(5)
    dark, hidden = (f % 3 == 0) & (F.col("r") < 10), (f % 5 == 0) & (F.col("slot") % 2 == 1)
    kept = ~dropped & ~dark & ~hidden
    take = lambda c: F.sum(F.when(kept, c))
    return points(spark, sf_dir).groupBy("frame").agg(
        F.count_if(kept).alias("kept"), F.count_if(dark).alias("dark"), F.count_if(hidden).alias("hidden"), take(C.floor_bin(F.col("d"), 5.0) + (f * 31) % 5 - 2).alias("rows"),
        (F.round(take(F.when((f * 17) % 2 == 0, -F.col("l")).otherwise(F.col("l"))), 4) + 0.0).alias("side"), F.round(take(F.col("r") * (0.8 + ((f * 13) % 5) * 0.1)), 4).alias("intensity"),
    )


@query(f"""WITH {FR}, a(f_lo, f_hi, d0, d1) AS (VALUES (10, 30, 50e0, 300e0), (50, 70, 200e0, 450e0)), p AS (SELECT fr.bag, fr.i, dist, a.f_lo FROM fr LEFT JOIN a ON i BETWEEN f_lo AND f_hi WHERE status = 'detected'),
m AS (SELECT p.*, d0, d1, abs(dist - (400e0 - (i - 10) * 3e0)) <= 30e0 AS on_path FROM p LEFT JOIN a USING (f_lo))
SELECT bag, count(*) AS candidates, count(*) FILTER (f_lo IS NOT NULL AND dist BETWEEN d0 - 5 AND d1 + 5) AS annotated, count(*) FILTER (on_path) AS on_path, count(*) FILTER (f_lo IS NULL AND NOT on_path) AS other FROM m GROUP BY bag""")
def real_data_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates on real recordings: within an annotation, on the reference trajectory, or neither.  Two annotations are broadcast."""
    a = spark.createDataFrame([(10, 30, 50.0, 300.0), (50, 70, 200.0, 450.0)], "f_lo long, f_hi long, d0 double, d1 double")
    m = frames(spark, sf_dir).where("status = 'detected'").join(F.broadcast(a), F.col("i").between(F.col("f_lo"), F.col("f_hi")), "left")
    path = F.abs(F.col("dist") - (400.0 - (F.col("i") - 10) * 3.0)) <= 30.0
    inside = F.coalesce(F.col("dist").between(F.col("d0") - 5, F.col("d1") + 5), F.lit(False))
    return m.groupBy("bag").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(inside).alias("annotated"), F.count_if(path).alias("on_path"), F.count_if(F.col("f_lo").isNull() & ~path).alias("other"))


@query(f"""WITH {FR}, o AS (SELECT *, row_number() OVER (PARTITION BY bag ORDER BY dist, i) AS place FROM fr WHERE status = 'detected') SELECT bag, i, dist, place FROM o""")
def candidates_by_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates in order of distance, equal ones in order of arrival."""
    w = Window.partitionBy("bag").orderBy("dist", "i")
    return frames(spark, sf_dir).where("status = 'detected'").select("bag", "i", "dist", F.row_number().over(w).cast("long").alias("place"))


@query(f"""WITH {FR}, s AS (SELECT bag, i, dist, row_number() OVER (PARTITION BY bag ORDER BY i) AS n FROM fr WHERE i >= 10 AND (i - 10) % 3 = 0), k AS (SELECT * FROM s WHERE n <= 12), c AS (SELECT bag, max(i) + 1 AS expected FROM fr GROUP BY bag)
SELECT k.bag, count(*) AS done, min(i) AS first_i, max(i) AS last_i, least(12, ceil((expected - 10) / 3e0))::BIGINT AS wanted, count(*) = least(12, ceil((expected - 10) / 3e0)) AS complete, max(dist) FILTER (n = 5) AS fifth FROM k JOIN c USING (bag) GROUP BY k.bag, expected""")
def frame_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third frame from an offset, twelve at most, whether that is all there should be, and the fifth of them."""
    fr = frames(spark, sf_dir)
    w = Window.partitionBy("bag").orderBy("i")
    k = fr.where("i >= 10 and (i - 10) % 3 = 0").select("bag", "i", "dist", F.row_number().over(w).alias("n")).where("n <= 12")
    c = fr.groupBy("bag").agg((F.max("i") + 1).alias("expected"))
    wanted = F.least(F.lit(12), F.ceil((F.col("expected") - 10) / 3.0)).cast("long")
    g = k.groupBy("bag").agg(F.count(F.lit(1)).alias("done"), F.min("i").alias("first_i"), F.max("i").alias("last_i"), F.max(F.when(F.col("n") == 5, F.col("dist"))).alias("fifth"))
    return g.join(c, "bag").select("bag", "done", "first_i", "last_i", wanted.alias("wanted"), (F.col("done") == wanted).alias("complete"), "fifth")


@query(f"""WITH {FR}, e AS (SELECT bag, i, status, row_number() OVER (PARTITION BY status ORDER BY bag, i) AS rn FROM fr), x AS (SELECT status, string_agg(bag::VARCHAR || ':' || i::VARCHAR, ',' ORDER BY rn) FILTER (rn <= 10) AS examples, count(*) AS n FROM e GROUP BY status) SELECT * FROM x""")
def status_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each status with the first ten examples; only those are gathered."""
    fr = frames(spark, sf_dir)
    first = fr.withColumn("rn", F.row_number().over(Window.partitionBy("status").orderBy("bag", "i"))).where("rn <= 10")
    text = F.concat_ws(":", F.col("bag").cast("string"), F.col("i").cast("string"))
    x = first.groupBy("status").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", text.alias("t")))), lambda s: s["t"]), ",").alias("examples"))
    return fr.groupBy("status").agg(F.count(F.lit(1)).alias("n")).join(x, "status").select("status", "examples", "n")


@query(f"""WITH {PT}, b AS (SELECT frame, slot // 40 AS block, median(r) FILTER (r > 5) AS m FROM pt GROUP BY ALL) SELECT frame, block, round(m, 4) AS m, row_number() OVER (PARTITION BY frame ORDER BY m DESC NULLS LAST, block) AS place FROM b""")
def block_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of a cloud, the farthest by median range first, empty ones last."""
    b = points(spark, sf_dir).groupBy("frame", F.floor(F.col("slot") / 40).cast("long").alias("block")).agg(F.percentile(F.when(F.col("r") > 5, F.col("r")), 0.5).alias("m"))
    w = Window.partitionBy("frame").orderBy(F.desc_nulls_last("m"), "block")
    return b.select("frame", "block", F.round("m", 4).alias("m"), F.row_number().over(w).cast("long").alias("place"))


@query("""WITH e AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, floor(value / 25) AS score FROM events), b AS (SELECT *, coalesce(score > max(score) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better FROM e)
SELECT run, max(epoch) FILTER (better) AS best_epoch, max(score) AS best, count(*) FILTER (better) AS improvements FROM b GROUP BY run""")
def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best epoch so far: only a strictly better score replaces it, so the first of equals stays."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read_table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.row_number().over(w).cast("long").alias("epoch"), F.floor(F.col("value") / 25).cast("double").alias("score"))
    before = F.max("score").over(isl.by(["run"], ["epoch"]).rowsBetween(Window.unboundedPreceding, -1))
    b = e.withColumn("better", F.coalesce(F.col("score") > before, F.lit(True)))
    return b.groupBy("run").agg(F.max(F.when(F.col("better"), F.col("epoch"))).alias("best_epoch"), F.max("score").alias("best"), F.count_if("better").alias("improvements"))


@query("""WITH p AS (SELECT event_type, user_id, count(*) AS n, quantile_cont(value, 0.95) AS p95, max(value) - min(value) AS jitter FROM events GROUP BY ALL)
SELECT event_type, sum(n)::BIGINT AS n, round(max(p95), 4) AS p95, round(max(jitter), 4) AS jitter, NULL::DOUBLE AS p50 FROM p GROUP BY event_type""")
def merged_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenes' figures merged: the worst tail and jitter; a median of medians is none, so it is null."""
    p = read_table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"), F.percentile("value", 0.95).alias("p95"), (F.max("value") - F.min("value")).alias("jitter"))
    return p.groupBy("event_type").agg(F.sum("n").alias("n"), F.round(F.max("p95"), 4).alias("p95"), F.round(F.max("jitter"), 4).alias("jitter"), F.lit(None).cast("double").alias("p50"))


@query(f"""WITH {PT}, a AS (SELECT frame, slot, slot % 40 AS ring, CASE WHEN frame % 2 = 0 THEN slot % 40 ELSE slot // 7 % 40 END AS told, d, lead(d) OVER (PARTITION BY frame ORDER BY slot) AS nxt FROM pt)
SELECT frame, bool_and(told = ring) FILTER (slot % 5 = 0) AS by_ring, round(avg((floor(d / 40) = floor(nxt / 40))::INT) FILTER (slot % 2 = 0 AND nxt IS NOT NULL), 6) AS equal_share, count(*) FILTER (slot % 2 = 0 AND nxt IS NOT NULL) > 100 AND avg((floor(d / 40) = floor(nxt / 40))::INT) FILTER (slot % 2 = 0 AND nxt IS NOT NULL) > 0.25e0 AS dual FROM a GROUP BY frame""")
def layout_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether slots run ring by ring, on sampled slots, and whether pairs of slots are two returns of a beam."""
    w = Window.partitionBy("frame").orderBy("slot")
    told = F.when(F.col("frame") % 2 == 0, F.col("slot") % 40).otherwise(F.floor(F.col("slot") / 7) % 40)
    a = points(spark, sf_dir).select("frame", "slot", (told == F.col("slot") % 40).alias("ok"), (F.floor(F.col("d") / 40) == F.floor(F.lead("d").over(w) / 40)).alias("same"))
    pair = F.when((F.col("slot") % 2 == 0) & F.col("same").isNotNull(), F.col("same").cast("int"))
    return a.groupBy("frame").agg(F.bool_and(F.when(F.col("slot") % 5 == 0, F.col("ok"))).alias("by_ring"), F.round(F.avg(pair), 6).alias("equal_share"), ((F.count(pair) > 100) & (F.avg(pair) > 0.25)).alias("dual"))


@query(r"""SELECT CASE WHEN regexp_matches(url, '^[^/]*//[^/]*blog[^/]*/.*$') THEN 'blog' WHEN regexp_matches(url, '^.*/en/[0-9]\.html$') OR regexp_matches(url, '^.*/fr/.*$') THEN 'listed' ELSE 'other' END AS kind, count(*) AS n, max(regexp_extract(url, '([^/?#]*)$', 1)) AS last_name,
  count(*) FILTER (starts_with(url, 'https://www.')) AS www FROM pages WHERE url IS NOT NULL GROUP BY 1""")
def glob_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names matched by shell patterns, made regular expressions once on the driver, and prefix and base-name rules."""
    u = F.col("url")
    kind = F.when(u.rlike(C.glob_pattern("*//*blog*/*", separator=True)), "blog").when(u.rlike(C.glob_pattern("*/en/[0-9].html")) | u.rlike(C.glob_pattern("*/fr/*")), "listed").otherwise("other")
    return read_table(spark, sf_dir, "pages").where("url is not null").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.max(F.regexp_extract(u, "([^/?#]*)$", 1)).alias("last_name"), F.count_if(u.startswith("https://www.")).alias("www"))


@query(f"""WITH {FR}, s AS (SELECT bag, i, t * 1000 + k AS ns FROM fr) SELECT bag, min(ns // 1000000000) AS first_sec, max(ns % 1000000000) AS last_nano, sum(((ns // 1000000000) * 1000000000 + ns % 1000000000 = ns)::INT)::BIGINT AS whole FROM s GROUP BY bag""")
def stamp_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nanosecond stamps in seconds and rest, and back."""
    ns = F.col("t") * 1000 + F.col("k")
    sec, nano = C.stamp_parts(ns)
    return frames(spark, sf_dir).groupBy("bag").agg(F.min(sec).alias("first_sec"), F.max(nano).alias("last_nano"), F.sum((sec * 1_000_000_000 + nano == ns).cast("int")).alias("whole"))


@query(f"""WITH {FR}, k AS (SELECT bag, dist AS angle, min(i) AS row FROM fr WHERE k % 5 = 0 GROUP BY ALL), q AS (SELECT bag, i, dist FROM fr), c AS (SELECT q.bag, q.i, k.row, row_number() OVER (PARTITION BY q.bag, q.i ORDER BY abs(k.angle - q.dist), k.angle) AS rn FROM q JOIN k USING (bag)) SELECT bag, i, "row" FROM c WHERE rn = 1""")
def nearest_table_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of the nearest angle in a sorted table, the lower of two equally near: two running windows, no join."""
    fr = frames(spark, sf_dir)
    table = fr.where("k % 5 = 0").groupBy("bag", F.col("dist").alias("angle")).agg(F.min("i").alias("row"))
    q = fr.select("bag", "i", F.col("dist").alias("angle"))
    return as_of_nearest(q, table, ["bag"], "angle", "row").where("row is not null").select("bag", "i", "row")


@query(f"""WITH {PT}, m AS (SELECT frame, CASE frame % 3 WHEN 0 THEN d WHEN 1 THEN -l ELSE h END AS x, CASE frame % 3 WHEN 0 THEN l WHEN 1 THEN d ELSE l END AS y, CASE frame % 3 WHEN 0 THEN h WHEN 1 THEN h ELSE -d END AS z FROM pt)
SELECT frame, round(max(x), 5) AS x, round(min(y), 5) AS y, round(avg(z), 4) AS z FROM m GROUP BY frame""")
def mode_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates by a scene's mode."""
    axes = [("+x", "+y", "+z"), ("-y", "+x", "+z"), ("+z", "+y", "-x")]
    made = [C.permuted_axes(F.col("d"), F.col("l"), F.col("h"), a) for a in axes]
    pick = lambda k: F.when(F.col("frame") % 3 == 0, made[0][k]).when(F.col("frame") % 3 == 1, made[1][k]).otherwise(made[2][k])
    return points(spark, sf_dir).groupBy("frame").agg(F.round(F.max(pick(0)), 5).alias("x"), F.round(F.min(pick(1)), 5).alias("y"), F.round(F.avg(pick(2)), 4).alias("z"))


_SET = ["roi_l=0.7", "min_valid_points=550", "floor_h=0.35", "roi_d=[5, 150]"]


@query(f"""WITH {PT} SELECT frame, count(*) AS n_roi, count(*) FILTER (h >= 0.35e0 + 0.002e0 * d) AS above, CASE WHEN count(*) < 550 - 200 THEN 'unknown' ELSE 'clear' END AS status FROM pt WHERE d BETWEEN 5 AND 150 AND abs(l) <= 0.7e0 AND h BETWEEN -8 AND 10 GROUP BY frame""")
def overridden_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region of interest under thresholds given as ``name=value`` texts; their values become literals of the plan."""
    t = Thresholds.from_mapping(dict(map(parse_override, _SET)))
    inside = F.col("d").between(*t.roi_d) & (F.abs("l") <= t.roi_l) & F.col("h").between(*t.roi_h)
    g = points(spark, sf_dir).where(inside).groupBy("frame").agg(F.count(F.lit(1)).alias("n_roi"), F.count_if(F.col("h") >= t.floor_h + t.floor_slope * F.col("d")).alias("above"))
    return g.withColumn("status", F.when(F.col("n_roi") < t.min_valid_points - 200, "unknown").otherwise("clear"))


#: Detectors that give candidates of one form, and how many a frame keeps of each.
DETECTORS = {
    "d1": lambda p: p.where("r > 35").groupBy("frame", C.floor_bin(F.col("d"), 10.0).alias("cell")).agg(F.avg("d").alias("d"), F.avg("l").alias("l"), (F.count(F.lit(1)) / 50.0).alias("score")),
    "d2": lambda p: p.where("h > 2.2D").groupBy("frame", C.floor_bin(F.col("d"), 15.0).alias("cell")).agg(F.avg("d").alias("d"), F.avg("l").alias("l"), (F.count(F.lit(1)) / 40.0).alias("score")),
}


@query(f"""WITH {PT}, c AS (SELECT 'd1' AS detector, frame, floor(d / 10)::BIGINT AS cell, avg(d) AS d, avg(l) AS l, count(*) / 50e0 AS score FROM pt WHERE r > 35 GROUP BY ALL UNION ALL SELECT 'd2', frame, floor(d / 15)::BIGINT, avg(d), avg(l), count(*) / 40e0 FROM pt WHERE h > 2.2e0 GROUP BY ALL)
SELECT frame, count(*) AS candidates, count(DISTINCT detector) AS detectors, round(sum(least(1e0, score)), 4) AS score, string_agg(DISTINCT detector, '+' ORDER BY detector) AS names FROM c GROUP BY frame""")
def pluggable_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of all registered detectors in one form, and which detectors a frame has."""
    p = points(spark, sf_dir)
    every = None
    for name, detect in DETECTORS.items():
        one = detect(p).withColumn("detector", F.lit(name))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("frame").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_distinct("detector").alias("detectors"), F.round(F.sum(F.least(F.lit(1.0), "score")), 4).alias("score"), F.array_join(F.array_sort(F.collect_set("detector")), "+").alias("names")
    )


@query(f"""WITH {FR}, e AS (SELECT bag, i, t, coalesce(lag(t) OVER (PARTITION BY bag ORDER BY i), t) AS prev FROM fr), s AS (SELECT bag, i, sum((t - prev > 43200000000)::INT) OVER (PARTITION BY bag ORDER BY i) AS sequence FROM e)
SELECT bag, sequence::BIGINT AS sequence, min(i) AS first_i, count(*) AS n, CASE WHEN min(i) = 0 THEN 'start' ELSE 'gap' END AS why FROM s GROUP BY ALL""")
def sequence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of a recording by gaps in time, with what began each."""
    w = isl.by(["bag"], ["i"])
    e = frames(spark, sf_dir).withColumn("gap", F.coalesce((F.col("t") - F.lag("t").over(w) > 43_200_000_000).cast("long"), F.lit(0).cast("long")))
    s = e.withColumn("sequence", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("bag", "sequence").agg(F.min("i").alias("first_i"), F.count(F.lit(1)).alias("n")).withColumn("why", F.when(F.col("first_i") == 0, "start").otherwise("gap"))
