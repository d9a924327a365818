"""Queries of live operators: streams whose state has timers, delivered slice by slice in the order of time."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tracks.batch import ordered_fold
from ..operators.tracks.line import OUT, LineRules, line_step, new_line
from ..session import discard, shared_dir, written
from ..streaming.line_state import line_frame, stream_lines
from ..streaming.observer import StampAudit, coverage, watched
from ..streaming.silence import expected, silence_watch
from .state_queries import state_on_disk
from .views import FR, frames

QUERIES: dict = {}
ORACLE_SQL: dict = {}
DAY = 86_400_000
#: A recording is silent after a day and a half; the clock ticks every day, and the watermark lags by a day.
STALE, EVERY, LAG = 3 * DAY // 2, DAY, DAY
#: Rows of a file of a stream's slice.
SLICE_ROWS = 50_000


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def run_in_slices(spark: SparkSession, src: DataFrame, time: str, edges: list, plan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream gives that gets ``src`` in slices of time, a slice a batch: all of it, read back from its sink.

    Every slice has as many files, of some ``SLICE_ROWS`` rows in the smallest slice, so tasks share the writing and reading of a large one.
    """
    base = f"{shared_dir(spark)}/slices-{uuid.uuid4().hex}"
    table = written(src, "slices-source")
    slices = []
    for lo, hi in zip([None, *edges], [*edges, None]):
        some = table if lo is None else table.where(F.col(time) >= F.lit(lo))
        slices.append(some if hi is None else some.where(F.col(time) < F.lit(hi)))
    files = max(1, min(some.count() for some in slices) // SLICE_ROWS)
    for some in slices:
        some.repartition(files).write.mode("append").parquet(f"{base}/in")
    discard(table)
    if len(spark.read.schema(src.schema).parquet(f"{base}/in").inputFiles()) != files * len(slices):
        raise RuntimeError("a slice has files without rows")
    stream = plan(spark.readStream.schema(src.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/in"))
    with state_on_disk(spark):
        q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    out = spark.read.schema(stream.schema).parquet(f"{base}/out")
    out.query_id = str(q.id)
    return out


@query(f"""WITH e AS (SELECT user_id AS bag, epoch_us(ts) // 1000 AS t FROM events), z AS (SELECT min(t) AS t0, max(t) - {LAG} AS w FROM e),
k AS (SELECT DISTINCT bag FROM e UNION ALL SELECT DISTINCT bag + 1000000 FROM e WHERE bag % 50 = 0),
a AS (SELECT bag, t0 AS t, false AS spoken FROM k, z UNION ALL SELECT bag, t, true FROM e),
g AS (SELECT bag, t, spoken, lead(t) OVER (PARTITION BY bag ORDER BY t, spoken) AS nxt FROM a),
s AS (SELECT bag, t, spoken, ((t + {STALE}) // {EVERY} + 1) * {EVERY} AS first, coalesce(nxt - 1, w) AS until FROM g, z),
x AS (SELECT *, unnest(range(first, until + 1, {EVERY})) AS tick FROM s WHERE first <= until)
SELECT bag, tick AS tick_ms, tick - t AS silent_ms, tick = first AS reset, CASE WHEN spoken THEN 'stale' ELSE 'no input' END AS reason FROM x""")
def silence_watch_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of silent recordings by timers on the watermark, and of expected ones that never spoke."""
    src = frames(spark, sf_dir).select("bag", F.timestamp_micros("t").alias("ts"))
    z = src.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.unix_millis(F.min("ts")).alias("t0")).first()
    keys = src.select("bag").distinct()
    keys = keys.unionByName(keys.where("bag % 50 = 0").select((F.col("bag") + 1_000_000).alias("bag")))
    edges = [z.lo + (z.hi - z.lo) * k / 4 for k in range(1, 4)] if z.lo else []
    return run_in_slices(spark, src, "ts", edges, lambda s: silence_watch(s.withWatermark("ts", f"{LAG} milliseconds"), "bag", "ts", STALE, EVERY, initial=expected(keys, "bag", z.t0 or 0)))


#: Frames are hours apart: a model is held for half a day, a sequence ends after four days; bends and reaches are the events' values.
LINE = LineRules(hold=DAY // 2, back=1, gap=4 * DAY, straight=150.0, keep_straight=300.0, far_reach=141.0)


def line_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fit a frame, of which some fail, with the share of the image that stands still."""
    i, k = F.col("i"), F.col("k")
    still = F.when(i % 40 < 18, 0.95).when(i % 40 < 32, 0.85).otherwise(0.2)
    ok = k % 4 != 1
    return frames(spark, sf_dir).select("bag", "i", F.floor(F.col("t") / 1000).alias("stamp"), still.alias("still"), F.when(ok, F.col("dist")).alias("b"), F.when(ok, 60.0 + k % 50).alias("reach"), F.timestamp_micros("t").alias("ts"))


def _mid(xs: str) -> str:
    return f"{{'b': list_aggregate(list_transform({xs}, lambda each: each.b), 'median'), 'reach': list_aggregate(list_transform({xs}, lambda each: each.reach), 'median')}}"


_LINE_SQL = f"""WITH RECURSIVE {FR}, f AS (SELECT bag, i, t // 1000 AS t, CASE WHEN i % 40 < 18 THEN 0.95e0 WHEN i % 40 < 32 THEN 0.85e0 ELSE 0.2e0 END AS still, CASE WHEN k % 4 <> 1 THEN {{'b': dist, 'reach': 60e0 + k % 50}} END AS fit FROM fr),
a AS (SELECT bag, -1::BIGINT AS i, NULL::BIGINT AS t, []::STRUCT(b DOUBLE, reach DOUBLE)[] AS st, []::STRUCT(b DOUBLE, reach DOUBLE)[] AS qs, NULL::STRUCT(b DOUBLE, reach DOUBLE) AS frozen, NULL::STRUCT(b DOUBLE, reach DOUBLE) AS held, NULL::BIGINT AS held_at, false AS ext, '' AS source, NULL::STRUCT(b DOUBLE, reach DOUBLE) AS model, false AS reset FROM (SELECT DISTINCT bag FROM f)
UNION ALL SELECT bag, i, t, st2, qs2, frozen2, coalesce(m2, held), CASE WHEN m2 IS NOT NULL THEN t ELSE held_at END, ext2,
  CASE WHEN m2 IS NOT NULL THEN CASE WHEN frozen2 IS NOT NULL THEN 'frozen' WHEN smooth THEN 'smoothed' ELSE 'fit' END WHEN fresh THEN 'held' ELSE 'none' END,
  CASE WHEN m2 IS NOT NULL THEN {{'b': m2.b, 'reach': CASE WHEN ext2 THEN greatest(m2.reach, {LINE.far_reach}e0) ELSE m2.reach END}} WHEN fresh THEN held END, jump
FROM (SELECT *, CASE WHEN m2 IS NOT NULL THEN abs(m2.b) < CASE WHEN ext THEN {LINE.keep_straight}e0 ELSE {LINE.straight}e0 END ELSE ext END AS ext2, held IS NOT NULL AND t - held_at <= {LINE.hold} AS fresh
FROM (SELECT *, CASE WHEN frozen2 IS NOT NULL AND frozen IS NULL THEN frozen2 ELSE m END AS m2
FROM (SELECT *, CASE WHEN frozen IS NULL AND add_static AND len(st2) >= {LINE.warm_up} THEN {_mid('st2')} ELSE frozen END AS frozen2
FROM (SELECT *, CASE WHEN add_static THEN list_append(st, m) ELSE st END AS st2
FROM (SELECT *, CASE WHEN frozen IS NOT NULL THEN frozen WHEN smooth THEN {_mid('list_append(qs, fit)')} ELSE fit END AS m, frozen IS NULL AND fit IS NOT NULL AND still >= {LINE.static} AS add_static,
  CASE WHEN frozen IS NOT NULL THEN [] WHEN fit IS NULL THEN qs WHEN still >= {LINE.quasi} THEN list_slice(list_append(qs, fit), greatest(len(qs) + 2 - {LINE.smooth - 1}, 1), len(qs) + 1) ELSE [] END AS qs2
FROM (SELECT *, frozen IS NULL AND fit IS NOT NULL AND still >= {LINE.quasi} AND len(qs) >= 2 AS smooth
FROM (SELECT f.bag, f.i, f.t, f.still, f.fit, coalesce(f.t - a.t > {LINE.gap}, false) AS jump, CASE WHEN jump OR f.still < {LINE.static} THEN [] ELSE a.st END AS st, CASE WHEN jump THEN [] ELSE a.qs END AS qs,
  CASE WHEN NOT jump AND f.still >= {LINE.static} THEN a.frozen END AS frozen, CASE WHEN NOT jump THEN a.held END AS held, a.held_at, NOT jump AND a.ext AS ext FROM a JOIN f ON f.bag = a.bag AND f.i = a.i + 1))))))))
SELECT bag, i, source, round(model.b, 6) AS b, round(model.reach, 6) AS reach, ext AS extended, reset FROM a WHERE i >= 0"""


def _told(lines: DataFrame) -> DataFrame:
    return lines.select("bag", "i", "source", F.round("b", 6).alias("b"), F.round("reach", 6).alias("reach"), "extended", "reset")


@query(_LINE_SQL)
def line_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line model of each frame: smoothed, frozen in a stop, held by its age, with its extended reach; one ordered pass a recording."""
    return _told(ordered_fold(line_fits(spark, sf_dir), "bag", "i", lambda state, row: [line_step(state, line_frame(row), LINE)], new_line, OUT))


@query(_LINE_SQL)
def line_model_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream in slices of time: each recording's model in the state store."""
    src = line_fits(spark, sf_dir)
    z = src.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    edges = [z.lo + (z.hi - z.lo) * k / 4 for k in range(1, 4)] if z.lo else []
    return _told(run_in_slices(spark, src, "ts", edges, lambda s: stream_lines(s, "bag", "i", LINE)))


@query(f"""WITH {FR}, z AS (SELECT min(t) AS lo, max(t) AS hi FROM fr), f AS (SELECT fr.*, least(3, (t - lo) * 4 // (hi - lo)) AS batch FROM fr, z),
s AS (SELECT batch, count(*) AS sent, count(*) FILTER (status <> 'unknown') AS processed, count(*) FILTER (status <> 'unknown' AND dist < 480) AS published FROM f GROUP BY batch)
SELECT batch, 'processed' AS stage, sent, processed AS "later", sent - processed AS lost, sent = processed AS same FROM s UNION ALL SELECT batch, 'published', sent, published, sent - published, sent = published FROM s UNION ALL SELECT batch, 'received', sent, sent, 0, true FROM s""")
def stamp_audit_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps sent, received, processed and published by a stream, batch by batch, as a listener beside it saw them."""
    src = frames(spark, sf_dir).select("t", "status", "dist", F.timestamp_micros("t").alias("ts"))
    z = src.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    edges = [z.lo + (z.hi - z.lo) * k / 4 for k in range(1, 4)] if z.lo else []

    def plan(s: DataFrame) -> DataFrame:
        got = watched(watched(s, "sent", "t").select("t", "status", "dist"), "received", "t")
        done = watched(got.where("status <> 'unknown'"), "processed", "t")
        return watched(done.where("dist < 480"), "published", "t").select("t")

    audit = StampAudit()
    spark.streams.addListener(audit)
    try:
        out = run_in_slices(spark, src, "ts", edges, plan)
        if not audit.wait(out.query_id):
            raise TimeoutError("the stream's progress did not arrive")
    finally:
        spark.streams.removeListener(audit)
    table = audit.table(spark).where(F.col("query") == out.query_id)
    each = [coverage(table, "sent", stage).withColumn("stage", F.lit(stage)) for stage in ("received", "processed", "published")]
    return each[0].unionByName(each[1]).unionByName(each[2]).select("batch", "stage", "sent", "later", "lost", "same")
