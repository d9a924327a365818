"""Queries with sequential state: temporal filter and fusion, in batch and as streams run to the end."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tracks.batch import HITS, fold
from ..operators.tracks.core import FusionRules, filter_step, fusion_step, is_reset, weighed
from ..session import shared_dir, written
from ..streaming.folds import freshest, stream_fold
from . import stream_queries
from .views import FR, frames

QUERIES: dict = {}
ORACLE_SQL: dict = {}
#: Frames of the driver's events are hours apart: a sequence ends after twenty days without one.
GAP = 20 * 86_400_000_000_000


def query(f):
    QUERIES[f.__name__] = f
    return f


def candidate_frames(spark: SparkSession, sf_dir: str, sources: int = 1) -> DataFrame:
    """Frames of ``(bag, i, stamp, unknown, hits)``: slow objects of one or several detectors."""
    fr = frames(spark, sf_dir)
    d = F.when(F.col("k") % 17 == 0, F.col("dist")).otherwise(F.lit(40.0) + (F.col("bag") % 5) * 30.0 + (F.col("k") % 4) * 0.5)
    side = ((F.col("k") % 3) - 1) * 0.4
    score = F.lit(0.2) + (F.col("k") % 9) / 10.0
    cls = F.when(F.col("k") % 23 == 0, "dust").otherwise("obstacle")
    dets = F.array(*[F.struct(F.lit(f"d{x + 1}").alias("det"), (d + x * 0.3).alias("d"), side.alias("l"), score.alias("score"), cls.alias("cls")) for x in range(sources)])
    shown = F.filter(dets, lambda h: F.pmod(F.col("k") + F.length(h["det"]) + F.substring(h["det"], 2, 1).cast("int"), F.lit(4)) != 0)
    return fr.select("bag", "i", (F.col("t") * 1000).alias("stamp"), (F.col("status") == "unknown").alias("unknown"), shown.alias("hits"))


def filtered(state: dict, frame: dict) -> dict:
    return filter_step(state, frame, gap_ns=GAP)


def fused(state: dict, frame: dict) -> dict:
    return fusion_step(state, frame, FusionRules(max_d=150.0), gap_ns=GAP)


@query
def temporal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy association and confirmation of one detector's candidates."""
    return fold(candidate_frames(spark, sf_dir), filtered)


@query
def fusion_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of three detectors fused into tracks."""
    return fold(candidate_frames(spark, sf_dir, 3), fused)


_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started within keep their state in RocksDB, so it may outgrow an executor's heap."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_STORE) if before is None else spark.conf.set(_STORE, before)


def run_stream(spark: SparkSession, source: DataFrame, plan) -> DataFrame:
    """A table streamed through ``plan`` until all of it is processed, read back from the sink."""
    src = written(source, "stream-in")
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 4).parquet(src.written_path)
    with state_on_disk(spark):
        q = plan(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query
def temporal_filter_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The temporal filter as a stream: each recording's frames arrive in order."""
    src = candidate_frames(spark, sf_dir).repartition(4, "bag").sortWithinPartitions("bag", "i")
    return run_stream(spark, src, lambda s: stream_fold(s, filtered))


@query
def fusion_tracks_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = candidate_frames(spark, sf_dir, 3).repartition(4, "bag").sortWithinPartitions("bag", "i")
    return run_stream(spark, src, lambda s: stream_fold(s, fused))


def run_windows(spark: SparkSession, source: DataFrame, plan) -> DataFrame:
    """Windows over ``ts`` of a table streamed through ``plan`` in append mode to a table of its own.

    The watermark only evicts: it lags by 400 days, so nothing is late.  A last row, 900 days after all others and with null
    columns but ``ts``, moves it past every window, which are then written; its own window never is.
    """
    last = source.agg((F.max("ts") + F.expr("interval 900 days")).alias("ts"))
    src = written(source.unionByName(last, allowMissingColumns=True), "stream-in")  # all files are one batch
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = plan(spark.readStream.schema(src.schema).parquet(src.written_path).withWatermark("ts", "400 days"))
    with state_on_disk(spark):
        q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@query
def windowed_status_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status counts by day of event time as a stream with a watermark that only evicts state."""
    fr = frames(spark, sf_dir).select(F.timestamp_micros("t").alias("ts"), "status")

    def plan(s: DataFrame) -> DataFrame:
        g = s.groupBy(F.window("ts", "1 day").alias("w"), "status").agg(F.count(F.lit(1)).alias("n"))
        return g.select(F.unix_micros("w.start").alias("day"), "status", "n")

    return run_windows(spark, fr, plan)


ORACLE_SQL["windowed_status_stream"] = """SELECT epoch_us(date_trunc('day', ts)) AS day, CASE event_type WHEN 'error' THEN 'detected' WHEN 'signup' THEN 'unknown' ELSE 'clear' END AS status, count(*) AS n FROM events GROUP BY ALL"""


def epochs(state: dict, frame: dict) -> dict:
    """The reset rule alone; the number of resets so far stands where tracks are counted."""
    reset = is_reset(state["last"], frame["stamp"], 1_000_000, 43_200_000_000_000)
    state["next"] += reset
    state["last"] = state["last"] if frame["stamp"] is None else frame["stamp"]
    return {"reset": reset, "status": "", "distance": None, "tracks": state["next"], "confirmed": 0, "coasting": 0}


@query
def reset_epochs_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequence resets on a stream: a step back in time begins a new sequence and drops nothing."""
    stamp = F.when(F.col("k") % 11 == 0, F.lit(None)).when(F.col("k") % 13 == 0, F.col("t") - 90_000_000_000).otherwise(F.col("t"))
    src = frames(spark, sf_dir).select("bag", "i", (stamp * 1000).alias("stamp"), F.lit(False).alias("unknown"), F.lit(None).cast(HITS).alias("hits"))
    out = run_stream(spark, src.repartition(4, "bag").sortWithinPartitions("bag", "i"), lambda s: stream_fold(s, epochs))
    return out.select("bag", "i", "reset", F.col("tracks").alias("epoch"))


ORACLE_SQL["reset_epochs_stream"] = stream_queries.ORACLE_SQL["reset_epochs"]


@query
def sessions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a stream by a gap of six hours; the watermark is longer than the data, so nothing is late."""
    src = frames(spark, sf_dir).select("bag", F.timestamp_micros("t").alias("ts"), "dist")

    def plan(s: DataFrame) -> DataFrame:
        g = s.groupBy("bag", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("dist"), 4).alias("total"))
        return g.select("bag", F.unix_micros("w.start").alias("t_first"), "n", "total")

    return run_windows(spark, src, plan)


ORACLE_SQL["sessions_stream"] = f"SELECT bag, t_first, n, total FROM ({stream_queries.ORACLE_SQL['sessions_by_gap']})"


_TRACK = "STRUCT(id BIGINT, d DOUBLE, l DOUBLE, misses BIGINT, seen BIGINT[])"
#: The temporal filter by recursion over a recording's frames, with its tracks in a list; a frame has one candidate at most.
_FILTER_SQL = f"""WITH RECURSIVE {FR}, c AS (SELECT bag, i, t * 1000 AS stamp, status = 'unknown' AS unknown, CASE WHEN status <> 'unknown' AND (k + 3) % 4 <> 0 THEN CASE WHEN k % 17 = 0 THEN dist ELSE 40e0 + (bag % 5) * 30e0 + (k % 4) * 0.5e0 END END AS hd, ((k % 3) - 1) * 0.4e0 AS hl FROM fr),
a AS (SELECT bag, -1::BIGINT AS i, NULL::BIGINT AS last, 0::BIGINT AS nxt, []::{_TRACK}[] AS tr, false AS reset, '' AS status, NULL::DOUBLE AS distance, 0::BIGINT AS confirmed FROM (SELECT DISTINCT bag FROM fr)
UNION ALL SELECT bag, i, stamp, nxt + (hd IS NOT NULL AND chosen IS NULL)::BIGINT, tr3, reset, CASE WHEN unknown THEN 'unknown' WHEN len(sure) > 0 THEN 'detected' ELSE 'clear' END, CASE WHEN NOT unknown THEN sure[1].d END, CASE WHEN unknown THEN 0 ELSE len(sure) END FROM (
  SELECT *, list_sort(list_transform(list_filter(tr3, lambda x: x.misses = 0 AND CASE WHEN x.d >= 100 THEN len(list_filter(x.seen, lambda f: f > i + 1 - 4)) >= 3 ELSE len(list_filter(x.seen, lambda f: f > i + 1 - 3)) >= 2 END), lambda x: struct_pack(d := x.d, id := x.id))) AS sure FROM (
   SELECT *, list_filter(list_concat(list_transform(tr, lambda x: CASE WHEN x.id = chosen THEN struct_pack(id := x.id, d := hd, l := hl, misses := 0::BIGINT, seen := list_append(x.seen, i + 1)) ELSE struct_pack(id := x.id, d := x.d, l := x.l, misses := x.misses + 1, seen := x.seen) END),
     CASE WHEN hd IS NOT NULL AND chosen IS NULL THEN [struct_pack(id := nxt, d := hd, l := hl, misses := 0::BIGINT, seen := [i + 1])] ELSE []::{_TRACK}[] END), lambda x: x.misses <= 3) AS tr3 FROM (
    SELECT *, CASE WHEN hd IS NOT NULL THEN list_sort(list_transform(list_filter(tr, lambda x: hd - x.d >= -8e0 AND hd - x.d <= 2.5e0 AND abs(hl - x.l) <= 1.2e0), lambda x: struct_pack(d := x.d, id := x.id)))[1].id END AS chosen FROM (
     SELECT c.bag, c.i, c.stamp, c.unknown, c.hd, c.hl, a.nxt, coalesce(c.stamp - a.last < -1000000 OR c.stamp - a.last > {GAP}, false) AS reset, CASE WHEN coalesce(c.stamp - a.last < -1000000 OR c.stamp - a.last > {GAP}, false) THEN [] ELSE a.tr END AS tr FROM a JOIN c ON c.bag = a.bag AND c.i = a.i + 1)))))
SELECT bag, i, reset, status, distance, len(tr) AS tracks, confirmed, 0 AS coasting FROM a WHERE i >= 0"""
ORACLE_SQL["temporal_filter"] = ORACLE_SQL["temporal_filter_stream"] = _FILTER_SQL


_FUSED = "STRUCT(id BIGINT, d DOUBLE, l DOUBLE, llr DOUBLE, misses BIGINT, recent STRUCT(f BIGINT, near BOOLEAN, vote BIGINT)[], confirmed BOOLEAN, cls VARCHAR, exact BOOLEAN, one BOOLEAN)"


def _fusion_sql() -> str:
    """Fusion by recursion over a recording's frames; a detector has one hit a frame at most."""
    pick = lambda x: f"CASE WHEN s{x} THEN list_sort(list_transform(list_filter(tr, lambda x: d{x} - x.d >= -8e0 AND d{x} - x.d <= 2.5e0 AND abs(hl - x.l) <= 1.2e0), lambda x: struct_pack(d := x.d, id := x.id)))[1].id END AS c{x}"
    gain = lambda g, low: f"CASE WHEN cls = 'dust' THEN -1.5e0 ELSE {g}e0 * greatest({low}e0, least(1e0, score)) END"
    fresh = lambda n, d, one, two: f"struct_pack(id := {n}, d := {d}, l := hl, llr := 0e0, misses := 0::BIGINT, recent := []::STRUCT(f BIGINT, near BOOLEAN, vote BIGINT)[], confirmed := false, cls := 'obstacle', exact := false, m1 := {one}, m2 := {two}, m3 := false)"
    some, lead = "(x.m1 OR x.m2 OR x.m3)", "(x.m1 OR x.m2)"
    delta = f"(CASE WHEN x.m1 THEN {gain(2.0, 0.3)} ELSE 0e0 END + CASE WHEN x.m3 THEN {gain(1.0, 0.0)} ELSE 0e0 END + CASE WHEN x.m2 THEN {gain(1.2, 0.0)} ELSE 0e0 END + CASE WHEN x.m1::INT + x.m2::INT + x.m3::INT >= 2 AND score >= 0.3e0 AND cls <> 'dust' THEN 0.6e0 ELSE 0e0 END)"
    vote = "CASE WHEN score >= 0.3e0 AND cls <> 'dust' THEN x.m1::BIGINT + 2 * x.m2::BIGINT ELSE 0 END"
    updated = f"""struct_pack(id := x.id, d := CASE WHEN x.m1 THEN d1 WHEN x.m2 THEN d2 WHEN x.m3 AND NOT x.exact THEN d3 ELSE x.d END, l := CASE WHEN {lead} OR (x.m3 AND NOT x.exact) THEN hl ELSE x.l END,
      llr := CASE WHEN {some} THEN greatest(-2e0, least(6e0, x.llr + {delta})) ELSE greatest(-2e0, x.llr + -0.8e0) END, misses := CASE WHEN {some} THEN 0 ELSE x.misses + 1 END,
      recent := list_filter(CASE WHEN {some} THEN list_append(x.recent, struct_pack(f := i + 1, near := {lead}, vote := {vote})) ELSE x.recent END, lambda r: r.f > i + 1 - 5), confirmed := x.confirmed,
      cls := CASE WHEN {some} THEN cls ELSE x.cls END, exact := x.exact OR {lead}, one := x.m1)"""
    frames_ = "len(list_filter(x.recent, lambda r: r.near))"
    voters = "(len(list_filter(x.recent, lambda r: r.vote & 1 = 1)) > 0)::INT + (len(list_filter(x.recent, lambda r: r.vote & 2 = 2)) > 0)::INT"
    sure = f"CASE WHEN x.cls = 'dust' THEN false WHEN x.confirmed THEN x.llr >= 1.2e0 AND {frames_} >= 1 WHEN x.d >= 120 THEN {frames_} >= 4 AND x.llr >= 4 AND {voters} >= 2 ELSE {frames_} >= 2 AND {voters} >= 2 AND x.llr >= 3 END"
    again = "coalesce(c.stamp - a.last < -1000000 OR c.stamp - a.last > " + str(GAP) + ", false)"
    return f"""WITH RECURSIVE {FR}, b AS (SELECT bag, i, t * 1000 AS stamp, status = 'unknown' AS unknown, CASE WHEN k % 17 = 0 THEN dist ELSE 40e0 + (bag % 5) * 30e0 + (k % 4) * 0.5e0 END AS base, ((k % 3) - 1) * 0.4e0 AS hl, 0.2e0 + (k % 9) / 10e0 AS score,
  CASE WHEN k % 23 = 0 THEN 'dust' ELSE 'obstacle' END AS cls, (k + 3) % 4 <> 0 AS s1, (k + 4) % 4 <> 0 AS s2, (k + 5) % 4 <> 0 AS s3 FROM fr), c AS (SELECT *, base + 0 * 0.3e0 AS d1, base + 1 * 0.3e0 AS d2, base + 2 * 0.3e0 AS d3 FROM b),
a AS (SELECT bag, -1::BIGINT AS i, NULL::BIGINT AS last, 0::BIGINT AS nxt, []::{_FUSED}[] AS tr, false AS reset, false AS unknown FROM (SELECT DISTINCT bag FROM fr)
UNION ALL SELECT bag, i, stamp, nxt + born1::BIGINT + born2::BIGINT, list_filter(list_transform(list_transform(list_concat(list_transform(tr, lambda x: struct_pack(id := x.id, d := x.d, l := x.l, llr := x.llr, misses := x.misses, recent := x.recent, confirmed := x.confirmed, cls := x.cls, exact := x.exact, m1 := coalesce(x.id = c1, false), m2 := coalesce(x.id = c2, false), m3 := coalesce(x.id = c3, false))),
    CASE WHEN born1 THEN [{fresh("nxt", "d1", "true", "joins")}] ELSE [] END, CASE WHEN born2 THEN [{fresh("nxt + born1::BIGINT", "d2", "false", "true")}] ELSE [] END), lambda x: {updated}),
    lambda x: struct_pack(id := x.id, d := x.d, l := x.l, llr := x.llr, misses := x.misses, recent := x.recent, confirmed := {sure}, cls := x.cls, exact := x.exact, one := x.one)), lambda x: x.llr > -2e0 AND x.misses <= 8), reset, unknown FROM (
  SELECT *, s2 AND c2 IS NULL AND NOT joins AS born2 FROM (SELECT *, s1 AND c1 IS NULL AS born1, s1 AND c1 IS NULL AND s2 AND c2 IS NULL AND abs(d1 - d2) <= 3.5e0 AS joins FROM (
    SELECT *, {pick(1)}, {pick(2)}, {pick(3)} FROM (SELECT c.*, a.nxt, {again} AS reset, CASE WHEN {again} THEN [] ELSE a.tr END AS tr FROM a JOIN c ON c.bag = a.bag AND c.i = a.i + 1))))),
o AS (SELECT *, list_sort(list_transform(list_filter(tr, lambda x: x.confirmed AND x.d <= 150e0), lambda x: struct_pack(d := x.d, id := x.id, one := x.one))) AS told FROM a WHERE i >= 0)
SELECT bag, i, reset, CASE WHEN len(told) > 0 THEN 'detected' WHEN unknown THEN 'unknown' ELSE 'clear' END AS status, told[1].d AS distance, len(tr) AS tracks, len(list_filter(told, lambda x: x.one)) AS confirmed, len(list_filter(told, lambda x: NOT x.one)) AS coasting FROM o"""


ORACLE_SQL["fusion_tracks"] = ORACLE_SQL["fusion_tracks_stream"] = _fusion_sql()


_VOTES_RULES = FusionRules(far_vote_from=120.0)
_ROWS = "bag, i, 40e0 + (k % 7) * 20e0 AS d, ((k % 3) - 1) * 0.4e0 AS l, 0.1e0 + (k % 5) / 10e0 AS s1, k % 12 AS n1, 0.3e0 + (k % 6) * 0.3e0 AS z1, k % 4 = 0 AS plate, k % 5 = 1 AS weak, k % 3 = 0 AS compact, k % 2 = 0 AS straddle, k % 5 = 1 OR (k % 3 = 0 AND k % 2 = 1) AS rejected, 1.2e0 + i % 3 AS gap, i % 9 AS n2, 0.2e0 + (i % 5) * 0.3e0 AS z2, (i % 4) * 0.5e0 AS bd, (k % 2) * 0.3e0 AS bl, 0.05e0 + (k % 8) / 10e0 AS sb, k % 23 <> 0 AS firm, k % 9 AS nb, 0.4e0 + (i % 4) * 0.3e0 AS zb, i % 11 AS bg, (k % 10) / 20e0 AS att, (i % 10) / 10e0 + 0.1e0 AS still"


@query
def evidence_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores that a frame's hits vote by: far, plate, weak and compact rules on two clusters and a beam group."""
    fr = frames(spark, sf_dir).selectExpr(*[x.replace("e0", "D") for x in _ROWS.split(", ")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                one = {"det": "d1", "d": r.d, "l": r.l, "score": r.s1, "cls": "obstacle", "n": r.n1, "size": r.z1, "plate": r.plate, "weak": r.weak, "compact": r.compact, "straddle": r.straddle, "rejected": r.rejected}
                two = {"det": "d1", "d": r.d + r.gap, "l": r.l + 0.3, "score": 0.2, "cls": "obstacle", "n": r.n2, "size": r.z2}
                beam = {"det": "d2", "d": r.d + r.bd, "l": r.l + r.bl, "score": r.sb, "cls": "obstacle" if r.firm else "dust", "n": r.nb, "size": r.zb, "n_ring": 10, "n_bg": r.bg, "attached": r.att}
                got = weighed({"hits": [one, two, beam], "still": r.still}, _VOTES_RULES)
                first = next((h["score"] for h in got if h["det"] == "d1" and h["d"] == r.d), None)
                out.append((r.bag, r.i, len(got), first, next(h["score"] for h in got if h["det"] == "d1" and h["d"] != r.d), got[-1]["score"]))
            yield pd.DataFrame(out, columns=["bag", "i", "hits", "first", "second", "beam"])

    return fr.mapInPandas(run, "bag long, i long, hits long, first double, second double, beam double")


ORACLE_SQL["evidence_votes"] = f"""WITH {FR}, r AS (SELECT {_ROWS} FROM fr),
f AS (SELECT *, still >= 0.85e0 AS standing, firm AND sb >= 0.3e0 AS voter, bg / 10e0 AS share, firm AND nb >= 4 AND zb <= 1e0 AND att <= 0.1e0 AS free, d + gap AS d2, l + 0.3e0 AS l2, d + bd AS db, l + bl AS lb FROM r),
g AS (SELECT *, d >= 120 AND NOT standing AND n1 < 8 AS no1, d2 >= 120 AND NOT standing AND n2 < 8 AS no2, abs(d - db) <= 2.5e0 AND abs(l - lb) <= 1.2e0 AS by1, abs(d - d2) <= 2.5e0 AND abs(l - l2) <= 2e0 AS beside, abs(d - d2) <= 1.5e0 AND abs(l - l2) <= 0.5e0 AS paired FROM f),
h AS (SELECT *, CASE WHEN rejected THEN CASE WHEN weak AND standing AND voter AND by1 THEN 0.3e0 END WHEN no1 OR (plate AND NOT (voter AND share >= 0.5e0 AND by1)) THEN 0e0 ELSE s1 END AS a1, CASE WHEN no2 THEN 0e0 ELSE 0.2e0 END AS a2,
  CASE WHEN rejected THEN compact ELSE NOT weak AND n1 >= 3 AND z1 <= 1e0 END AND NOT no1 AND free AND share >= CASE WHEN straddle THEN 0.5e0 ELSE 0.8e0 END AND abs(d - db) <= 1.5e0 AND abs(l - lb) <= 0.5e0 AND NOT (beside AND (z2 > 1e0 OR (n2 >= 3 AND NOT paired))) AS pair1,
  n2 >= 3 AND z2 <= 1e0 AND NOT no2 AND free AND share >= 0.8e0 AND abs(d2 - db) <= 1.5e0 AND abs(l2 - lb) <= 0.5e0 AND NOT (beside AND (z1 > 1e0 OR (n1 >= 3 AND NOT paired))) AS pair2 FROM g),
v AS (SELECT bag, i, CASE WHEN pair1 THEN greatest(coalesce(a1, CASE WHEN rejected THEN s1 END), 0.3e0) ELSE a1 END AS "first", CASE WHEN pair2 THEN greatest(a2, 0.3e0) ELSE a2 END AS "second", CASE WHEN pair1 OR pair2 THEN greatest(sb, 0.3e0) ELSE sb END AS beam FROM h)
SELECT bag, i, 2 + ("first" IS NOT NULL)::BIGINT AS hits, "first", "second", beam FROM v"""


@query
def freshest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load shedding on a stream: of each micro-batch only the newest frame of a recording is served."""
    src = written(frames(spark, sf_dir).select("bag", "i", "dist").repartition(4, "bag"), "stream-in")
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 2).parquet(src.written_path)
    serve = lambda batch, _: freshest(batch, "bag", "i").write.mode("append").parquet(f"{base}/out")
    q = stream.writeStream.foreachBatch(serve).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(src.schema).parquet(f"{base}/out")


ORACLE_SQL["freshest_stream"] = f"WITH {FR} SELECT bag, max(i) AS i, arg_max(dist, i) AS dist FROM fr GROUP BY bag"
