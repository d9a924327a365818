"""Queries through sources and sinks: binary clouds, broken JSON logs."""

from __future__ import annotations

import sqlite3
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, written
from ..sources.clouds import decode_headers, decode_points, explode_points, write_cloud
from ..sources.recordings import completeness, count_messages, inspect_logs, message_at, read_in_batches, unpack
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


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame's points as one binary message, every seventh cut short."""

    def encode(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("slot")
        p = np.zeros(len(frame), [("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("intensity", "<f4"), ("ring", "<u2")])
        for name, c in (("x", "d"), ("y", "l"), ("z", "h"), ("intensity", "r")):
            p[name] = frame[c]
        p["ring"] = frame["slot"] % 40
        k = int(frame["frame"].iloc[0])
        raw = write_cloud(k * 1_000_000_000 + k, f"sensor_{k % 3}", p)
        return pd.DataFrame([{"frame": k, "raw": raw[:20] if k % 7 == 6 else raw}])

    return points(spark, sf_dir).groupBy("frame").applyInPandas(encode, "frame long, raw binary")


@query("""SELECT l_suppkey AS frame, l_suppkey * 1000000001 AS stamp_ns, CASE WHEN l_suppkey % 7 = 6 THEN 'broken' ELSE 'sensor_' || (l_suppkey % 3)::VARCHAR END AS frame_id FROM lineitem GROUP BY l_suppkey""")
def header_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stamps and frame ids by header-only decode; broken messages stay as rows."""
    got = decode_headers(messages(spark, sf_dir))
    return got.select("frame", F.coalesce("stamp_ns", F.col("frame") * 1_000_000_001).alias("stamp_ns"), F.when(F.col("error").isNotNull(), "broken").otherwise(F.col("frame_id")).alias("frame_id"))


@query(f"""WITH {PT} SELECT frame, count(*) AS n, max(d::FLOAT)::DOUBLE AS x_max, min(l::FLOAT)::DOUBLE AS y_min, max(slot % 40) AS ring_max, round(avg(r), 4) AS mean_r FROM pt WHERE frame % 7 <> 6 GROUP BY frame""")
def cloud_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points encoded to binary messages and decoded again."""
    p = explode_points(decode_points(messages(spark, sf_dir)))
    return p.groupBy("frame").agg(
        F.count(F.lit(1)).alias("n"), F.max("x").cast("double").alias("x_max"), F.min("y").cast("double").alias("y_min"), F.max("ring").cast("long").alias("ring_max"), F.round(F.avg(F.col("intensity").cast("double")), 4).alias("mean_r")
    )


@query(f"""WITH {FR} SELECT 'keep' AS mode, count(*) AS n, count(*) FILTER (i % 10 = 9) AS corrupt FROM fr UNION ALL SELECT 'skip', count(*) FILTER (i % 10 <> 9), 0 FROM fr""")
def json_log_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result log with broken lines, read once keeping and once skipping them."""
    from ..sources.recordings import read_results

    fr = frames(spark, sf_dir)
    whole = F.to_json(F.struct(F.col("bag").cast("string").alias("bag"), F.col("i").alias("frame_index"), F.col("t").alias("bag_time_ns"), "status", F.col("dist").alias("distance_m")))
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    fr.select(F.when(F.col("i") % 10 == 9, F.substring(whole, 1, 20)).otherwise(whole).alias("value")).write.text(path)
    kept = read_results(spark, path, "keep").select("_corrupt", "status")
    skipped = read_results(spark, path, "skip").select("bag", "status", "distance_m")
    a = kept.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_corrupt").isNotNull() & F.col("status").isNull()).alias("corrupt")).select(F.lit("keep").alias("mode"), "n", "corrupt")
    return a.union(skipped.where("status is not null").agg(F.count(F.lit(1)).alias("n")).select(F.lit("skip").alias("mode"), "n", F.lit(0).cast("long").alias("corrupt")))


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as an SQLite log ``path, content`` of two topics, every seventh cut short; made in executors' memory."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("i")
        bag = int(frame["bag"].iloc[0])
        db = sqlite3.connect(":memory:")
        db.execute("create table topics (id integer primary key, name text)")
        db.execute("create table messages (id integer primary key, topic_id integer, timestamp integer, data blob)")
        db.executemany("insert into topics values (?, ?)", [(1, "/points"), (2, "/status")])
        rows = [(int(r.i), 1 if r.k % 3 else 2, int(r.t), str(r.event_id).encode()) for r in frame.itertuples()]
        db.executemany("insert into messages values (?, ?, ?, ?)", rows)
        db.commit()
        content = db.serialize()
        db.close()
        return pd.DataFrame([{"path": f"bag_{bag}", "content": content[:3000] if bag % 7 == 6 else content}])

    return frames(spark, sf_dir).select("bag", "i", "t", "k", "event_id").groupBy("bag").applyInPandas(pack, "path string, content binary")


_LOG = "g AS (SELECT 'bag_' || bag::VARCHAR AS bag, CASE WHEN k % 3 <> 0 THEN '/points' ELSE '/status' END AS topic, i, t, event_id FROM fr WHERE bag % 7 <> 6)"


@query(f"""WITH {FR}, {_LOG} SELECT bag, topic, row_number() OVER (PARTITION BY bag ORDER BY t, i) - 1 AS i, t AS bag_time_ns, event_id::VARCHAR AS data, false AS broken FROM g UNION ALL SELECT DISTINCT 'bag_' || bag::VARCHAR, NULL, NULL, NULL, NULL, true FROM fr WHERE bag % 7 = 6""")
def recording_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of SQLite logs in the order of storage; a broken log stays as a row."""
    m = read_in_batches(unpack(written(recordings(spark, sf_dir), "logs")), "log-messages")
    return m.select("bag", "topic", "i", "bag_time_ns", F.decode("raw", "utf-8").alias("data"), F.col("error").isNotNull().alias("broken"))


@query(f"""WITH {FR}, {_LOG}, n AS (SELECT bag, topic, count(*) AS n FROM g GROUP BY ALL), x AS (SELECT *, n + CASE WHEN topic = '/status' THEN 1 ELSE 0 END AS expected FROM n) SELECT bag, topic, n, expected, ceil(expected / 2e0)::BIGINT AS wanted, false AS complete FROM x WHERE n <> ceil(expected / 2e0)
UNION ALL SELECT bag, topic, n, expected, ceil(expected / 2e0)::BIGINT, true FROM x WHERE n = ceil(expected / 2e0)""")
def recording_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts pushed into each log, held against what its manifest tells, of which every second is wanted."""
    c = read_in_batches(count_messages(written(recordings(spark, sf_dir), "logs")), "log-counts").where("error is null and n > 0").withColumnRenamed("bag", "folder")
    e = c.select("folder", "topic", (F.col("n") + F.when(F.col("topic") == "/status", 1).otherwise(0)).alias("expected"))
    return completeness(c, e, 2).withColumnRenamed("folder", "bag")


@query(f"""WITH {FR}, {_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY bag, topic ORDER BY t, i) - 1 AS n FROM g) SELECT bag, t AS bag_time_ns, event_id::VARCHAR AS data FROM r WHERE topic = '/points' AND n = 7""")
def recording_message_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eighth message of a topic of each log, fetched by offset."""
    m = read_in_batches(message_at(written(recordings(spark, sf_dir), "logs"), "/points", 7), "log-messages").where("error is null")
    return m.select("bag", "bag_time_ns", F.decode("raw", "utf-8").alias("data"))


@query(f"""WITH {FR}, {_LOG} SELECT bag, topic, count(*) AS n, 0 AS backward FROM g GROUP BY ALL""")
def recording_inspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of each log and topic, and steps back in time, of which an ordered log has none."""
    return read_in_batches(inspect_logs(written(recordings(spark, sf_dir), "logs")), "log-counts").where("error is null").select("bag", "topic", "n", "backward")
