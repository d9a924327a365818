"""Queries through the recording source: logs written from the events table by tasks, read in ranges, by filter, by rank and as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources.manifest import update_manifest
from ..sources.recording_source import message_at, read_recordings, recording_topics, register, write_recordings
from ..sources.recordings import completeness, expected_counts
from .state_queries import state_on_disk
from .views import FR, frames

QUERIES: dict = {}
ORACLE_SQL: dict = {}
#: A log holds so much time of a recording.
WEEK = 7 * 86_400_000_000_000


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages of a user's recording, on a topic a kind of event."""
    f = frames(spark, sf_dir)
    return f.select(
        F.concat(F.lit("bag_"), "bag").alias("bag"), F.concat(F.lit("/"), "event_type").alias("topic"), F.lit("events/Event").alias("type"),
        (F.col("t") * 1000).alias("timestamp"), F.to_binary(F.concat_ws(":", "event_id", "i", F.round("dist", 2)), F.lit("utf-8")).alias("data"),
    )


def recorded(spark: SparkSession, sf_dir: str) -> str:
    """A new folder of recordings, one log a week of each."""
    path = f"{shared_dir(spark)}/recordings-{uuid.uuid4().hex}"
    write_recordings(event_messages(spark, sf_dir), path, file_ns=WEEK)
    return path


_MSG = """m AS (SELECT 'bag_' || bag::VARCHAR AS bag, '/' || event_type AS topic, t * 1000 AS timestamp, event_id, i, event_id::VARCHAR || ':' || i::VARCHAR AS head,
  row_number() OVER (PARTITION BY bag, t * 1000 // 604800000000000 ORDER BY t, event_type) AS id, dense_rank() OVER (PARTITION BY bag ORDER BY t * 1000 // 604800000000000) - 1 AS log FROM fr)"""


@query(f"""WITH {FR}, {_MSG} SELECT bag, bag || '_' || log::VARCHAR || '.db3' AS file, topic, id, timestamp, head FROM m WHERE topic IN ('/error', '/signup') AND timestamp >= 1704672000000000000 AND id > 2""")
def recording_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of some topics, times and ids: each filter goes into the logs' own queries, each log is read in ranges of ids."""
    m = read_recordings(spark, recorded(spark, sf_dir), partition_bytes=1 << 20).where("topic in ('/error', '/signup') and timestamp >= 1704672000000000000 and id > 2")
    return m.select("bag", "file", "topic", "id", "timestamp", F.substring_index(F.decode("data", "utf-8"), ":", 2).alias("head"))


@query(f"""WITH {FR}, {_MSG} SELECT bag AS folder, topic, count(*) AS n, count(*) AS expected, count(*) AS wanted, true AS complete, count(DISTINCT log) AS logs, max(timestamp) - min(timestamp) AS span_ns FROM m GROUP BY ALL""")
def recording_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What logs hold, told by each log without reading its messages, against what the recordings' manifests tell."""
    path = recorded(spark, sf_dir)
    held = recording_topics(spark, path).where("error is null").withColumnRenamed("bag", "folder")
    told = expected_counts(spark, path).withColumn("folder", F.element_at(F.split("folder", "/"), -1))
    spans = held.groupBy("folder", "topic").agg(F.count_distinct("file").alias("logs"), (F.max("last_ns") - F.min("first_ns")).alias("span_ns"))
    return completeness(held, told).join(spans, ["folder", "topic"])


@query(f"""WITH {FR}, {_MSG}, r AS (SELECT *, row_number() OVER (PARTITION BY bag, log, topic ORDER BY timestamp, id) - 1 AS k FROM m)
SELECT bag, log, topic, timestamp, head FROM r WHERE topic = '/click' AND k = 2""")
def recording_nth_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third message of a topic of each log, the only one that is read."""
    m = message_at(spark, recorded(spark, sf_dir), "/click", 2)
    log = F.regexp_extract("file", r"_(\d+)\.db3$", 1).cast("long")
    return m.select("bag", log.alias("log"), "topic", "timestamp", F.substring_index(F.decode("data", "utf-8"), ":", 2).alias("head"))


@query(f"""WITH {FR}, {_MSG}, r AS (SELECT *, row_number() OVER (PARTITION BY bag, log, topic ORDER BY timestamp, id) - 1 AS k FROM m)
SELECT bag, log, topic, id, timestamp, substr(event_id::VARCHAR || ':', 1, 2) AS head FROM r WHERE k < 3""")
def recording_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three headers of each log's topics: two bytes of a message are read, the rest stays on disk."""
    m = read_recordings(spark, recorded(spark, sf_dir), head_bytes=2, first=3)
    log = F.regexp_extract("file", r"_(\d+)\.db3$", 1).cast("long")
    return m.select("bag", log.alias("log"), "topic", "id", "timestamp", F.decode("data", "utf-8").alias("head"))


@query(f"""WITH {FR}, {_MSG} SELECT bag, topic, count(*) AS n, min(timestamp) AS first_ns, max(timestamp) AS last_ns FROM m GROUP BY bag, topic""")
def recording_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs followed by a stream in two runs: the first sees half of the recordings, the second only what came since."""
    base = f"{shared_dir(spark)}/recordings-{uuid.uuid4().hex}"
    m = event_messages(spark, sf_dir)
    late = F.pmod(F.xxhash64("bag"), F.lit(2)) == 1
    for some in (m.where(~late), m.where(late)):
        write_recordings(some, f"{base}/in", file_ns=WEEK)
        register(spark)
        s = spark.readStream.format("recording").option("offsets", f"{base}/offsets").load(f"{base}/in")
        with state_on_disk(spark):
            q = s.select("bag", "topic", "timestamp").writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
            q.awaitTermination()
    out = spark.read.schema("bag string, topic string, timestamp long").parquet(f"{base}/out")
    return out.groupBy("bag", "topic").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first_ns"), F.max("timestamp").alias("last_ns"))


@query(f"""WITH {FR}, {_MSG} SELECT bag, log, topic, count(*) AS n, (1 + replace(bag, 'bag_', '')::BIGINT % 2)::INT AS read_in FROM m GROUP BY ALL""")
def recording_manifest_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored manifest over growing recordings: its second run reads only the logs that came since, its third nothing."""
    base = f"{shared_dir(spark)}/recordings-{uuid.uuid4().hex}"
    m = event_messages(spark, sf_dir)
    late = F.substring_index("bag", "_", -1).cast("long") % 2 == 1
    for some in (m.where(~late), m.where(late)):
        write_recordings(some, f"{base}/in", file_ns=WEEK)
        update_manifest(spark, f"{base}/in", f"{base}/manifest")
    got = update_manifest(spark, f"{base}/in", f"{base}/manifest").where("n > 0")
    parts = F.regexp_extract("path", r"/(bag_\d+)_(\d+)\.db3$", 1), F.regexp_extract("path", r"/(bag_\d+)_(\d+)\.db3$", 2).cast("long")
    return got.select(parts[0].alias("bag"), parts[1].alias("log"), "topic", "n", "read_in")
