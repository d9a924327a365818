"""The jobs as queries: each runs twice into a new folder of the shared one and gives what stands there then."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from rangeflow.session import shared_dir

from . import drive_report, log_watch


def job1_drive_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily report of all recordings, the second time into the folder of the first."""
    to = f"{shared_dir(spark)}/job1-{uuid.uuid4().hex}"
    drive_report.run(spark, sf_dir, f"{to}/report")
    return drive_report.run(spark, sf_dir, f"{to}/report")


def job2_log_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All logs judged by the stream; its second run has the first one's checkpoint and nothing new."""
    to = f"{shared_dir(spark)}/job2-{uuid.uuid4().hex}"
    log_watch.run(spark, sf_dir, f"{to}/logs", f"{to}/checkpoint")
    return log_watch.run(spark, sf_dir, f"{to}/logs", f"{to}/checkpoint")


QUERIES = {"job1_drive_report": job1_drive_report, "job2_log_watch": job2_log_watch}
ORACLE_SQL = {
    "job1_drive_report": """WITH f AS (SELECT DISTINCT user_id AS bag, ts::DATE AS day, epoch_us(ts) AS t, event_id, value AS dist,
  CASE event_type WHEN 'error' THEN 'detected' WHEN 'signup' THEN 'unknown' ELSE 'clear' END AS status FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
g AS (SELECT *, lag(t) OVER w AS before, max(CASE WHEN status = 'detected' THEN t END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS alarm_before,
  row_number() OVER (PARTITION BY bag, day ORDER BY dist) - 1 AS k, count(dist) OVER (PARTITION BY bag, day) AS n FROM f WINDOW w AS (PARTITION BY bag ORDER BY t, event_id))
SELECT bag, count(*) AS frames, count(*) FILTER (status = 'detected') AS detected, count(*) FILTER (status = 'unknown') AS unknown, count(*) FILTER (dist < 50) AS near,
  count(*) FILTER (status = 'detected' AND (alarm_before IS NULL OR t - alarm_before > 7200000000)) AS alarms, count(*) FILTER (before IS NULL OR t - before > 43200000000) AS starts,
  min(t) AS first_us, max(t) AS last_us, min(dist) AS nearest, quantile_cont(dist, 0.5) AS median, max(dist) FILTER (k = floor((n - 1) * 0.95e0)::BIGINT) AS p95, day
FROM g GROUP BY bag, day""",
    "job2_log_watch": """WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
l AS (SELECT rid, generate_subscripts(string_split(text, chr(10)), 1) AS k, unnest(string_split(text, chr(10))) AS line FROM d),
m AS (SELECT *, regexp_matches(line, '[^ \t\r]') AS held, regexp_matches(line, '[#*$%&|<>]{3}') AS mark, k - row_number() OVER (PARTITION BY rid, line ORDER BY k) AS run FROM l),
r AS (SELECT rid, max(n) AS stuck FROM (SELECT rid, count(*) AS n FROM m WHERE held GROUP BY rid, line, run) GROUP BY rid),
s AS (SELECT rid, (count(*) FILTER (held))::INT AS lines, ((count(*) FILTER (held)) - count(DISTINCT CASE WHEN held THEN line END))::INT AS repeats, (count(*) FILTER (mark))::INT AS alerts, (min(k) FILTER (mark))::INT AS first_alert FROM m GROUP BY rid)
SELECT doc_id, source, lines, repeats, coalesce(stuck, 0)::INT AS stuck, alerts, first_alert, len(regexp_extract_all(text, '[0-9]+'))::INT AS numbers,
  CASE WHEN lines = 0 THEN 'empty' WHEN stuck >= 3 THEN 'stuck' WHEN alerts > 0 AND alerts * 100 >= lines * 20 THEN 'garbled' WHEN repeats > 0 AND repeats * 100 >= lines * 50 THEN 'repeating' ELSE 'ok' END AS state,
  coalesce(nullif(source, ''), 'none') AS folder FROM d JOIN s USING (rid) LEFT JOIN r USING (rid)""",
}
