"""Daily report of recordings, a batch job: what an operator of many sensors reads every morning.

A recording is a user's events in time order (``events`` of the input folder).  For every recording and day it tells frames,
detected and unknown frames, alarms that begin that day (a detected frame with none in the ``alarm_gap_s`` before it), sequences that
begin (a frame with none in the ``reset_gap_s`` before it), near frames, and the nearest, median and 95th-percentile distance.

The output is Parquet by day.  Without a range of days the whole output is replaced; with one, only its days are (Spark's dynamic
partition overwrite), from frames of the range and as far back as the longest gap.  So a run can be repeated, or late events be
taken in by running their days again, and the same input gives the same output.

A recording is worked on day by day, with what it carries over from the days before, so one that holds a third of all rows is no
single task.  Rows without a time or recording are left out and logged; a frame delivered twice (same recording, time and event) counts once.

    python -m jobs.drive_report --input DIR --output DIR [--config FILE] [--from-day 2024-01-01] [--to-day 2024-01-31]
"""

from __future__ import annotations

import argparse
import datetime
import json
import logging
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeflow.functions.columns import status_of
from rangeflow.operators.islands import last_before
from rangeflow.operators.quantiles import rank_quantiles

log = logging.getLogger("jobs.drive_report")
CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "drive_report.json")
SCHEMA = """bag long, frames long, detected long, unknown long, near long, alarms long, starts long, first_us long, last_us long,
nearest double, median double, p95 double, day date"""
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def day_rows(events: DataFrame, config: dict) -> DataFrame:
    """One row a recording and day of ``events``."""
    known = events.where("ts is not null and user_id is not null")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    f = known.select(F.col("user_id").alias("bag"), F.to_date("ts").alias("day"), t.alias("t"), "event_id", status_of(F.col("event_type")).alias("status"), F.col("value").alias("dist"))
    f = f.dropDuplicates(["bag", "day", "t", "event_id"])
    f = f.withColumn("alarm_t", F.when(F.col("status") == "detected", F.col("t")))
    f = last_before(f, ["bag"], "day", ["t", "event_id"], {"t": "before", "alarm_t": "alarm_before"})
    alone = lambda column, name: F.coalesce(F.col("t") - F.col(column) > int(config[name] * 1_000_000), F.lit(True))
    begins = F.col("alarm_t").isNotNull() & alone("alarm_before", "alarm_gap_s")
    days = f.groupBy("bag", "day").agg(
        F.count(F.lit(1)).alias("frames"), F.count_if(F.col("status") == "detected").alias("detected"), F.count_if(F.col("status") == "unknown").alias("unknown"),
        F.count_if(F.col("dist") < config["near_m"]).alias("near"), F.count_if(begins).alias("alarms"), F.count_if(alone("before", "reset_gap_s")).alias("starts"),
        F.min("t").alias("first_us"), F.max("t").alias("last_us"), F.min("dist").alias("nearest"),
    )
    ranks = rank_quantiles(f, ["bag", "day"], "dist", {"median": (0.5, "linear"), "p95": (0.95, "floor")}).drop("n")
    return days.join(ranks, ["bag", "day"], "left")


def run(spark: SparkSession, input_dir: str, output: str, config: dict | None = None, from_day: str | None = None, to_day: str | None = None) -> DataFrame:
    """Write the report of all days, or of ``from_day`` to ``to_day`` (both included), and give the whole output read back."""
    with open(CONFIG, encoding="utf-8") as f:
        config = json.load(f) | (config or {})
    events = spark.read.parquet(f"{input_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value")
    day = F.to_date("ts")
    lo, hi = (datetime.date.fromisoformat(d) if d else None for d in (from_day, to_day))
    if lo:  # frames before the range decide whether its first ones begin something
        back = datetime.timedelta(seconds=max(config["alarm_gap_s"], config["reset_gap_s"]))
        events = events.where(F.col("ts") >= F.lit(datetime.datetime.combine(lo, datetime.time()) - back).cast("timestamp_ntz"))
    if hi:
        events = events.where(day <= F.lit(hi))
    seen = events.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ts").isNull() | F.col("user_id").isNull()).alias("lost")).first()
    log.info("read %d events of %s, %d without a time or recording", seen.n, input_dir, seen.lost)
    rows = day_rows(events, config)
    if lo:
        rows = rows.where(F.col("day") >= F.lit(lo))
    fields = [c.split()[0] for c in SCHEMA.replace("\n", " ").split(", ")]
    rows = rows.select(*fields).repartition("day", (F.abs(F.xxhash64("bag")) % config["files_per_day"]).cast("int"))
    writer = rows.write.mode("overwrite").partitionBy("day")
    if lo or hi:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.parquet(output)
    out = spark.read.schema(SCHEMA).parquet(output)
    kept = out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("day").alias("days"), F.sum("frames").alias("frames")).first()
    log.info("%s holds %d rows of %d days and %d frames", output, kept.n, kept.days, kept.frames or 0)
    return out


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Daily report of recordings")
    for name in ("--input", "--output"):
        p.add_argument(name, required=True)
    for name in ("--config", "--from-day", "--to-day"):
        p.add_argument(name)
    a = p.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = None
    if a.config:
        with open(a.config, encoding="utf-8") as f:
            config = json.load(f)
    spark = SparkSession.builder.appName("drive_report").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, a.input, a.output, config, a.from_day, a.to_day)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
