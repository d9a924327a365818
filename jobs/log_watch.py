r"""Watch of text logs, a streaming job: takes the log files that came since the last run and judges each text.

Every row of ``documents*.parquet`` (files, or folders of files) is a log of a machine (``source``).  Told of each: lines with content, repeats (such lines equal to an
earlier one), the longest run of equal lines one after another (a stuck sender), lines with three symbols in a row (garbled output or
an alert mark) and the first of them, numbers in the text, and a state by the thresholds of the config.

A file stream with ``availableNow`` takes what is new and ends; its checkpoint holds which files were taken.  Spark's file sink
writes each batch once, by source, so a run that broke off is finished by the next one and a run without new files adds
nothing.  New logs come as new files: a file that is written again under its name is not read again.  All columns are row by
row, so a batch has no shuffle and a source with a third of all logs is split like any other.

Cases: a null or empty text, or one without content, is ``empty``; a null or empty source goes to the folder ``none``; repeated rows
come out as often as they come in; a text of any length is read whole; more columns in the files are not read.

    python -m jobs.log_watch --input DIR --output DIR --checkpoint DIR [--config FILE]
"""

from __future__ import annotations

import argparse
import json
import logging
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("jobs.log_watch")
CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "log_watch.json")
INPUT = "doc_id long, text string, source string"
SCHEMA = "doc_id long, source string, lines int, repeats int, stuck int, alerts int, first_alert int, numbers int, state string, folder string"
_CONTENT = r"[^ \t\r]"
_ALERT = r"[#*$%&|<>]{3}"


def longest_run(lines: Column) -> Column:
    """Length of the longest run of equal neighbours with content, folded over the array."""
    zero = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, line: Column) -> Column:
        n = F.when(~line.rlike(_CONTENT), 0).when(line == s["last"], s["run"] + 1).otherwise(1)
        return F.struct(line.alias("last"), n.alias("run"), F.greatest(s["best"], n).alias("best"))

    return F.aggregate(lines, zero, step, lambda s: s["best"])


def judged(logs: DataFrame, config: dict) -> DataFrame:
    """One row a log, of a stream or a table."""
    rows = logs.select("doc_id", "source", F.split(F.coalesce("text", F.lit("")), "\n").alias("all"), F.coalesce(F.regexp_count("text", F.lit("[0-9]+")), F.lit(0)).alias("numbers"))
    rows = rows.withColumn("full", F.filter("all", lambda x: x.rlike(_CONTENT))).withColumn("marks", F.transform("all", lambda x: x.rlike(_ALERT)))
    rows = rows.select(
        "doc_id", "source", F.size("full").alias("lines"), (F.size("full") - F.size(F.array_distinct("full"))).alias("repeats"), longest_run(F.col("all")).alias("stuck"),
        F.size(F.filter("marks", lambda m: m)).alias("alerts"), F.nullif(F.array_position("marks", True), F.lit(0)).cast("int").alias("first_alert"), "numbers",
    )
    over = lambda n, name: (F.col(n) > 0) & (F.col(n) * 100 >= F.col("lines") * int(config[name]))
    state = (
        F.when(F.col("lines") == 0, "empty").when(F.col("stuck") >= int(config["stuck_lines"]), "stuck")
        .when(over("alerts", "garbled_percent"), "garbled").when(over("repeats", "repeating_percent"), "repeating").otherwise("ok")
    )
    return rows.select("*", state.alias("state"), F.coalesce(F.nullif("source", F.lit("")), F.lit("none")).alias("folder"))


def run(spark: SparkSession, input_dir: str, output: str, checkpoint: str, config: dict | None = None) -> DataFrame:
    """Judge the logs of files that were not taken before, and give the whole output read back."""
    with open(CONFIG, encoding="utf-8") as f:
        config = json.load(f) | (config or {})
    logs = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", int(config["files_per_batch"])).option("maxFileAge", config["max_file_age"]).parquet(f"{input_dir}/documents*.parquet")
    stream = (
        judged(logs, config).writeStream.format("parquet").partitionBy("folder").option("path", output).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    stream.awaitTermination()
    batches = stream.recentProgress
    log.info("read %d new logs of %s in %d batches", sum(p.numInputRows for p in batches), input_dir, len(batches))
    out = spark.read.schema(SCHEMA).parquet(output)
    states = {r.state: r.n for r in out.groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}  # five states
    log.info("%s holds %d logs: %s", output, sum(states.values()), states)
    return out


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Watch of text logs")
    for name in ("--input", "--output", "--checkpoint"):
        p.add_argument(name, required=True)
    p.add_argument("--config")
    a = p.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    config = None
    if a.config:
        with open(a.config, encoding="utf-8") as f:
            config = json.load(f)
    spark = SparkSession.builder.appName("log_watch").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, a.input, a.output, a.checkpoint, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
