"""A stored manifest of recordings' logs: what each holds, read again only where a log changed.

A manifest is a folder of versions.  A run finds the logs, keeps the rows of those whose size, time and code version are as they were, reads the
others (in a mounted folder where they lie, else through Spark's binary reader), and writes the next version whole; a version counts once Spark has marked it as written, so a run that breaks off leaves
the one before in place.  The two newest versions stay, for readers of the older one.  A run that finds nothing new writes nothing.

Cases: logs that are gone leave the manifest; a file that is no log is a row with ``error`` and is not read again until it changes; a log
without topics is a row without one; no logs give an empty manifest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, written
from .recordings import changed, count_messages, find_recordings, read_in_batches

SCHEMA = "path string, bytes long, modified timestamp, version int, topic string, n long, error string, read_in int"
_KEY = ["path", "bytes", "modified", "version"]


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm.org.apache.hadoop.fs.Path


def versions(spark: SparkSession, store: str) -> list[int]:
    """Numbers of the versions that were written whole, in order."""
    fs, at, path = _files(spark, store)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    found = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()]
    return sorted(n for n in found if fs.exists(path(f"{store}/v{n}/_SUCCESS")))


def read_manifest(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """The newest version, or the one asked for; empty where there is none."""
    held = versions(spark, store)
    if version is None and not held:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(f"{store}/v{held[-1] if version is None else version}")


def update_manifest(spark: SparkSession, root: str, store: str) -> DataFrame:
    """Bring the manifest of the logs below ``root`` up to date and give it."""
    held = versions(spark, store)
    old = read_manifest(spark, store)
    found = find_recordings(spark, root).select(*_KEY)
    logs = old.select(*_KEY).distinct()
    fresh = written(changed(found, logs), "manifest-fresh")
    if held and fresh.isEmpty() and logs.join(found, _KEY, "left_anti").isEmpty():
        discard(fresh)
        return old
    number = held[-1] + 1 if held else 1
    kept = old.join(found, _KEY, "left_semi").select([c.split()[0] for c in SCHEMA.split(", ")])
    new = spark.createDataFrame([], SCHEMA)
    if not fresh.isEmpty():
        if fresh.where("path not like 'file:%'").isEmpty():
            files = fresh.select("path").repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        else:  # the driver names the files that are read, as Spark's own listing does
            files = spark.read.format("binaryFile").load([r.path for r in fresh.select("path").collect()]).select("path", "content")
        counted = count_messages(files)
        if "content" in files.columns:
            counted = read_in_batches(counted, "manifest-counts")
        new = fresh.join(counted.withColumnRenamed("bag", "path"), "path", "left").select(*_KEY, "topic", "n", "error", F.lit(number).alias("read_in"))
    fs, _, path = _files(spark, store)
    fs.delete(path(f"{store}/v{number}"), True)  # of a run that broke off
    kept.unionByName(new).write.parquet(f"{store}/v{number}")
    discard(fresh)
    for n in held[:-1]:
        fs.delete(path(f"{store}/v{n}"), True)
    return read_manifest(spark, store, number)
