"""Standard views of the driver tables: frames of a stream, points of a frame; Spark and SQL forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import status_of
from ..session import read_table


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as result frames of a recording (``bag``), numbered by time."""
    e = read_table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("bag"),
        (F.row_number().over(w) - 1).cast("long").alias("i"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
        status_of(F.col("event_type")).alias("status"),
        F.col("value").alias("dist"),
        F.regexp_extract("props", r'"k": *(-?\d+)', 1).cast("long").alias("k"),
        "event_id",
        "event_type",
    )


FR = r"""fr AS (
  SELECT user_id AS bag, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, epoch_us(ts) AS t,
         CASE event_type WHEN 'error' THEN 'detected' WHEN 'signup' THEN 'unknown' ELSE 'clear' END AS status,
         value AS dist, regexp_extract(props, '"k": *(-?\d+)', 1)::BIGINT AS k, event_id, event_type
  FROM events)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as points of a frame (one a supplier) with a total slot order."""
    li = read_table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    return li.select(
        F.col("l_suppkey").alias("frame"),
        (F.row_number().over(w) - 1).cast("long").alias("slot"),
        (F.col("l_extendedprice") / 500.0).alias("d"),
        (F.col("l_discount") * 20.0 - 1.0).alias("l"),
        (F.col("l_tax") * 40.0).alias("h"),
        F.col("l_quantity").alias("r"),
        F.col("l_returnflag").alias("flag"),
    )


PT = """pt AS (
  SELECT l_suppkey AS frame, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS slot,
         l_extendedprice / 500e0 AS d, l_discount * 20e0 - 1e0 AS l, l_tax * 40e0 AS h, l_quantity AS r, l_returnflag AS flag
  FROM lineitem)"""

BAND = """CASE WHEN {0} >= 0 AND {0} < 20 THEN '0-20' WHEN {0} >= 20 AND {0} < 50 THEN '20-50' WHEN {0} >= 50 AND {0} < 100 THEN '50-100'
  WHEN {0} >= 100 AND {0} < 150 THEN '100-150' WHEN {0} >= 150 AND {0} < 200 THEN '150-200' WHEN {0} >= 200 AND {0} < 300 THEN '200-300' END"""


def band_sql(x: str) -> str:
    return BAND.format(x)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First three components of the embeddings, scaled to tens of metres."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("label").cast("long").alias("label"), *[(F.col("embedding")[k].cast("double") * 10.0).alias(f"e{k}") for k in range(3)])


V3 = """v3 AS (SELECT vec_id, label::BIGINT AS label, embedding[1]::DOUBLE * 10e0 AS e0, embedding[2]::DOUBLE * 10e0 AS e1, embedding[3]::DOUBLE * 10e0 AS e2
  FROM embeddings)"""
