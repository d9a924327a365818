"""Sinks: JSON result logs by partition, and Markdown reports of small results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json_log(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """One JSON object a row; NaN and infinite numbers become null."""
    clean = [F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    w = df.select(*clean).write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).json(path)


def markdown(df: DataFrame, order: list[str], limit: int = 1000) -> str:
    """A Markdown table of a report's rows, at most ``limit`` of them."""
    rows = df.orderBy(*order).limit(limit).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns) + "\n"
    return head + "".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |\n" for r in rows)


def write_run(results: DataFrame, expected: int, path: str) -> dict:
    """A run's result log by recording and its summary beside it; tells whether the run is complete (exit 0) or not (exit 3)."""
    write_json_log(results, f"{path}/frames", ["bag"])
    times = F.percentile("processing_ms", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    s = results.agg(F.count(F.lit(1)).alias("n_done"), F.count_if(F.col("status") == "detected").alias("detected"), F.count_if(F.col("status") == "unknown").alias("unknown"), times.alias("t"))
    s = s.select("n_done", "detected", "unknown", *[F.round(F.col("t")[k], 3).alias(c) for k, c in enumerate(("p50_ms", "p95_ms", "p99_ms"))])
    s = s.select("*", F.lit(expected).alias("expected"), (F.col("n_done") == expected).alias("complete"))
    write_json_log(s, f"{path}/summary")
    row = results.sparkSession.read.json(f"{path}/summary").first().asDict()
    return row | {"exit": 0 if row["complete"] else 3}


def write_labels(labels: DataFrame, slots: DataFrame, path: str) -> None:
    """A scene set's labels: one object a frame with its ``objects``, and the sparse table ``frame, slot, obj_id``, by scene."""
    write_json_log(labels, f"{path}/labels", ["scene"])
    slots.select("scene", "frame", "slot", "obj_id").write.mode("overwrite").partitionBy("scene").parquet(f"{path}/slot_labels")


def report(title: str, tables: dict[str, tuple[DataFrame, list[str]]]) -> str:
    """A Markdown report of several small tables, each under its name, in the order given."""
    return f"# {title}\n" + "".join(f"\n## {name}\n\n{markdown(df, order)}" for name, (df, order) in tables.items())
