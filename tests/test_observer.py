"""The observer beside a stream: counts a batch and stage, lost and doubled stamps, nulls, several queries, bounded memory."""

import datetime

from pyspark.sql import functions as F

from rangeflow.plans.live_queries import run_in_slices
from rangeflow.streaming.observer import METRICS, StampAudit, coverage, watched

AT = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)


def test_batches_and_stages(spark):
    src = spark.createDataFrame([(None if k == 7 else k, AT(k)) for k in range(20)], "t long, ts timestamp")
    audit = StampAudit()
    spark.streams.addListener(audit)
    try:
        out = run_in_slices(spark, src, "ts", [AT(5), AT(12), AT(100)], lambda s: watched(watched(s, "a", "t").where("t is null or t % 3 = 0 or t >= 12"), "b", "t").select("t"))
        other = run_in_slices(spark, src, "ts", [], lambda s: watched(s, "a", "t").select("t"))
        assert audit.wait(out.query_id) and audit.wait(other.query_id) and not audit.wait("no such query", 0.1)
    finally:
        spark.streams.removeListener(audit)
    table = audit.table(spark)
    rows = {(r.batch, r.stage): (r.rows, r.unstamped, r.first, r.last) for r in table.where(F.col("query") == out.query_id).collect()}
    assert rows == {(0, "a"): (5, 0, 0, 4), (0, "b"): (2, 0, 0, 3), (1, "a"): (7, 1, 5, 11), (1, "b"): (3, 1, 6, 9), (2, "a"): (8, 0, 12, 19), (2, "b"): (8, 0, 12, 19)}
    told = {r.batch: (r.sent, r.later, r.lost, r.same) for r in coverage(table.where(F.col("query") == out.query_id), "a", "b").collect()}
    assert told == {0: (5, 2, 3, False), 1: (7, 3, 4, False), 2: (8, 8, 0, True)}
    assert table.where(F.col("query") == other.query_id).count() == 1


def test_coverage_sees_swapped_and_missing_stamps(spark):
    audit = spark.createDataFrame([("q", 0, "a", 2, 0, 1, 2, "10"), ("q", 0, "b", 2, 0, 1, 2, "11"), ("q", 1, "a", 2, 0, 1, 2, "10")], METRICS)
    assert sorted(tuple(r)[1:] for r in coverage(audit, "a", "b").collect()) == [(0, 2, 2, 0, False), (1, 2, 0, 2, False)]


def test_memory_is_bounded(spark):
    from types import SimpleNamespace as Box

    audit = StampAudit(keep=3)
    for k in range(10):
        audit.onQueryProgress(Box(progress=Box(id="q", batchId=k, observedMetrics={"a": {"rows": 1, "unstamped": 0, "first": k, "last": k, "digest": "1"}})))
    audit.onQueryProgress(Box(progress=Box(id="q", batchId=10, observedMetrics={"a": {"rows": 0, "unstamped": 0, "first": None, "last": None, "digest": None}})))
    assert [r.batch for r in audit.table(spark).orderBy("batch").collect()] == [7, 8, 9]
    assert StampAudit().table(spark).count() == 0
