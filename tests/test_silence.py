"""Timers of silent keys: by the watermark against a plain walk, and by the machine's clock while nothing arrives."""

import datetime
import time

from pyspark.sql import functions as F

from rangeflow.plans.live_queries import run_in_slices
from rangeflow.plans.state_queries import state_on_disk
from rangeflow.streaming.silence import expected, first_tick, silence_watch

EPOCH = datetime.datetime(2024, 1, 1)
AT = lambda s: EPOCH + datetime.timedelta(seconds=s)
MS = 1_704_067_200_000


def plain(rows, starts, stale, every, until):
    """Every tick of every silence up to the last watermark."""
    out = []
    keys = {k for k, s in rows if s is not None} | set(starts)
    for key in keys:
        times = sorted(MS + int(s * 1000) for k, s in rows if k == key and s is not None)
        spoke = [(starts[key], False)] if key in starts else []
        spoke += [(t, True) for t in times]
        for (t, spoken), nxt in zip(spoke, [*[x[0] for x in spoke[1:]], None]):
            end = nxt - 1 if nxt is not None else until
            first = tick = first_tick(t, stale, every)
            while tick <= end:
                out.append((key, tick, tick - t, tick == first, "stale" if spoken else "no input"))
                tick += every
    return sorted(out, key=repr)


def test_ticks_of_silence(spark):
    rows = [("a", s / 10) for s in range(0, 40)] + [("a", 9.0), ("a", 9.1), ("a", 20.0), ("b", 1.0), ("b", 2.6), ("b", 2.6), (None, 3.0), ("c", None), ("b", 14.2), ("d", 30.0)]
    src = spark.createDataFrame([(k, None if s is None else AT(s)) for k, s in rows], "k string, ts timestamp")
    first = spark.createDataFrame([("a",), ("never",)], "k string")
    got = run_in_slices(spark, src.where("ts is not null"), "ts", [AT(2.55), AT(9.05), AT(19)], lambda s: silence_watch(s.withWatermark("ts", "2 seconds"), "k", "ts", 1500, 500, initial=expected(first, "k", MS - 3000)))
    want = plain(rows, {"a": MS - 3000, "never": MS - 3000}, 1500, 500, MS + 28_000)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want
    assert sum(r[3] for r in want if r[0] == "a") == 4 and [r for r in want if r[0] == "never"]


def test_a_null_time_is_no_row(spark):
    src = spark.createDataFrame([("a", None), ("b", AT(1)), ("b", AT(20))], "k string, ts timestamp")
    got = run_in_slices(spark, src, "ts", [], lambda s: silence_watch(s.withWatermark("ts", "1 second"), "k", "ts", 1500, 500))
    assert {r.k for r in got.collect()} == {"b"}


def test_unknown_while_nothing_arrives(spark, tmp_path):
    """On the machine's clock: rows come while the input is silent, one reset a silence, none while the key speaks."""
    spark.createDataFrame([("a",)], "k string").write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("k string").parquet(f"{tmp_path}/in").withColumn("ts", F.lit(None).cast("timestamp"))
    never = expected(spark.createDataFrame([("never",)], "k string"), "k", int(time.time() * 1000))
    watch = silence_watch(s, "k", "ts", 1500, 500, "ProcessingTime", never)
    with state_on_disk(spark):
        q = watch.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/mark").trigger(processingTime="300 milliseconds").start()
    read = lambda: spark.read.schema(watch.schema).parquet(f"{tmp_path}/out").collect()

    def wait(done):
        end = time.time() + 60
        while time.time() < end and not done([r for r in read() if r.k == "a"]):
            time.sleep(0.5)
        return [r for r in read() if r.k == "a"]

    try:
        while not q.recentProgress and q.isActive:
            time.sleep(0.2)
        got = wait(lambda rows: len(rows) >= 4)
        assert len(got) >= 4 and sum(r.reset for r in got) == 1 and all(r.silent_ms > 1500 for r in got)
        ticks = sorted(r.tick_ms for r in got)
        assert all(b - a == 500 for a, b in zip(ticks, ticks[1:])) and ticks[0] % 500 == 0
        spark.createDataFrame([("a",)], "k string").write.mode("append").parquet(f"{tmp_path}/in")
        again = wait(lambda rows: sum(r.reset for r in rows) == 2)
        assert sum(r.reset for r in again) == 2
        never = [r for r in read() if r.k == "never"]
        assert never and {r.reason for r in never} == {"no input"} and sum(r.reset for r in never) == 1
    finally:
        q.stop()
