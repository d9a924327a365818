"""Operators whose work or driver's memory grew faster than their input, and queries on the limits of their rules."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from rangeflow.functions import columns as C


def test_equal_faces_and_beams_are_tested_once(spark):
    """Sixty copies of a scene's faces and beams are no more tests than one, and the least face wins."""
    from rangeflow.operators import mesh as M

    shape = lambda x, s: (x, -s, -s, x, s, -s, x, 0.0, s)
    kinds = [shape(5.0 + k, 0.3 + 0.01 * k) for k in range(12)]
    faces = spark.createDataFrame([(0, 12 * c + k + 1, *one) for c in range(60) for k, one in enumerate(kinds)], "scene int, face int, " + ", ".join(f"{c} double" for c in M.CORNERS))
    ways = [(1.0, 0.0005 * k, 0.0) for k in range(20)]
    beams = spark.createDataFrame([(0, 20 * c + k, *d) for c in range(60) for k, d in enumerate(ways)] + [(0, 0, 1.0, 0.0, -0.0), (0, 7, 1.0, 0.9, 0.0)], "scene int, beam int, dx double, dy double, dz double")
    n = {r.beam: r.n for r in M.cast_rays(beams.where("dy < 0.5"), faces, ["scene"], ["beam"], "face", tested=True).collect()}
    assert len(n) == 1200 and max(n.values()) <= len(kinds)
    got = {r.beam: (r.face, round(r.t, 6)) for r in M.cast_rays(beams, faces, ["scene"], ["beam"], "face").collect()}
    assert len(got) == 1200 and all(got[k] == got[k % 20] for k in got) and got[0] == (1, 5.0)


def test_what_the_driver_plans_of_many_logs_is_in_files(spark, tmp_path):
    """A read's tasks, a stream's offsets and a stream's tasks are as small for many logs as for few."""
    import pickle

    from rangeflow.sources import recording_source as R

    for n in (4, 400):
        rows = [(f"bag{k}", f"/t{i % 2}", "x", 1000 * i + k, b"data") for k in range(n) for i in range(3)]
        R.write_recordings(spark.createDataFrame(rows, "bag string, topic string, type string, timestamp long, data binary"), f"{tmp_path}/{n}")
    size, held = {}, {}
    for n in (4, 400):
        root = f"{tmp_path}/{n}"
        reader = R.RecordingReader({"path": root, "plans": f"{tmp_path}/plans"})
        stream = R.RecordingStream({"path": root, "offsets": f"{tmp_path}/offsets{n}", "partition_bytes": str(1 << 30)})
        end = stream.latestOffset()
        assert stream.latestOffset() == end and stream.partitions(end, end) == []
        size[n] = [len(pickle.dumps(x)) for x in (reader.partitions(), end, stream.partitions({}, end))]
        held[n] = sorted(t for p in stream.partitions({}, end) for b in stream.read(p) for t in b["timestamp"].to_pylist())
        assert held[n] == sorted(1000 * i + k for k in range(n) for i in range(3))
    assert all(b < 1.2 * a + 100 for a, b in zip(size[4], size[400]))


def test_offsets_of_a_stream_are_told_by_their_folder(spark, tmp_path):
    """A stream whose offsets are files takes what logs grew by, goes on from a checkpoint whose offsets tell each log, and keeps few files."""
    import os
    import sqlite3

    from rangeflow.sources import recording_source as R

    root, offsets = f"{tmp_path}/logs", f"{tmp_path}/offsets"
    rows = [(bag, "/t", "x", 1000 * i, b"data") for bag in ("a", "a b", "b/c", "b") for i in range(5)]
    df = spark.createDataFrame(rows, "bag string, topic string, type string, timestamp long, data binary")

    def follow(**more):
        R.register(spark)
        s = spark.readStream.format("recording").options(partition_bytes=4096, **more).load(root)
        s.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/mark").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(R.MESSAGES).parquet(f"{tmp_path}/out").select("bag", "file", "id").collect()

    R.write_recordings(df.where("bag in ('a', 'b')"), root)
    assert len(follow()) == 10
    R.write_recordings(df.where("bag = 'a b'"), root)
    assert len(follow(offsets=offsets)) == 15
    with sqlite3.connect(f"{root}/a/a_0.db3") as db:
        db.execute("insert into messages (topic_id, timestamp, data) values (1, 7, x'00')")
    db.close()
    got = follow(offsets=offsets)
    assert len(got) == len(set(got)) == 16 and len(follow(offsets=offsets)) == 16
    os.remove(f"{root}/a b/a b_0.db3")
    R.write_recordings(df.where("bag = 'a'").withColumn("bag", F.lit("0")), root)
    got = follow(offsets=offsets)
    assert len(got) == len(set(got)) == 21 and len(os.listdir(offsets)) < 8


def test_logs_are_not_listed_by_spark(spark, tmp_path, monkeypatch):
    """Spark's listing holds every file on the driver; folders that are mounted are listed in a file."""
    from pyspark.sql import DataFrameReader

    from rangeflow.sources import recording_source as R
    from rangeflow.sources import recordings

    rows = [(f"bag {k}", "/t", "x", 1000 * i, b"data") for k in range(3) for i in range(2)]
    R.write_recordings(spark.createDataFrame(rows, "bag string, topic string, type string, timestamp long, data binary"), f"{tmp_path}/logs")
    (tmp_path / "logs" / "_hidden").mkdir()
    for name in ("_hidden/a.db3", "bag 0/.a.db3", "bag 0/_a.db3", "bag 0/a.txt"):
        (tmp_path / "logs" / name).write_bytes(b"no log")
    root = f"file://{tmp_path}/logs"
    ours = [sorted(map(tuple, df.collect())) for df in (recordings.find_recordings(spark, root), recordings.expected_counts(spark, root))]
    with monkeypatch.context() as m:
        m.setattr(recordings, "listed_files", lambda *_: None)
        assert ours == [sorted(map(tuple, df.collect())) for df in (recordings.find_recordings(spark, root), recordings.expected_counts(spark, root))]
    assert [len(x) for x in ours] == [3, 3]
    formats, real = [], DataFrameReader.format
    monkeypatch.setattr(DataFrameReader, "format", lambda self, f: formats.append(f) or real(self, f))
    recordings.find_recordings(spark, root), recordings.expected_counts(spark, root)
    assert "binaryFile" not in formats


def test_a_settling_task_that_is_run_again_goes_on(tmp_path):
    """Half of a recording's logs were moved, or all of it was, when the task broke off."""
    import json
    import os

    import pyarrow as pa

    from rangeflow.sources import recording_source as R

    staging, root = tmp_path / "_staging", tmp_path
    staging.mkdir()
    rows = [("bag", str(staging / f"{k}.db3"), k, k, json.dumps({"/t": [1, "x", 1]})) for k in range(3)]
    for r in rows:
        with open(r[1], "w") as f:
            f.write(str(r[2]))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["bag", "file", "first", "last", "topics"])
    real, left = os.replace, [2]

    def breaks(a, b):
        left[0] -= 1
        if left[0] < 0:
            raise OSError("broke off")
        real(a, b)

    R.os.replace = breaks
    try:
        for _ in range(4):
            try:
                list(R._logs_settled(iter([batch]), str(root), str(staging)))
            except OSError:
                left[0] = 1
    finally:
        R.os.replace = real
    list(R._logs_settled(iter([batch]), str(root), str(staging)))
    assert sorted(os.listdir(root / "bag")) == ["bag_0.db3", "bag_1.db3", "bag_2.db3", "metadata.yaml"]
    assert [open(root / "bag" / f"bag_{k}.db3").read() for k in range(3)] == ["0", "1", "2"]


def test_sums_are_the_same_in_any_order(spark):
    """Rounded once, as ``math.fsum``; null, odd and huge values go as in a plain sum."""
    rng = random.Random(4)
    values = {g: [rng.choice([0.01 * rng.randrange(11) * 20 - 1, rng.uniform(-200, 200), rng.uniform(-1e-9, 1e-9), 1e7 + rng.random()]) for _ in range(60)] for g in range(40)}
    rows = [(g, v) for g, vs in values.items() for v in vs] + [(g, None) for g in range(41)]
    odd = [(50, 1e300), (50, 1.0), (51, float("nan")), (51, 1.0), (52, float("inf")), (53, -1e12), (53, 1e12), *[(54, 2.0**27)] * 5000]
    for _ in range(3):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows + odd, "g int, x double").repartition(7)
        got = {r.g: (r.s, r.a) for r in df.groupBy("g").agg(C.exact_sum(F.col("x")).alias("s"), C.exact_avg(F.col("x")).alias("a")).collect()}
        assert all(got[g] == (math.fsum(vs), math.fsum(vs) / 60) for g, vs in values.items())
        assert got[40] == (None, None) and got[50][0] == 1e300 and math.isnan(got[51][0]) and got[52][0] == float("inf") and got[53] == (0.0, 0.0) and got[54] == (5000 * 2.0**27, 2.0**27)
    over = df.where("g < 3").select("g", C.exact_sum(F.col("x"), Window.partitionBy("g")).alias("s")).distinct()
    assert {tuple(r) for r in over.collect()} == {(g, math.fsum(values[g])) for g in range(3)}


@pytest.mark.parametrize("name", ["chain_shape_range", "beam_group_classes"])
def test_averages_that_are_compared_with_limits_have_no_order(spark, name):
    """These averages decide at limits: their plans sum whole numbers."""
    from rangeflow.plans import catalog

    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    columns = {"chain_shape_range": ["l"], "beam_group_classes": ["h", "d", "l"]}[name]
    assert "rint" in plan.lower() and not any(f"avg({c}#" in plan for c in columns)
