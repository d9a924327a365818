"""The recording source: ranges, filters in the logs' own queries, ranks, streams by offsets, writing, failures, odd logs."""

import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from rangeflow.sources import recording_source as R
from rangeflow.sources.recordings import expected_counts


def messages(spark, n=400, bags=3):
    rows = [(f"bag {k % bags}", f"/t{k % 4}", None if k % 4 == 3 else f"kind{k % 4}", 1_000 * (k // bags) + k % bags, bytes([k % 256]) * (k % 50)) for k in range(n)]
    return spark.createDataFrame(rows, "bag string, topic string, type string, timestamp long, data binary"), rows


def told(df):
    return sorted(((r.bag, r.topic, r.timestamp, bytes(r.data)) for r in df.collect()), key=repr)


def want(rows, keep=lambda r: True):
    return sorted(((r[0], r[1], r[3], r[4]) for r in rows if keep(r)), key=repr)


@pytest.mark.parametrize("file_ns", [None, 20_000])
def test_round_trip_and_manifests(spark, tmp_path, file_ns):
    df, rows = messages(spark)
    R.write_recordings(df, f"file://{tmp_path}", file_ns=file_ns)
    assert told(R.read_recordings(spark, str(tmp_path))) == want(rows)
    logs = R.find_logs(str(tmp_path))
    assert len(logs) == 3 if file_ns is None else len(logs) > 6
    assert not [d for d in os.listdir(tmp_path) if d.startswith("_")]
    got = {(r.folder.split("/")[-1].replace("%20", " "), r.topic): r.expected for r in expected_counts(spark, str(tmp_path)).collect()}
    assert got == {(b, t): sum(r[0] == b and r[1] == t for r in rows) for b, t in {(r[0], r[1]) for r in rows}}
    held = R.recording_topics(spark, str(tmp_path)).groupBy("bag", "topic").agg(F.sum("n").alias("n"), F.min("first_ns").alias("lo")).collect()
    assert {(r.bag, r.topic): r.n for r in held} == got and all(r.lo == min(x[3] for x in rows if x[0] == r.bag and x[1] == r.topic) for r in held)
    for f in logs:  # in the order of time
        with sqlite3.connect(f) as db:
            times = [t for (t,) in db.execute("select timestamp from messages order by id")]
        assert times == sorted(times)


def test_ranges_and_filters(spark, tmp_path):
    df, rows = messages(spark)
    R.write_recordings(df, str(tmp_path))
    whole = R.read_recordings(spark, str(tmp_path), partition_bytes=4096)
    assert whole.rdd.getNumPartitions() > 6 and told(whole) == want(rows)
    for where, keep in [
        ("topic = '/t1'", lambda r: r[1] == "/t1"),
        ("topic in ('/t1', '/t3') and timestamp > 30000", lambda r: r[1] in ("/t1", "/t3") and r[3] > 30000),
        ("timestamp >= 30000 and timestamp < 90002 and bag = 'bag 1'", lambda r: 30000 <= r[3] < 90002 and r[0] == "bag 1"),
        ("type is null and id <= 20", None),
    ]:
        got = whole.where(where)
        if keep:
            assert told(got) == sorted(((r[0], r[1], r[3], r[4]) for r in rows if keep(r)), key=repr)
        else:
            assert got.count() == sum(r.type is None and r.id <= 20 for r in whole.collect()) > 0
    plan = whole.where("topic = '/t1' and timestamp > 5")._jdf.queryExecution().executedPlan().toString()
    assert "'/t1'" not in plan.split("Filter")[1].split("\n")[0] if "Filter" in plan else True
    reader = R.RecordingReader({"path": str(tmp_path)})
    left = list(reader.pushFilters([R.EqualTo(("topic",), "/t1"), R.LessThan(("bag",), "x"), R.GreaterThan(("timestamp",), 5), R.In(("id",), (1, 2))]))
    assert [f.attribute for f in left] == [("bag",)] and reader.wanted.values == ["/t1", 5, 1, 2]


def test_the_log_itself_filters(spark, tmp_path):
    """What a task gets from a log after filters went into it: no other row leaves the log."""
    df, rows = messages(spark, bags=1)
    R.write_recordings(df, str(tmp_path))
    reader = R.RecordingReader({"path": str(tmp_path), "partition_bytes": 4096})
    assert not list(reader.pushFilters([R.EqualTo(("topic",), "/t2"), R.LessThanOrEqual(("timestamp",), 100_000)]))
    parts = reader.partitions()
    got = [t for p in parts for b in reader.read(p) for t in zip(b["topic"].to_pylist(), b["timestamp"].to_pylist())]
    assert len(parts) > 2 and sorted(got) == sorted((r[1], r[3]) for r in rows if r[1] == "/t2" and r[3] <= 100_000)


def test_log_over_two_gigabytes(spark, tmp_path):
    df, rows = messages(spark, bags=1)
    R.write_recordings(df, str(tmp_path))
    log = R.find_logs(str(tmp_path))[0]
    os.truncate(log, 3 << 30)  # sparse: what lies behind the log's pages is never read
    whole = R.read_recordings(spark, log)
    assert whole.rdd.getNumPartitions() > 40 and told(whole) == sorted(((r[0], r[1], r[3], r[4]) for r in rows), key=repr)
    assert told(R.message_at(spark, log, "/t1", 5)) == [sorted(((r[0], r[1], r[3], r[4]) for r in rows if r[1] == "/t1"), key=lambda r: r[2])[5]]


def test_first_headers(spark, tmp_path):
    df, rows = messages(spark)
    R.write_recordings(df, str(tmp_path))
    got = R.read_recordings(spark, str(tmp_path), head_bytes=3, first=2).collect()
    assert len(got) == 3 * 4 * 2 and all(len(r.data) <= 3 for r in got)
    for bag, topic in {(r.bag, r.topic) for r in got}:
        assert sorted(r.timestamp for r in got if (r.bag, r.topic) == (bag, topic)) == sorted(r[3] for r in rows if r[:2] == (bag, topic))[:2]
    late = R.read_recordings(spark, str(tmp_path), first=2).where("timestamp > 3")  # the rank comes before the filter
    assert late.count() == sum(r.timestamp > 3 for r in got)


def test_odd_logs(spark, tmp_path):
    for name in ("broken", "empty", "old", "_hidden"):
        (tmp_path / name).mkdir()
    (tmp_path / "broken" / "a.db3").write_bytes(b"no log" * 1000)
    (tmp_path / "_hidden" / "a.db3").write_bytes(b"no log")
    for name, typed in (("empty", True), ("old", False)):
        with sqlite3.connect(tmp_path / name / "a.db3") as db:
            db.execute(f"create table topics (id integer primary key, name text{', type text' if typed else ''})")
            db.execute("create table messages (id integer primary key, topic_id integer, timestamp integer, data blob)")
            if not typed:
                db.execute("insert into topics values (1, '/x')")
                db.executemany("insert into messages values (?, 1, ?, ?)", [(7, 5, b"a"), (-3, 5, None), (10**12, 1, b"")])
        db.close()
    got = R.read_recordings(spark, str(tmp_path), partition_bytes=1024).collect()
    assert sorted((r.bag, r.id, r.error is not None) for r in got if r.bag == "old") == [("old", -3, False), ("old", 7, False), ("old", 10**12, False)]
    assert [(r.bag, r.error is not None) for r in got if r.bag != "old"] == [("broken", True)]
    assert {(r.bag, r.n) for r in R.recording_topics(spark, str(tmp_path)).collect()} == {("broken", None), ("old", 3)}
    (tmp_path / "nothing").mkdir()
    assert R.read_recordings(spark, f"{tmp_path}/nothing").count() == 0
    with pytest.raises(ValueError, match="mounted"):
        R.find_logs("hdfs://host/folder")


def test_recordings_that_are_there(spark, tmp_path):
    df, rows = messages(spark, 60)
    R.write_recordings(df, str(tmp_path))
    with pytest.raises(Exception, match="there already"):
        R.write_recordings(df, str(tmp_path))
    assert told(R.read_recordings(spark, str(tmp_path))) == sorted(((r[0], r[1], r[3], r[4]) for r in rows), key=repr)
    R.write_recordings(df.where("bag = 'bag 1'").limit(3), str(tmp_path), "overwrite")
    got = R.read_recordings(spark, str(tmp_path))
    assert got.where("bag = 'bag 1'").count() == 3 and got.where("bag <> 'bag 1'").count() == 40
    assert not [d for d in os.listdir(tmp_path) if d.startswith("_")]


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    df, _ = messages(spark, 60)
    bad = df.withColumn("timestamp", F.when((F.col("bag") == "bag 2") & (F.col("timestamp") > 10_000), F.raise_error(F.lit("broken row")).cast("long")).otherwise(F.col("timestamp")))
    with pytest.raises(Exception, match="broken row"):
        R.write_recordings(bad, str(tmp_path))
    assert [f for _, _, names in os.walk(tmp_path) for f in names] == []


def test_stream_takes_what_logs_grew_by(spark, tmp_path):
    df, rows = messages(spark, 120)
    logs, out, mark = f"{tmp_path}/logs", f"{tmp_path}/out", f"{tmp_path}/mark"
    R.write_recordings(df.where("bag <> 'bag 2'"), logs)

    def follow():
        R.register(spark)
        q = spark.readStream.format("recording").option("partition_bytes", 4096).load(logs).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(R.MESSAGES).parquet(out)

    assert follow().count() == 80 and follow().count() == 80
    R.write_recordings(df.where("bag = 'bag 2'"), logs)
    grown = R.find_logs(logs)[0]
    with sqlite3.connect(grown) as db:
        db.executemany("insert into messages (topic_id, timestamp, data) values (1, ?, ?)", [(10**9, b"new"), (10**9 + 1, b"newer")])
    db.close()
    got = follow()
    assert got.count() == 122 and got.select("bag", "file", "id").distinct().count() == 122
    assert got.where("timestamp >= 1000000000").count() == 2


def test_many_small_logs_are_left_to_few_tasks(spark, tmp_path, monkeypatch):
    """The driver opens no small log to plan a read, and neither writing nor reading takes tasks by the bytes of small logs alone."""
    df, _ = messages(spark, 400, 10)
    R.write_recordings(df, str(tmp_path), file_ns=10**9)
    whole = R.read_recordings(spark, str(tmp_path)).select("bag", "timestamp", "id").collect()
    assert len(whole) == df.count()
    monkeypatch.setattr(R, "TASKS", 3)
    monkeypatch.setattr(R, "opened", lambda f: 1 / 0)
    logs = R.find_logs(str(tmp_path))
    tasks = R.RecordingReader({"path": str(tmp_path), "partition_bytes": str(1 << 20)}).partitions()
    assert len(logs) > 3 and sorted(s.file for t in tasks for s in t.spans) == logs and all(s.hi is None for t in tasks for s in t.spans)
    many = R.packed([R.Span(str(k)) for k in range(1000)], 1 << 16)
    assert len(many) <= 4 and [s.file for t in many for s in t.spans] == [str(k) for k in range(1000)]
