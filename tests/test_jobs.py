"""The jobs: reruns, growing input, days run again, odd rows, settings left as they were, and their command lines."""

from __future__ import annotations

import datetime
import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import drive_report, log_watch, registry
from rangeflow.operators.islands import last_before

from .conftest import ROOT, SF


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def settings(spark):
    return dict(spark.conf.getAll)


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event(k, hours, bag=1, kind="view", value=100.0):
    return (k, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hours), bag, kind, value, None)


def write_events(spark, folder, data):
    spark.createDataFrame(data, EVENTS).write.mode("overwrite").parquet(f"{folder}/events.parquet")


def test_report_by_hand(spark, tmp_path):
    data = [event(1, 20, kind="error", value=5.0), event(2, 21, kind="error"), event(3, 23.5), event(4, 24.5, kind="error"), event(5, 26.6, kind="error"), event(6, 40, kind="signup"), event(7, 40, bag=2)]
    data += [data[0], (8, None, 1, "error", 1.0, None), (9, data[0][1], None, "error", 1.0, None), (10, data[6][1], 2, None, None, None)]
    write_events(spark, tmp_path, data)
    got = {(r.bag, str(r.day)): r for r in drive_report.run(spark, str(tmp_path), f"{tmp_path}/out", {"alarm_gap_s": 3600 * 2.0}).collect()}
    assert set(got) == {(1, "2024-01-01"), (1, "2024-01-02"), (2, "2024-01-02")}
    first, second, other = got[1, "2024-01-01"], got[1, "2024-01-02"], got[2, "2024-01-02"]
    assert (first.frames, first.detected, first.alarms, first.starts, first.near, first.nearest) == (3, 2, 1, 1, 1, 5.0)
    assert (second.frames, second.detected, second.unknown, second.alarms, second.starts) == (3, 2, 1, 2, 1)  # 21:00 to 00:30 is over two hours
    assert (other.frames, other.starts, other.near, other.nearest, other.median) == (2, 1, 0, 100.0, 100.0)


def test_days_run_again_equal_the_whole(spark, tmp_path):
    out, part = f"{tmp_path}/whole", f"{tmp_path}/part"
    whole = rows(drive_report.run(spark, SF, out))
    before = settings(spark)
    drive_report.run(spark, SF, part)
    days = sorted({r[-1] for r in whole})
    lo, hi = days[len(days) // 3], days[2 * len(days) // 3]
    wrong = spark.createDataFrame(spark.read.schema(drive_report.SCHEMA).parquet(part).where(F.col("day").between(lo, hi)).withColumn("frames", F.lit(-1).cast("long")).collect(), drive_report.SCHEMA)
    wrong.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(part)
    assert rows(spark.read.schema(drive_report.SCHEMA).parquet(part)) != whole
    assert rows(drive_report.run(spark, SF, part, from_day=str(lo), to_day=str(hi))) == whole
    assert rows(drive_report.run(spark, SF, f"{tmp_path}/some", from_day=str(lo), to_day=str(hi))) == [r for r in whole if lo <= r[-1] <= hi]
    assert rows(drive_report.run(spark, SF, part)) == whole and settings(spark) == before


def test_growing_events_touch_only_their_days(spark, tmp_path):
    data = [event(k, k * 5, bag=k % 3, kind="error" if k % 4 == 0 else "view") for k in range(60)]
    write_events(spark, tmp_path, data[:40])
    out = f"{tmp_path}/out"
    drive_report.run(spark, str(tmp_path), out)
    files = lambda: {f for d, _, names in os.walk(out) for f in (f"{os.path.basename(d)}/{n}" for n in names) if f.endswith(".parquet")}
    old = files()
    write_events(spark, tmp_path, data)
    day = str((datetime.date(2024, 1, 1) + datetime.timedelta(hours=40 * 5)))
    grown = rows(drive_report.run(spark, str(tmp_path), out, from_day=day))
    assert grown == rows(drive_report.run(spark, str(tmp_path), f"{tmp_path}/fresh"))
    assert {f for f in old if f.split("=")[1][:10] < day} <= files()


def test_report_of_no_events(spark, tmp_path):
    write_events(spark, tmp_path, [])
    for _ in range(2):
        assert drive_report.run(spark, str(tmp_path), f"{tmp_path}/out").count() == 0


def test_last_before_equals_one_window(spark):
    data = [(k % 3, k // 7, k, None if k % 4 else k) for k in range(90)]
    df = spark.createDataFrame(data, "key int, part int, i int, v int")
    got = {(r.key, r.i): r.p for r in last_before(df, ["key"], "part", ["i"], {"v": "p"}).collect()}
    for key in range(3):
        last = None
        for _, _, i, v in sorted((r for r in data if r[0] == key), key=lambda r: r[2]):
            assert got[key, i] == last
            last = v if v is not None else last


LOGS = "doc_id long, text string, lang string, source string, n_chars long"


def add_logs(spark, folder, data):
    spark.createDataFrame([(k, t, "en", s, 0) for k, t, s in data], LOGS).coalesce(1).write.mode("append").parquet(f"{folder}/documents.parquet")


def test_watch_by_hand(spark, tmp_path):
    data = [(1, "a\na\na\nb 12 7", "x"), (2, "ok\n\n \nok ###", "x"), (3, None, "y"), (4, " \n\t", None), (5, "p\n\np\nq\nr", ""), (6, "s", "z"), (6, "s", "z"), (7, "u\nv\nu\nv", "z"), (8, "w" * 300_000 + "\n" + "x\n" * 50_000, "z")]
    add_logs(spark, tmp_path, data)
    got = log_watch.run(spark, str(tmp_path), f"{tmp_path}/out", f"{tmp_path}/mark").collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == len(data)
    told = lambda k: tuple(by_id[k])[2:9]
    assert told(1) == (4, 2, 3, 0, None, 2, "stuck") and told(2) == (2, 0, 1, 1, 4, 0, "garbled")
    assert told(3) == told(4) == (0, 0, 0, 0, None, 0, "empty")
    assert told(5) == (4, 1, 1, 0, None, 0, "ok") and told(7) == (4, 2, 1, 0, None, 0, "repeating")
    assert told(8)[:3] == (50_001, 49_999, 50_000)
    assert by_id[4].folder == by_id[5].folder == "none" and by_id[5].source == "" and by_id[4].source is None


def test_watch_takes_only_what_is_new(spark, tmp_path, caplog):
    out, mark = f"{tmp_path}/out", f"{tmp_path}/mark"
    first = [(k, f"line {k}\n" * (k % 5), f"s{k % 3}") for k in range(30)]
    second = [(k, f"more {k}\nmore {k}", f"s{k % 4}") for k in range(30, 50)]
    before = settings(spark)
    add_logs(spark, tmp_path, first)
    with caplog.at_level("INFO"):
        one = rows(log_watch.run(spark, str(tmp_path), out, mark))
        assert len(one) == 30 and rows(log_watch.run(spark, str(tmp_path), out, mark)) == one
        add_logs(spark, tmp_path, second)
        two = rows(log_watch.run(spark, str(tmp_path), out, mark))
    assert [m.split(" new logs")[0] for m in caplog.messages if "new logs" in m] == ["read 30", "read 0", "read 20"]
    assert set(one) < set(two) and len(two) == 50 and settings(spark) == before
    fresh = log_watch.run(spark, str(tmp_path), f"{tmp_path}/other", f"{tmp_path}/other-mark", {"files_per_batch": 1})
    assert rows(fresh) == two
    again = spark.read.schema(log_watch.INPUT).parquet(f"{tmp_path}/documents.parquet")
    with open(log_watch.CONFIG, encoding="utf-8") as f:
        assert rows(log_watch.judged(again, json.load(f))) == two


def test_watch_finishes_a_run_that_broke_off(spark, tmp_path, monkeypatch):
    out, mark = f"{tmp_path}/out", f"{tmp_path}/mark"
    for k in range(3):
        add_logs(spark, tmp_path, [(k, f"t{k}", "s")])
    good = log_watch.judged
    fail = F.raise_error(F.lit("broken sink"))
    monkeypatch.setattr(log_watch, "judged", lambda logs, c: good(logs, c).withColumn("lines", F.when(F.col("doc_id") == 1, fail.cast("int")).otherwise(F.col("lines"))))
    with pytest.raises(Exception, match="broken sink"):
        log_watch.run(spark, str(tmp_path), out, mark, {"files_per_batch": 1})
    monkeypatch.setattr(log_watch, "judged", good)
    got = log_watch.run(spark, str(tmp_path), out, mark, {"files_per_batch": 1})
    assert sorted(r.doc_id for r in got.collect()) == [0, 1, 2]


def test_queries_use_new_folders(spark):
    a, b = (registry.job2_log_watch(spark, SF).inputFiles()[0].split("/job2-")[1].split("/")[0] for _ in range(2))
    assert a != b


def test_command_lines(tmp_path):
    env = os.environ | {"PYTHONPATH": ROOT}
    run = lambda *a: subprocess.run([sys.executable, "-m", *a], cwd=ROOT, env=env, capture_output=True, text=True, timeout=240)
    a = run("jobs.drive_report", "--input", SF, "--output", f"{tmp_path}/a", "--to-day", "2024-01-10")
    assert a.returncode == 0 and "read " in a.stderr and " holds " in a.stderr, a.stderr[-2000:]
    (tmp_path / "c.json").write_text(json.dumps({"stuck_lines": 2}))
    b = run("jobs.log_watch", "--input", SF, "--output", f"{tmp_path}/b", "--checkpoint", f"{tmp_path}/m", "--config", f"{tmp_path}/c.json")
    assert b.returncode == 0 and "new logs" in b.stderr and " holds 200 logs" in b.stderr, b.stderr[-2000:]
