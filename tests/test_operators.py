"""Operators on small literal tables: edges, ties, traps."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rangeflow.config import Thresholds
from rangeflow.functions import columns as C
from rangeflow.operators import cells, fit, islands, match, profiles, robust
from rangeflow.operators.graph import connected_components
from rangeflow.operators.quantiles import rank_quantiles, robust_nearest
from rangeflow.sources import clouds, recordings, sinks


def test_thresholds():
    assert Thresholds.from_mapping({"roi_l": 5.0}).roi_l == 5.0
    with pytest.raises(KeyError):
        Thresholds.from_mapping({"no_such": 1})


def test_components_shapes(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000 + k, 1000 + (k + 1) % 30) for k in range(30)] + [(2000, 2000 + k) for k in range(1, 50)]
    edges += [(5000, 5000), (0, 1), (1, 0), (None, 7)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {k: 0 for k in range(201)} | {1000 + k: 1000 for k in range(30)} | {2000 + k: 2000 for k in range(50)} | {5000: 5000}


@pytest.mark.parametrize("n", [1, 2, 4, 9, 10, 11, 51])
def test_quantile_conventions(spark, n):
    v = [float((k * 7919) % 101) for k in range(n)]
    df = spark.createDataFrame([(1, x) for x in v] + [(1, None)], "g int, x double")
    want = {"f": (0.98, "floor"), "i": (0.98, "int"), "r": (0.98, "round"), "u": (0.5, "upper"), "l": (0.98, "linear")}
    r = rank_quantiles(df, ["g"], "x", want).first()
    s = sorted(v)
    assert r.f == s[math.floor((n - 1) * 0.98)] and r.i == s[min(n - 1, math.floor(n * 0.98))] and r.r == s[round((n - 1) * 0.98)] and r.u == s[n // 2]
    assert abs(r.l - np.percentile(v, 98)) < 1e-9
    near = df.groupBy("g").agg(robust_nearest("x").alias("d")).first().d
    assert abs(near - (np.percentile(v, 10) if n >= 10 else min(v))) < 1e-9


def test_band_edges_and_validity(spark):
    rows = spark.createDataFrame([(x,) for x in (0.0, 20.0, 49.99, 50.0, 200.0, 299.9, 300.0, -1.0, None)], "d double")
    assert [r.b for r in rows.select(C.band_label(F.col("d")).alias("b")).collect()] == ["0-20", "20-50", "20-50", "50-100", "200-300", "200-300", None, None, None]
    pts = spark.createDataFrame([(0.0, 0.0, 0.0), (0.0, 1.0, 0.0), (float("nan"), 1.0, 1.0), (float("inf"), 1.0, 1.0), (None, 1.0, 1.0), (-0.0, 0.0, 0.0)], "x double, y double, z double")
    assert [r.v for r in pts.select(C.is_valid_point(F.col("x"), F.col("y"), F.col("z")).alias("v")).collect()] == [False, True, False, False, False, False]


def test_wrap_erf_quantise(spark):
    r = spark.range(1).select(
        *[C.wrap_deg(F.lit(float(a))).alias(f"w{k}") for k, a in enumerate((180, -180, 181, 540, -190))], C.erf(F.lit(0.7)).alias("e"), C.quantise(F.lit(0.5), 1.0).alias("q0"), C.quantise(F.lit(1.5), 1.0).alias("q1")
    ).first()
    assert list(r)[:5] == [180.0, 180.0, -179.0, 180.0, 170.0] and abs(r.e - math.erf(0.7)) < 2e-7 and (r.q0, r.q1) == (0.0, 2.0)


def test_resets_and_gaps(spark):
    s = 1_000_000_000
    stamps = [0, s // 10, None, -10 * s, -10 * s + s // 10, -5 * s]
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate(stamps)], "b int, i int, t long")
    got = [(r.reset, r.epoch) for r in islands.reset_epochs(df, ["b"], ["i"], "t", 1_000_000, 1_500_000_000).orderBy("i").collect()]
    assert got == [(False, 0), (False, 0), (False, 0), (True, 1), (False, 1), (True, 2)]
    v = spark.createDataFrame([(1, k, x) for k, x in enumerate([None, 1.0, None, None, 4.0, None])], "b int, i int, x double")
    assert [r.f for r in islands.fill_linear(v, ["b"], "i", "x", "f").orderBy("i").collect()] == [1.0, 1.0, 2.0, 3.0, 4.0, 4.0]


def test_interval_priority(spark):
    iv = spark.createDataFrame([(0, 40, "clear", 1), (16, 62, "obstacle", 2), (50, 55, "uncertain", 0)], "lo int, hi int, label string, seq int")
    rows = spark.createDataFrame([(k, k) for k in (0, 16, 40, 41, 52, 62, 63)], "row_id int, day int")
    got = {r.row_id: r.label for r in match.interval_label(rows, "day", iv, 25.0).collect()}
    assert got == {0: "clear", 16: "obstacle", 40: "obstacle", 41: "obstacle", 52: "uncertain", 62: "obstacle", 63: None}


def test_near_far_ties(spark):
    df = spark.createDataFrame([(1, 5, 2.0), (1, 3, 2.0), (1, 9, 7.0), (1, 4, 7.0)], "c int, slot int, r double")
    r = cells.near_far_per_cell(df, ["c"], "r", "slot").first()
    assert (r.near_slot, r.far_slot, r.n) == (3, 9, 4)


def test_radius_pairs_equal_brute_force(spark):
    p = np.random.default_rng(1).random((150, 3)) * 4 - 2
    df = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(p)], "id int, x double, y double, z double")
    got = {(r.a, r.b) for r in match.radius_pairs(df, [], ["x", "y", "z"], "id", 0.6).collect()}
    assert got == {(i, j) for i in range(150) for j in range(i + 1, 150) if np.linalg.norm(p[i] - p[j]) <= 0.6}


def test_quadratic_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.random(60) * 10
    y, w = 1 + 2 * x + 0.3 * x * x + rng.normal(0, 0.1, 60), rng.random(60) + 0.5
    df = spark.createDataFrame([(1, *map(float, t)) for t in zip(x, y, w)], "g int, x double, y double, w double")
    for limit in (1.0, 0.1):
        r = fit.weighted_quadratic(df, ["g"], F.col("x"), F.col("y"), F.col("w"), limit).first()
        assert np.allclose([r.a, r.b, r.c], quadratic(x, y, w, limit), atol=1e-6)


def quadratic(x, y, w, c_max):
    """Weighted least squares by NumPy; beyond ``c_max`` the quadratic term is that and the rest refit."""
    s, a = np.sqrt(w), np.stack([np.ones_like(x), x, x * x], 1)
    coef = np.linalg.lstsq(a * s[:, None], y * s, rcond=None)[0]
    if abs(coef[2]) <= c_max:
        return coef
    c = float(np.clip(coef[2], -c_max, c_max))
    return np.array([*np.linalg.lstsq(a[:, :2] * s[:, None], (y - c * x * x) * s, rcond=None)[0], c])


def test_kept_fits_match_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.random(80) * 10
    y, w, keep = 1 + 2 * x + 0.3 * x * x + rng.normal(0, 0.1, 80), rng.random(80) + 0.5, rng.random(80) > 0.3
    df = spark.createDataFrame([(1, *map(float, t), bool(k)) for *t, k in zip(x, y, w, keep)], "g int, x double, y double, w double, keep boolean")
    for limit in (1.0, 0.1, 0.0):
        r = profiles.fit_kept(df, ["g"], F.lit(limit)).first()
        assert r.fn == keep.sum() and np.allclose([r.fa, r.fb, r.fc], quadratic(x[keep], y[keep], w[keep], limit), atol=1e-6)


def test_robust_steps():
    x = np.arange(12.0)
    y = 0.5 * x
    y[5] = 9
    assert robust.gated_chain(x, y, 0.3).tolist() == [k != 5 for k in range(12)] or not robust.gated_chain(x, y, 0.3)[5]
    assert robust.best_path(np.array([[0, 5, 5], [5, 0, 1], [5, 5, 0.0]]), 0.1).tolist() == [0, 1, 2]
    assert robust.link([[(1.0, 0.0), (50.0, 0.0)], [(49.0, 0.0), (2.0, 0.0)]], 5.0, 3) == [[0, 1], [1, 0]]
    assert robust.link([[(1.0, 0.0)], [(1.5, 0.0)]], 5.0, 3, [0, 4]) == [[0], [1]] and robust.link([[(1.0, 0.0)], [(1.5, 0.0)]], 5.0, 3, [0, 3]) == [[0], [0]]
    assert len(robust.spaced(np.array([10.0, 11.0, 10.0]), 5.0)) == 3


@pytest.mark.parametrize("big", [False, True])
def test_cloud_round_trip_and_errors(spark, big):
    o = ">" if big else "<"
    p = np.zeros(3, [("x", o + "f4"), ("y", o + "f4"), ("z", o + "f4"), ("ring", o + "u2")])
    p["x"], p["ring"] = [1.5, np.nan, 3.0], [1, 2, 3]
    raw = clouds.write_cloud(1_700_000_000_123_456_789, "lidar", p, big)
    assert clouds.read_header(raw) == (1_700_000_000_123_456_789, "lidar")
    twice = clouds.write_cloud(1, "f", np.zeros(1, [("x", "<f4"), ("y", "<f4")]))
    df = spark.createDataFrame([(0, raw), (1, raw[:30]), (2, None), (3, twice)], "k long, raw binary")
    got = {r.k: r for r in clouds.decode_points(df).collect()}
    assert [q.x for q in got[0].points] == [1.5, None, 3.0] and [q.ring for q in got[0].points] == [1, 2, 3] and got[0].points[0].intensity is None
    assert all(got[k].error and not got[k].points for k in (1, 2, 3))


def test_malformed_clouds_are_rows(spark):
    """Whatever is wrong with a message, it becomes a row with an error; odd rings become null."""
    import random
    import struct

    p = np.zeros(2, [("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("ring", "<f4")])
    p["ring"] = [1.5, 7]
    good = clouds.write_cloud(5, "f", p)
    huge = np.zeros(1, [("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("ring", "<u4")])
    huge["ring"] = 2**31 + 1
    bad = [b"\0\3" + good[2:], b"\1\1" + good[2:], b"", b"\0\1", good[:-30], good.replace(struct.pack("<I", 0) + b"\x07", struct.pack("<I", 0) + b"\x63", 1)]
    array = clouds.write_cloud(5, "f", p)
    at = array.index(b"x\0") + 2
    at += -(at - 4) % 4 + 4 + 1  # past the offset and the kind
    at += -(at - 4) % 4
    bad.append(array[:at] + struct.pack("<I", 2) + array[at + 4 :])
    rng = random.Random(3)
    noise = []
    for _ in range(200):
        b = bytearray(good)
        for _ in range(rng.randrange(1, 4)):
            b[rng.randrange(len(b))] = rng.randrange(256)
        noise.append(bytes(b[: rng.randrange(1, len(b) + 1)]) if rng.random() < 0.3 else bytes(b))
    df = spark.createDataFrame([(k, m) for k, m in enumerate([good, clouds.write_cloud(1, "g", huge), *bad, *noise])], "k long, raw binary")
    got = {r.k: r for r in clouds.decode_points(df).collect()}
    assert len(got) == 2 + len(bad) + len(noise) and [x.ring for x in got[0].points] == [None, 7] and got[1].points[0].ring is None
    assert all(got[2 + k].error for k in range(len(bad)))
    assert clouds.decode_headers(df).count() == len(got)


def test_recordings(spark, tmp_path):
    import sqlite3

    (tmp_path / "a").mkdir()
    db = sqlite3.connect(tmp_path / "a" / "one.db3")
    db.executescript("create table topics(id integer, name text); create table messages(id integer, topic_id integer, timestamp integer, data blob)")
    db.executemany("insert into topics values (?, ?)", [(1, "/p"), (2, "/q")])
    db.executemany("insert into messages values (?, ?, ?, ?)", [(1, 1, 10, b"a"), (2, 2, 11, b"b"), (3, 1, 9, b"c")])
    db.commit()
    db.close()
    (tmp_path / "a" / "bad.db3").write_bytes(b"no database at all, but long enough to be looked at" * 20)
    root = f"file://{tmp_path}"
    m = recordings.read_messages(spark, root)
    good = [(r.topic, r.i, r.bag_time_ns, bytes(r.raw)) for r in m.where("error is null").orderBy("i").collect()]
    assert good == [("/p", 0, 9, b"c"), ("/p", 1, 10, b"a"), ("/q", 2, 11, b"b")] and m.where("error is not null").count() == 1
    assert recordings.read_messages(spark, root, "/q").where("error is null").count() == 1
    counts = recordings.topic_counts(m)
    assert recordings.pick_topic(counts, "/q") == "/q"
    with pytest.raises(ValueError):
        recordings.pick_topic(counts)
    found = recordings.find_recordings(spark, root)
    assert found.count() == 2 and recordings.changed(found, found).count() == 0
    assert recordings.changed(found, found.withColumn("version", F.lit(1))).count() == 2
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.db3").load(root + "/a").select("path", "content")
    counted = {(r.topic, r.n) for r in recordings.count_messages(files).where("error is null").collect()}
    assert counted == {("/p", 2), ("/q", 1)} and recordings.count_messages(files).where("error is not null").count() == 1
    assert [bytes(r.raw) for r in recordings.message_at(files, "/p", 1).where("error is null").collect()] == [b"a"]
    assert recordings.message_at(files, "/p", 2).where("error is null").count() == 0


METADATA = """rosbag2_bagfile_information:
  version: 5
  storage_identifier: sqlite3
  topics_with_message_count:
    - topic_metadata:
        name: /p
        type: sensor_msgs/msg/PointCloud2
        serialization_format: cdr
      message_count: 3
    - topic_metadata:
        name: '/q'
        type: std_msgs/msg/String
      message_count: 1
"""


def test_manifests_and_discovery(spark, tmp_path):
    """Counts that manifests tell, logs inside another recording or too far down left out, completeness and findings."""
    for place in ("one", "one/inner", "a/b/c/d/e", ".hidden", "two"):
        (tmp_path / place).mkdir(parents=True)
        (tmp_path / place / "x.db3").write_bytes(b"x")
    (tmp_path / "one" / "metadata.yaml").write_text(METADATA)
    root = f"file://{tmp_path}"
    assert sorted(r.path.split(str(tmp_path))[-1] for r in recordings.find_recordings(spark, root, 4).collect()) == ["/one/x.db3", "/two/x.db3"]
    assert recordings.find_recordings(spark, root, 5).count() == 3
    e = recordings.expected_counts(spark, root)
    assert sorted((r.topic, r.kind, r.expected) for r in e.collect()) == [("/p", "sensor_msgs/msg/PointCloud2", 3), ("/q", "std_msgs/msg/String", 1)]
    folder = e.first().folder
    counts = spark.createDataFrame([(folder, "/p", 2, 1), (folder, "/r", 1, 0)], "folder string, topic string, n long, backward long")
    got = {r.topic: (r.n, r.wanted, r.complete) for r in recordings.completeness(counts, e, 2).collect()}
    assert got == {"/p": (2, 2, True), "/q": (0, 1, False)}
    found = {r.topic: (r.problem, r.note) for r in recordings.inspect(counts, e).collect()}
    assert found == {"/p": ("messages missing", "1 steps back in time"), "/q": ("no messages", None), "/r": ("not in the manifest", None)}


def test_json_modes_and_order(spark, tmp_path):
    lines = ['{"bag": "b", "frame_index": 2, "status": "clear"}', '{"bag": "b", "frame_index', '{"bag": "a", "frame_index": 1}', '{"bag": "b", "frame_index": 0}']
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    path = f"file://{tmp_path}/log.jsonl"
    assert [(r.bag, r.frame_index) for r in recordings.ordered_results(spark, path, "skip").collect() if r.bag] == [("a", 1), ("b", 0), ("b", 2)]
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        recordings.read_results(spark, path, "fail").collect()


def test_overrides_and_globs():
    from rangeflow.config import Thresholds, parse_override
    from rangeflow.functions.columns import glob_pattern

    assert parse_override("roi_l=0.5") == ("roi_l", 0.5) and parse_override("a=[1, 2]") == ("a", (1, 2)) and parse_override("a=b=c") == ("a", "b=c")
    with pytest.raises(ValueError):
        parse_override("nothing")
    with pytest.raises(KeyError):
        Thresholds.from_mapping({"unheard": 1})
    import re

    for pattern, yes, no in (("a*.b?", ["a.bc", "axx.bz"], ["a.b", "xa.bc"]), ("[ab]c", ["ac", "bc"], ["cc"]), ("[!a]", ["b"], ["a"]), ("x.y", ["x.y"], ["xzy"])):
        assert all(re.match(glob_pattern(pattern), x) for x in yes) and not any(re.match(glob_pattern(pattern), x) for x in no)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan")), (2, 3.0)], "k int, x double")
    sinks.write_json_log(df, f"file://{tmp_path}/log")
    assert sorted(tuple(r) for r in spark.read.schema("k int, x double").json(f"file://{tmp_path}/log").fillna(-1.0).collect()) == [(1, -1.0), (2, 3.0)]
    assert sinks.markdown(df.fillna(0.0), ["k"]).splitlines()[0] == "| k | x |"
    run = spark.createDataFrame([("a", 0, "clear", 5.0), ("a", 1, "detected", 7.0), ("b", 0, "unknown", float("nan"))], "bag string, frame_index long, status string, processing_ms double")
    assert sinks.write_run(run, 3, f"file://{tmp_path}/run")["exit"] == 0
    out = sinks.write_run(run, 4, f"file://{tmp_path}/run")
    assert out["exit"] == 3 and (out["n_done"], out["detected"], out["unknown"]) == (3, 1, 1)
    assert spark.read.json(f"file://{tmp_path}/run/frames").count() == 3
    labels = spark.createDataFrame([("s", 1, [(5, True)])], "scene string, frame long, objects array<struct<id:long,is_obstacle:boolean>>")
    slots = spark.createDataFrame([("s", 1, 7, 5)], "scene string, frame long, slot long, obj_id long")
    sinks.write_labels(labels, slots, f"file://{tmp_path}/set")
    assert spark.read.json(f"file://{tmp_path}/set/labels").select("objects.id").first()[0] == [5] and spark.read.parquet(f"file://{tmp_path}/set/slot_labels").count() == 1
    text = sinks.report("Run", {"first": (df.fillna(0.0), ["k"]), "second": (run.select("bag").distinct(), ["bag"])})
    assert text.index("# Run") < text.index("## first") < text.index("| 1 |") < text.index("## second") < text.index("| a |")


def test_clipped_sums_in_chunks(spark):
    rng = np.random.default_rng(4)
    rows = [(g, k, float(x)) for g in range(3) for k, x in enumerate(rng.normal(0, 2, 200))]
    df = spark.createDataFrame(rows, "g int, i long, v double").repartition(7)
    for chunk in (4096, 7):
        got = {r.g: (r.n, r.s) for r in islands.clipped_sum(df, ["g"], "i", "v", -2.0, 6.0, "s", chunk).collect()}
        for g in range(3):
            s = 0.0
            for _, _, x in rows[g * 200 : g * 200 + 200]:
                s = max(-2.0, min(6.0, s + x))
            assert got[g][0] == 200 and abs(got[g][1] - s) < 1e-9


def test_command_line(spark, tmp_path, capsys):
    from rangeflow.__main__ import main

    assert main(["list"]) == 0 and "alarm_runs" in capsys.readouterr().out.split()
    assert main(["run", "alarm_runs", "/root/testdata/sf0.001", "--out", f"file://{tmp_path}/out"]) == 0
    assert spark.read.parquet(f"file://{tmp_path}/out").count() > 0
    assert main(["explain", "alarm_runs", "/root/testdata/sf0.001"]) == 0 and "Window" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["run", "no_such_query", "x"])
