"""Small tables on which queries differed from their SQL, and operators whose work grew faster than their input."""

import datetime

import duckdb

from rangeflow.plans import catalog

LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"


def line(order, d, l, h, r=30.0, frame=1):
    """A line item that is a point of a frame: distance, side, height and range."""
    return (order, order, frame, 1, r, d * 500.0, (l + 1.0) / 20.0, h / 40.0, "A", "F", datetime.datetime(2024, 1, 1))


def both(spark, tmp_path, name, table, rows, schema):
    """A query's rows on one small table, and those of its SQL."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    rel = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    return sorted(tuple(r[n] for n in names) for r in df.collect()), sorted(rel.fetchall())


def test_richest_by_balance_and_key_in_one_number(spark, tmp_path):
    rows = [(1, "a", 3, 10.01, "x"), (20_000, "b", 3, 10.0, "x"), (5, "c", 4, -1.0, "y")]
    got, sql = both(spark, tmp_path, "best_by_struct", "customer", rows, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    assert got == sql
    assert got[0][-1] == 20_000


def test_a_bin_on_the_gate_is_accepted(spark, tmp_path):
    got, sql = both(spark, tmp_path, "gated_profile", "lineitem", [line(1, 1.0, 0.0, 0.1), line(2, 5.0, 0.0, 0.4)], LINE)
    assert got == sql == [(1, 0, True), (1, 1, True)]


def test_edges_that_close_in_by_just_enough(spark, tmp_path):
    """Interpolated edges are compared with each other, so they are rounded as the SQL's are."""
    rows = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet").where("l_suppkey in (502, 762)")
    got, sql = both(spark, tmp_path, "wall_sweep_limit", "lineitem", rows.collect(), rows.schema)
    assert got == sql
    assert got == [(502, 45.0, 2, -1), (762, 75.0, 2, 1)]


def test_components_of_cells_need_few_links(spark):
    """Runs and nearest cells give the components of all pairs within reach, with fewer links than pairs."""
    import random

    from rangeflow.operators.cells import row_runs, run_links
    from rangeflow.operators.graph import grouped_components

    rng = random.Random(3)
    cells = [(f, r, c) for f in range(3) for r in range(-8, 8) for c in range(-9, 9) if rng.random() < 0.2]
    df = spark.createDataFrame([(*p, k) for k, p in enumerate(cells)], "frame long, row long, col long, id long")
    for reach in (1, 2, 3):
        near = [(i, j) for i, p in enumerate(cells) for j, q in enumerate(cells) if i < j and p[0] == q[0] and abs(p[1] - q[1]) <= reach and abs(p[2] - q[2]) <= reach]
        want = list(range(len(cells)))
        while True:
            new = want[:]
            for i, j in near:
                new[i] = new[j] = min(new[i], new[j])
            if new == want:
                break
            want = new
        runs = row_runs(df, ["frame"], reach)
        links = run_links(runs, ["frame"], reach)
        assert links.count() < len(near)
        for held in (10_000, 5):  # groups that fit, and groups that are cut
            of = {r.id: r.component for r in grouped_components(links, "frame", "run", "o_run", held).collect()}
            assert [of.get(r.run, r.run) for r in runs.orderBy("id").collect()] == want


def test_faces_behind_a_wall_are_not_tested(spark):
    from rangeflow.operators import mesh as M

    wall = lambda k, x: (0, k, x, -4 * x, -4 * x, x, 4 * x, -4 * x, x, 0.0, 4 * x)
    small = [(0, 100 + k, 5.0 + k, -0.3, -0.3, 5.0 + k, 0.3, -0.3, 5.0 + k, 0.0, 0.3) for k in range(200)]
    faces = spark.createDataFrame([wall(1, 8.5), wall(2, 40.0), *small], "scene int, face int, " + ", ".join(f"{c} double" for c in M.CORNERS))
    beams = spark.createDataFrame([(0, 1, 1.0, 0.001, 0.001), (0, 2, 1.0, 0.2, 0.0), (0, 3, 1e-10, 1e-13, 1e-13)], "scene int, beam int, dx double, dy double, dz double")
    got = {r.beam: (r.face, round(r.t, 6)) for r in M.cast_rays(beams, faces, ["scene"], ["beam"], "face").collect()}
    assert got[1] == (100, 5.0) and got[2] == (1, 8.5) and got[3][0] == 100
    n = {r.beam: r.n for r in M.cast_rays(beams, faces, ["scene"], ["beam"], "face", tested=True).collect()}
    assert n[1] < 10 and n[3] > 100


def test_dust_samples_stay_in_their_row(spark, tmp_path):
    rows = [line(k, 3.0 * k, (k % 11) * 0.2 - 1.0, 1.0, frame=k % 3) for k in range(1, 60)]
    got, sql = both(spark, tmp_path, "dust_puffs", "lineitem", rows, LINE)
    assert got == sql and sum(r[3] for r in got) > 5
    plan = catalog.QUERIES["dust_puffs"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan


def test_slices_of_a_stream_are_shared_by_tasks(spark, monkeypatch):
    """A large slice is written and read as several files, and is still one batch."""
    from pyspark.sql import functions as F

    from rangeflow.plans import live_queries as live

    monkeypatch.setattr(live, "SLICE_ROWS", 20)
    src = spark.range(400).select("id", F.timestamp_seconds("id").alias("ts"))
    edges = [r.ts for r in src.where("id in (100, 200, 300)").orderBy("id").collect()]
    out = live.run_in_slices(spark, src, "ts", edges, lambda s: s.select("id", F.input_file_name().alias("file")))
    got = out.collect()
    assert sorted(r.id for r in got) == list(range(400))
    files = {}
    for r in got:
        files.setdefault(r.file, set()).add(r.id // 100)
    assert len(files) == 20 and all(len(slices) == 1 for slices in files.values())


def test_windows_of_a_stream_read_many_files(spark):
    """The table that is streamed through windows keeps its partitions."""
    from pyspark.sql import functions as F

    from rangeflow.plans.state_queries import run_windows

    src = spark.range(0, 4000, 1, 4).select(F.timestamp_seconds("id").alias("ts"), F.lit(1).alias("x"))
    plan = lambda s: s.withColumn("file", F.input_file_name()).groupBy(F.window("ts", "1 hour").alias("w")).agg(F.sum("x").alias("n"), F.min("file").alias("a"), F.max("file").alias("b"))
    got = run_windows(spark, src, plan).collect()
    assert sorted(r.n for r in got if r.n) == [400, 3600] and any(r.a != r.b for r in got)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_quantiles_of_one_group_are_spread(spark):
    """No window goes over a whole group's values: it goes over a range of them, equal values are one row."""
    from pyspark.sql import functions as F

    from rangeflow.operators.quantiles import rank_quantiles, spread_quantiles

    df = spark.range(5000).select(F.when(F.col("id") % 7 == 0, None).otherwise(F.lit("a")).alias("g"), F.when(F.col("id") % 11 > 0, (F.col("id") * 7919 % 1013) / 8.0).alias("x"))
    wanted = {"linear": (0.98, "linear"), "floor": (0.98, "floor"), "int": (0.3, "int"), "round": (0.7, "round"), "upper": (0.5, "upper")}
    got = spread_quantiles(df, ["g"], "x", wanted)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in rank_quantiles(df, ["g"], "x", wanted).collect()}
    ranked = plan_of(catalog.QUERIES["quantile_variants"](spark, "/root/testdata/sf0.001"))
    assert "_part" in ranked and "row_number" not in ranked and "percentile" not in ranked


def test_points_move_once_for_all_axes(spark, tmp_path):
    rows = [line(k, 3.0 * k % 200, (k % 11) * 0.2 - 1.0, (k % 9) * 0.4, frame=k % 5) for k in range(1, 300)]
    got, sql = both(spark, tmp_path, "axis_detection", "lineitem", rows, LINE)
    assert got == sql
    plan = plan_of(catalog.QUERIES["axis_detection"](spark, str(tmp_path)))
    assert "Expand" not in plan and plan.rindex("Generate") < plan.index("Join")


def test_ranges_of_cells_by_windows(spark, tmp_path):
    """Cells are copied to three rows and not to nine cells."""
    rows = [line(k, 3.0 * k % 200, (k % 7) * 0.3 - 1.0, 0.4, r=5.0 + (k * 37 % 50) / 10, frame=k % 4) for k in range(1, 400)]
    got, sql = both(spark, tmp_path, "static_fraction_3x3", "lineitem", rows, LINE)
    assert got == sql and len(got) == 3
    assert "rangeframe" in plan_of(catalog.QUERIES["static_fraction_3x3"](spark, str(tmp_path))).lower()


def test_a_path_is_walked_by_several_tasks(spark, monkeypatch):
    """The blocks of a path are few bytes: adaptive execution made one task of them all."""
    from rangeflow.operators import motion as M

    files, real = {}, M.written

    def keep(df, label, **options):
        out = real(df, label, **options)
        files[label] = len(out.inputFiles())
        return out

    monkeypatch.setattr(M, "written", keep)
    df = spark.range(640).selectExpr("id % 40 as bag", "id div 40 as n", "array(id % 3, 1L, 0L) as e")
    M.least_cost_path(df, "bag", "n", "e", M.smoothness(M.grid(0.0, 0.2, 0.1), 0.1), block=4)
    assert all(files[label] > 1 for label in ("motion-blocks", "motion-walks", "motion-path"))


def test_points_of_a_ride_go_to_few_cells(spark, monkeypatch):
    """A point goes to some four cells (eighteen before); those at the edges of cells still meet."""
    import numpy as np
    from pyspark.sql import functions as F

    from rangeflow.operators import motion as M

    moved, explode = [], F.explode
    monkeypatch.setattr(F, "explode", lambda c: moved.append(c) or explode(c))
    side, up = [0.2 * k - 1 for k in range(11)], [0.25 * k for k in range(9)]
    rows = [(0, round(0.35 * k % 20, 3), side[k % 11], up[k * 7 % 9]) for k in range(400)]
    df = spark.createDataFrame(rows, "k int, d double, l double, h double")
    low, step, m, trunc = -0.2, 0.1, 33, 0.25
    costs = M.shift_costs(df, df, ["k"], low, step, m, trunc).first().costs
    p = np.array(rows)[:, 1:]
    for j in range(m):
        near = np.sqrt((((p + [low + step * j, 0, 0])[:, None] - p[None]) ** 2).sum(2)).min(1)
        assert abs(np.minimum(near, trunc).mean() - costs[j]) < 1e-8
    cells = df.select(F.size(moved[0]).alias("a"), F.size(moved[1]).alias("b"), F.size(moved[2]).alias("c")).agg(F.avg(F.expr("a * b * c"))).first()[0]
    assert cells < 6


def test_links_of_a_crowded_frame(spark):
    """Hundreds of tracks and components a frame: their pairs are not tried one by one in Python."""
    import random
    import time

    from rangeflow.operators.tracks.linking import LinkRules, link_step, new_links

    from .test_line_and_links import plain_links

    rng = random.Random(5)
    one = lambda c: {"c": c, "d": rng.uniform(0, 200), "l": rng.randrange(11) * 0.2 - 1, "h": rng.randrange(9) * 0.4, "r": float(rng.randrange(60)), "kind": rng.choice(["A", "N", None])}
    frames = {f: (f * 1.3, [one(c) for c in range(120)]) for f in range(25)}
    state, got, began = new_links(), {}, time.process_time()
    for f, (position, components) in frames.items():
        got |= {(f, r["c"]): r["track"] for r in link_step(state, f, position, components)}
    spent = time.process_time() - began
    began = time.process_time()
    assert got == plain_links(frames, LinkRules())
    assert spent < (time.process_time() - began) / 4


def test_logs_are_read_in_batches_of_bounded_bytes(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    from rangeflow.sources import recordings as R

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "bytes"])

    before = spark.conf.get(R._BATCH)
    logs = spark.range(0, 600, 1, 1).select(F.repeat(F.lit("x"), 100_000).cast("binary").alias("content"))
    got = R.read_in_batches(logs.mapInArrow(sizes, "rows long, bytes long"), "sizes").collect()
    assert sum(r.rows for r in got) == 600 and max(r.bytes for r in got) < 1.1 * R.BATCH_BYTES
    assert spark.conf.get(R._BATCH) == before


def test_a_log_counts_its_own_steps_back(spark):
    """Steps back in time are those of the order of logging, which reading by time hides; a broken log is a row."""
    import sqlite3

    from rangeflow.sources.recordings import inspect_logs

    db = sqlite3.connect(":memory:")
    db.execute("create table topics (id integer primary key, name text)")
    db.execute("create table messages (id integer primary key, topic_id integer, timestamp integer, data blob)")
    db.executemany("insert into topics values (?, ?)", [(1, "/p"), (2, "/q"), (3, "/none")])
    db.executemany("insert into messages values (?, ?, ?, ?)", [(k, 1 + k % 2, t, b"a") for k, t in enumerate([5, 1, 4, 2, 4, 3, 9, 2])])
    files = spark.createDataFrame([("a", bytearray(db.serialize())), ("b", bytearray(b"no log"))], "path string, content binary")
    got = {(r.bag, r.topic): (r.n, r.backward, r.error is None) for r in inspect_logs(files).collect()}
    assert got == {("a", "/p"): (4, 1, True), ("a", "/q"): (4, 1, True), ("b", None): (None, None, False)}
