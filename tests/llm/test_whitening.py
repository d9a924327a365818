"""Whitening against exact fractions and plain numpy, with odd vectors."""

from __future__ import annotations

import random

import numpy as np
import pytest

from rangeflow.llm import op12_whiten as W


def odd_table(spark, d=7, n=60, seed=5):
    rng = random.Random(seed)
    mix = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(d)]
    draw = lambda: [sum(a * b for a, b in zip(m, x)) for x in [[rng.gauss(0, 1) for _ in range(d)]] for m in mix]
    rows = [(k, draw(), k) for k in range(n)]
    rows += [(3, rows[3][1], 0), (None, draw(), 0), (n, None, 0), (n + 1, [], 0), (n + 2, [1.0], 0), (n + 3, [None] * d, 0)]
    rows += [(n + 4, [float("nan")] * d, 0), (n + 5, [float("inf")] + [0.0] * (d - 1), 0), (n + 6, [1.0] * (d - 1) + [float("-inf")], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, __g long").repartition(5)


def usable(rows, d):
    return [(r.vec_id, [int(np.floor(64 * float(c))) + 1_000_000 for c in r.embedding]) for r in rows if r.embedding is not None and len(r.embedding) == d and all(c is not None and np.isfinite(c) for c in r.embedding)]


def query(spark, table, tmp_path):
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    return W.op12_embedding_whitening(spark, str(tmp_path))


def test_equals_numpy(spark, tmp_path):
    d = 7
    table = odd_table(spark, d)
    fit_list = usable(table.collect(), d)
    x = np.array([v for _, v in fit_list])
    n, sums = len(x), x.sum(0)
    z = x - sums / n
    values, vectors = np.linalg.eigh(z.T @ z / n)
    got = query(spark, table, tmp_path).collect()
    assert len(got) == n * d and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, d + 1))
    deviations = sorted((str(i), sum((n * a - int(s)) ** 2 for a, s in zip(v, sums))) for i, v in fit_list)
    assert deviations == sorted((str(r.vec_id), r.deviation) for r in got if r.component == 1)
    for k in range(1, d + 1):
        e = values[-k]
        want = z @ vectors[:, -k] / np.sqrt(e)
        mine = sorted(r.whitened for r in got if r.component == k)
        assert np.allclose(mine, np.sort(want), atol=1e-9) or np.allclose(mine, np.sort(-want), atol=1e-9)
        assert all(abs(r.explained / (e / values.sum()) - 1) < 1e-9 for r in got if r.component == k)
    assert max(r.identity_error for r in got) < 1e-9 and len({r.identity_error for r in got}) == 1


def test_components_end_at_the_rank(spark, tmp_path):
    rows = [(k, [float(k), 2.0 * k, 1.0]) for k in range(20)]
    got = query(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tmp_path).collect()
    assert {r.component for r in got} == {1} and len(got) == 20 and all(abs(r.explained - 1) < 1e-12 for r in got)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])]])
def test_no_variance_gives_no_rows(spark, tmp_path, rows):
    got = query(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tmp_path)
    assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_huge_entries_and_deviations(spark, tmp_path):
    rows = [(k, [float(k % 3), 1e300 * (k == 0), -1e30 * (k == 1)]) for k in range(9)]
    got = query(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"), tmp_path).collect()
    x = [[64 * (k % 3) + 1_000_000, (W.LIMIT if k == 0 else 0) + 1_000_000, (-W.LIMIT if k == 1 else 0) + 1_000_000] for k in range(9)]
    sums = [sum(c) for c in zip(*x)]
    want = {k: sum((9 * a - s) ** 2 for a, s in zip(v, sums)) for k, v in enumerate(x)}
    assert all(r.deviation == (want[r.vec_id] if want[r.vec_id] < 1 << 63 else None) for r in got)
    assert len({r.component for r in got}) >= 2


def test_blocks_of_pairs_give_the_same(spark, tmp_path, monkeypatch):
    rows = W.whole_vectors(odd_table(spark), "embedding", ["vec_id"])
    one = W.fit_whitening(rows)
    monkeypatch.setattr(W, "PAIRS", 5)
    monkeypatch.setattr(W, "GROUPS", 2)
    many = W.fit_whitening(rows)
    assert np.allclose(one.values, many.values, rtol=1e-12) and one.sums == many.sums
    some = W.fit_whitening(rows, components=3)
    out = W.whiten(rows, some)
    assert len(out.first()["__w"]) == 3 and W.identity_error(out, 3, some.n) < 1e-9
