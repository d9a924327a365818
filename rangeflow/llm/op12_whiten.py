"""Embedding whitening by upper-triangle column aggregates.

One aggregation gives the number of vectors and the sum of every dimension, exactly; a second one has a Spark SQL
expression ``sum(z_i * z_j)`` for every pair of dimensions ``i <= j`` of the centred entries.  Both are combined in tasks and
in ``GROUPS`` rows, which are added entry by entry, so no task merges what grows with the number of tasks.  The covariance
is put together on the driver (its size depends on the dimension alone), LAPACK decomposes it, and the components are
applied to the rows in Arrow batches.  How well the result is whitened is measured by the same two aggregations over it.

Entries are whole numbers here: with ``S = q * n + r`` a centred entry is ``(x - q) - r / n``, whose first part is exact.

Cases: a vector that is null, or holds a null, NaN or infinite entry, is dropped; so is one whose length is not the
commonest (of equally common ones, the longest); no vectors, or vectors that are all equal, have no components and give no rows;
components end at the covariance's numerical rank, as directions without variance can't be scaled to one; repeated rows and null
ids count and come out as often as they come in; entries beyond ``+-LIMIT`` count as ``+-LIMIT``; a ``deviation`` beyond a long
is null; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table, written
from .tokens import released

COMPONENTS = 32
SCALE = 64
SHIFT = 1_000_000
#: The largest size of a scaled entry; sums of whole numbers below it are exact in doubles.
LIMIT = 1 << 40
#: Rows that partial sums are merged to before the last merge.
GROUPS = 64
#: Expressions of one aggregation: 64 dimensions have 2,080 pairs; from 91 dimensions on, pairs are taken in blocks, a pass each.
PAIRS = 4_096
#: Up to this distance from the mean, 64-bit sums of a vector's squares are exact; beyond it Python's whole numbers are used.
_NEAR = 1 << 22


@dataclass(frozen=True)
class Whitening:
    """A fit: ``n`` vectors with sums ``sums``, components (one a column) with their eigenvalues, and the trace."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float


def whole_vectors(df: DataFrame, column: str, keep: list[str], scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``keep`` and ``__x``: usable vectors of one length as whole numbers ``floor(scale * entry) + shift``."""
    v = F.col(column)
    rows = df.select(*keep, v.alias("__v")).where(F.col("__v").isNotNull())
    number = lambda c: c.cast("double")
    bad = lambda c: c.isNull() | F.isnan(number(c)) | (F.abs(number(c)) == float("inf"))
    rows = rows.where(~F.exists("__v", bad))
    common = rows.groupBy(F.size("__v").alias("d")).agg(F.count(F.lit(1)).alias("c")).agg(F.max(F.struct("c", "d")).alias("m")).first().m
    if common is None:
        return rows.where("false").select(*keep, F.col("__v").cast("array<bigint>").alias("__x"))
    limit = F.lit(float(LIMIT))
    x = F.transform("__v", lambda c: F.floor(F.least(F.greatest(number(c) * scale, -limit), limit)) + shift)
    return rows.where(F.size("__v") == common.d).select(*keep, x.alias("__x"))


def _merged(rows: DataFrame, sums: list[str]) -> list:
    """Values of SQL sums over all rows: one aggregation in tasks and ``GROUPS`` rows, whose arrays are then added entry by entry."""
    some = rows.groupBy((F.spark_partition_id() % GROUPS).alias("__g")).agg(F.expr(f"array({', '.join(f'sum({e})' for e in sums)})").alias("a"))
    added = some.select(F.posexplode("a").alias("k", "s")).groupBy("k").agg(F.sum("s").alias("s"))
    out = {r.k: r.s for r in added.collect()}  # as many rows as sums
    return [out[k] for k in range(len(sums))] if out else []


def covariance(rows: DataFrame, centred: list[str], n: int) -> np.ndarray:
    """The covariance (divisor ``n``) of SQL expressions that are centred already: one sum a pair of the upper triangle."""
    d = len(centred)
    cols = rows.selectExpr(*[f"coalesce({c}, 0D) AS z{k}" for k, c in enumerate(centred)])  # none is null, which halves the sums' code
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    out = np.zeros((d, d))
    for lo in range(0, len(pairs), PAIRS):
        some = pairs[lo : lo + PAIRS]
        for (i, j), s in zip(some, _merged(cols, [f"z{i} * z{j}" for i, j in some]), strict=True):
            out[i, j] = out[j, i] = s / n
    return out


def fit_whitening(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The fit over all rows of ``whole_vectors``; None where no direction has variance."""
    first = rows.select(F.size("__x").alias("d")).first()
    d = first.d if first else 0
    if not d:
        return None
    whole = ["CAST(1 AS DECIMAL(18,0))", *[f"CAST(__x[{k}] AS DECIMAL(18,0))" for k in range(d)]]
    n, *sums = map(int, _merged(rows, whole))
    mean = [divmod(s, n) for s in sums]
    v = covariance(rows, [f"CAST(__x[{k}] - {q}L AS DOUBLE) - {r / n!r}D" for k, (q, r) in enumerate(mean)], n)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(components, int((values > d * np.finfo(float).eps * max(values[0], 0)).sum()))
    if not k:
        return None
    vectors = vectors[:, :k] * np.where(vectors[np.abs(vectors).argmax(0), np.arange(d)] < 0, -1.0, 1.0)[:k]
    return Whitening(n, tuple(sums), vectors, values[:k], float(np.trace(v)))


def whiten(rows: DataFrame, fit: Whitening) -> DataFrame:
    """Rows of ``whole_vectors`` with ``__dev`` (exact squared deviation of ``n * x`` from the sums) and ``__w`` (one entry a component)."""
    keep = [c for c in rows.columns if c != "__x"]
    mean = [divmod(s, fit.n) for s in fit.sums]
    q, r = np.array([a for a, _ in mean]), np.array([b for _, b in mean])
    rest, n = sum(b * b for _, b in mean), fit.n
    turn = fit.components / np.sqrt(fit.values)

    def deviations(x: np.ndarray) -> list[int | None]:
        wide = len(x) and max(abs(int(x.max())), abs(int(x.min()))) > _NEAR or n > 1 << 32
        y, b = (x.astype(object), r.astype(object)) if wide else (x, r)
        out = [n * n * int(s) - 2 * n * int(t) + rest for s, t in zip((y * y).sum(1), (y * b).sum(1), strict=True)]
        return [v if v < 1 << 63 else None for v in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in released(batches):
            flat = b.column("__x").flatten().to_numpy(zero_copy_only=False)
            x = flat.reshape(b.num_rows, len(q)) - q
            w = (x - r / n) @ turn
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(deviations(x), pa.int64()), lists], [*keep, "__dev", "__w"])

    fields = "".join(f"`{c}` {t}, " for c, t in rows.dtypes if c != "__x")
    return rows.mapInArrow(run, f"{fields}__dev bigint, __w array<double>")


def identity_error(rows: DataFrame, k: int, n: int) -> float:
    """The largest absolute entry of the covariance of ``__w`` minus the identity."""
    means = [s / n for s in _merged(rows, [f"__w[{i}]" for i in range(k)])]
    return float(np.abs(covariance(rows, [f"__w[{i}] - ({m!r}D)" for i, m in enumerate(means)], n) - np.eye(k)).max())


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whole_vectors(read_table(spark, sf_dir, "embeddings"), "embedding", ["vec_id"])
    fit = fit_whitening(rows)
    if fit is None:
        kinds = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
        return spark.createDataFrame([], f"vec_id {dict(rows.dtypes)['vec_id']}, {kinds}")
    table = written(whiten(rows, fit), "op12-rows")
    error = identity_error(table, len(fit.values), fit.n)
    explained = F.array(*[F.lit(float(e / fit.trace)) for e in fit.values])
    return table.select("vec_id", F.col("__dev").alias("deviation"), F.posexplode("__w").alias("k", "whitened")).select(
        "vec_id",
        (F.col("k") + 1).cast("int").alias("component"),
        F.lit(fit.n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        explained[F.col("k")].alias("explained"),
        F.lit(error).alias("identity_error"),
    )
