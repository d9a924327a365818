"""Least-squares fits as aggregates: normal equations from sums, solved in closed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _det3(m: list[list[Column]]) -> Column:
    return (
        m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1])
        - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0])
        + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    )


def weighted_quadratic(df: DataFrame, keys: list[str], x: Column, y: Column, w: Column, c_max: float) -> DataFrame:
    """``keys, n, a, b, c`` of y = a + b x + c x^2; where |c| exceeds ``c_max``, c is that and a, b are refit.

    One aggregation of ten sums a group; null where the points don't determine the fit.
    """
    sums = [F.sum(w * x**k if k else w).alias(f"s{k}") for k in range(5)] + [F.sum(w * y * x**k if k else w * y).alias(f"t{k}") for k in range(3)]
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)
    s, t = [F.col(f"s{k}") for k in range(5)], [F.col(f"t{k}") for k in range(3)]
    m = [[s[i + j] for j in range(3)] for i in range(3)]
    det = F.nullif(_det3(m), F.lit(0.0))
    free = [_det3([[t[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]) / det for k in range(3)]
    c = F.greatest(F.lit(-c_max), F.least(F.lit(c_max), free[2]))
    u, v = t[0] - c * s[2], t[1] - c * s[3]
    lin = F.nullif(s[0] * s[2] - s[1] * s[1], F.lit(0.0))
    clipped = F.abs(free[2]) > c_max
    a = F.when(clipped, (u * s[2] - v * s[1]) / lin).otherwise(free[0])
    b = F.when(clipped, (v * s[0] - u * s[1]) / lin).otherwise(free[1])
    return g.select(*keys, "n", a.alias("a"), b.alias("b"), c.alias("c"))


def planarity(df: DataFrame, keys: list[str], axes: list[str]) -> DataFrame:
    """``keys, n, l1, l2, l3``: eigenvalues of the covariance, ascending, in closed form."""
    x, y, z = axes
    g = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.covar_pop(x, x).alias("xx"), F.covar_pop(y, y).alias("yy"), F.covar_pop(z, z).alias("zz"),
        F.covar_pop(x, y).alias("xy"), F.covar_pop(x, z).alias("xz"), F.covar_pop(y, z).alias("yz"),
    )
    g = g.withColumn("q", (F.col("xx") + F.col("yy") + F.col("zz")) / 3)
    p2 = sum(((F.col(c) - F.col("q")) ** 2 for c in ("yy", "zz")), (F.col("xx") - F.col("q")) ** 2) + 2 * (F.col("xy") ** 2 + F.col("xz") ** 2 + F.col("yz") ** 2)
    g = g.withColumn("p", F.sqrt(p2 / 6))
    m = [[F.col("xx") - F.col("q"), F.col("xy"), F.col("xz")], [F.col("xy"), F.col("yy") - F.col("q"), F.col("yz")], [F.col("xz"), F.col("yz"), F.col("zz") - F.col("q")]]
    r = _det3(m) / F.nullif(2 * F.col("p") ** 3, F.lit(0.0))
    g = g.withColumn("phi", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(r, F.lit(0.0))))) / 3)
    l3 = F.col("q") + 2 * F.col("p") * F.cos("phi")
    l1 = F.col("q") + 2 * F.col("p") * F.cos(F.col("phi") + 2 * F.pi() / 3)
    return g.select(*keys, "n", l1.alias("l1"), (3 * F.col("q") - l1 - l3).alias("l2"), l3.alias("l3"))
