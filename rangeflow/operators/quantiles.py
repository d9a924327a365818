"""Order statistics under the index conventions in use, as window selections.

No group is gathered into an array: values are ranked within their group and the wanted ranks
selected, so a large group spills instead of failing.  Where groups are few and grow with the input, ``spread_quantiles``
deals each of them out to tasks by ranges of its values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def rank_index(n: Column, p: float, rule: str) -> Column:
    """Zero-based index into n ascending values."""
    if rule == "floor":
        return F.floor((n - 1) * F.lit(float(p))).cast("long")
    if rule == "int":
        return F.least(n - 1, F.floor(n * F.lit(float(p))).cast("long"))
    if rule == "round":
        return F.rint((n - 1) * F.lit(float(p))).cast("long")
    if rule == "upper":
        return F.floor(n / 2).cast("long")
    raise ValueError(f"no such rule: {rule}")


def rank_quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, tuple[float, str]]) -> DataFrame:
    """``keys`` and a column for each wanted ``name: (p, rule)``; ``linear`` interpolates, ``fused`` does with one rounding at the end.

    Interpolated values that are compared with each other differ in their last bits by the rule; ``fused`` is DuckDB's ``quantile_cont``.
    """
    ordered = Window.partitionBy(*keys).orderBy(value)
    ranked = df.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(ordered) - 1)
    ranked = ranked.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    aggs = [_wanted(value, p, rule).alias(name) for name, (p, rule) in wanted.items()]
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *aggs)


def _wanted(value: str, p: float, rule: str) -> Column:
    """Aggregate of values ranked ``_i`` of ``_n``."""
    ranked = lambda at: F.max(F.when(F.col("_i") == at, F.col(value)))
    if rule == "linear":
        return F.percentile(value, p)
    if rule != "fused":
        return ranked(rank_index(F.col("_n"), p, rule))
    at = (F.col("_n") - 1) * F.lit(float(p))
    part = F.max(at - F.floor(at))
    lower, upper = ranked(F.floor(at)), ranked(F.ceil(at))
    mixed = F.reflect(F.lit("java.lang.Math"), F.lit("fma"), lower, 1.0 - part, upper * part).cast("double")
    return F.when(part == 0, lower).otherwise(mixed)


def spread_quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, tuple[float, str]]) -> DataFrame:
    """As ``rank_quantiles`` for few groups of any size (without ``fused``): no task holds or sorts a whole group.

    Equal values are one row with their count; rows are cut into ranges of keys and values, a range's ranks begin behind those before it.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    ranges = written(counts.repartitionByRange(*keys, value).withColumn("_part", F.spark_partition_id()), "quantile-ranges")
    totals = ranges.groupBy(*keys, "_part").agg(F.sum("_c").alias("_m"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"), F.sum("_m").over(Window.partitionBy(*keys)).alias("_n")
    )
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    within = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranges.join(totals, same).withColumn("_to", F.col("_before") + F.sum("_c").over(within))
    at = lambda i: F.max(F.when((F.col("_to") - F.col("_c") <= i) & (i < F.col("_to")), F.col(value)))

    def one(p: float, rule: str) -> Column:
        if rule != "linear":
            return at(rank_index(F.col("_n"), p, rule))
        place = (F.col("_n") - 1) * F.lit(float(p))
        lower, upper, part = at(F.floor(place)), at(F.ceil(place)), F.max(place)
        return F.when(lower == upper, lower).otherwise((F.ceil(part) - part) * lower + (part - F.floor(part)) * upper)

    return ranked.groupBy(*keys).agg(F.max("_n").alias("n"), *[one(p, rule).alias(name) for name, (p, rule) in wanted.items()])


def robust_nearest(value: str, few: int = 10, p: float = 0.1) -> Column:
    """Aggregate: a low percentile, or the minimum of fewer than ``few`` values."""
    return F.when(F.count(value) >= few, F.percentile(value, p)).otherwise(F.min(value))
