"""Ordered operators within a key: islands, resets, gaps, rolling order statistics, interpolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def islands(df: DataFrame, keys: list[str], position: str, gap: int, name: str = "run") -> DataFrame:
    """Number runs of rows whose positions follow each other by at most ``gap``."""
    w = by(keys, [position])
    new = F.coalesce((F.col(position) - F.lag(position).over(w) > gap).cast("int"), F.lit(1))
    return df.withColumn(name, F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def reset_epochs(df: DataFrame, keys: list[str], order: list[str], time: str, back: int, gap: int) -> DataFrame:
    """``reset`` where time jumps back by over ``back`` or ahead by over ``gap``; ``epoch`` counts resets.

    A row without time changes nothing: the reference is the last time before it.
    """
    w = by(keys, order)
    last = F.last(time, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    step = F.col(time) - last
    reset = F.coalesce((step < -back) | (step > gap), F.lit(False))
    marked = df.withColumn("reset", reset)
    return marked.withColumn("epoch", F.sum(F.col("reset").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def last_before(df: DataFrame, keys: list[str], part: str, order: list[str], values: dict[str, str]) -> DataFrame:
    """For each ``column: name`` the last known value of the rows before, in the order of ``part`` and ``order`` within ``keys``.

    A key is worked on part by part (days, say), with what the parts before leave behind, so a key that holds much of the
    table is no single task; what is left behind is one row a key and part.
    """
    within = by([*keys, part], order).rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*order)
    left = df.groupBy(*keys, part).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_{name}") for c, name in values.items()])
    earlier = by(keys, [part]).rowsBetween(Window.unboundedPreceding, -1)
    left = left.select(*keys, part, *[F.last(f"_{name}", ignorenulls=True).over(earlier).alias(f"_{name}") for name in values.values()])
    marked = df.withColumns({name: F.last(c, ignorenulls=True).over(within) for c, name in values.items()})
    got = marked.join(left, [*keys, part], "left")
    return got.withColumns({name: F.coalesce(name, f"_{name}") for name in values.values()}).drop(*[f"_{name}" for name in values.values()])


def rolling_percentile(df: DataFrame, keys: list[str], order: list[str], value: str, before: int, after: int, name: str, p: float = 0.5) -> DataFrame:
    w = by(keys, order).rowsBetween(-before, after)
    return df.withColumn(name, F.percentile(value, p).over(w))


def fill_linear(df: DataFrame, keys: list[str], position: str, value: str, name: str) -> DataFrame:
    """Nulls between known values are interpolated by position; outer ones take the nearest known."""
    w = by(keys, [position])
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(position).alias("x"), F.col(value).alias("y")))
    lo = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    hi = F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    marked = df.withColumn("_lo", lo).withColumn("_hi", hi)
    x = F.col(position)
    between = F.col("_lo.y") + (F.col("_hi.y") - F.col("_lo.y")) * (x - F.col("_lo.x")) / (F.col("_hi.x") - F.col("_lo.x"))
    out = F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_lo").isNull(), F.col("_hi.y")).when(F.col("_hi").isNull(), F.col("_lo.y")).otherwise(between)
    return marked.withColumn(name, out).drop("_lo", "_hi")


def until_first_failure(df: DataFrame, keys: list[str], order: list[str], ok: Column, name: str = "open") -> DataFrame:
    """True for the rows before the first one that fails."""
    w = by(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.min(ok.cast("int")).over(w) == 1)


def trailing_count(df: DataFrame, keys: list[str], position: str, hit: Column, window: int, name: str) -> DataFrame:
    """Hits with positions in ``(position - window, position]``."""
    w = by(keys, [position]).rangeBetween(-(window - 1), 0)
    return df.withColumn(name, F.sum(hit.cast("long")).over(w))


def clipped_sum(df: DataFrame, keys: list[str], order: str, value: str, low: float, high: float, name: str, chunk: int = 4096) -> DataFrame:
    """``keys, n, name``: values added in order from zero, clipped to ``[low, high]`` at each step.

    A run of steps is one step: add, then clip to its own limits.  So runs of ``chunk`` positions are folded by themselves,
    and then a key's runs; no array is longer than a chunk or a key's number of chunks.
    """
    clip = lambda x, lo, hi: F.greatest(lo, F.least(hi, x))

    def fold(rows: Column) -> Column:
        whole = F.struct(F.lit(0.0).alias("add"), F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"))

        def then(s: Column, x: Column) -> Column:
            return F.struct((s["add"] + x["add"]).alias("add"), clip(s["lo"] + x["add"], x["lo"], x["hi"]).alias("lo"), clip(s["hi"] + x["add"], x["lo"], x["hi"]).alias("hi"))

        return F.aggregate(rows, whole, then)

    one = F.struct(F.col(order).alias("at"), F.col(value).alias("add"), F.lit(float(low)).alias("lo"), F.lit(float(high)).alias("hi"))
    part = F.floor(F.col(order) / chunk).alias("_c")
    runs = df.groupBy(*keys, part).agg(fold(F.array_sort(F.collect_list(one))).alias("f"), F.count(F.lit(1)).alias("n"))
    each = F.array_sort(F.collect_list(F.struct(F.col("_c").alias("at"), "f.add", "f.lo", "f.hi")))
    f = runs.groupBy(*keys).agg(fold(each).alias("f"), F.sum("n").alias("n"))
    return f.select(*keys, "n", clip(F.col("f.add"), F.col("f.lo"), F.col("f.hi")).alias(name))
