"""Robust fits of frames' binned profiles, as windows: every pass is sums over a frame, so one shuffle serves all passes.

Bins are rows; ``keep`` says which a pass uses.  Order within a frame matters only for runs of bins, which are
folds over a frame's bins (some hundred at most) inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fit_kept(bins: DataFrame, keys: list[str], c_max: Column | None = None, keep: str = "keep", name: str = "f") -> DataFrame:
    """Weighted quadratic of the kept bins (``x, y, w``) as columns ``{name}a, {name}b, {name}c, {name}n``.

    ``c_max``: the largest size of the quadratic term (none: a line); beyond it the term is that, and the rest refit.
    """
    over = Window.partitionBy(*keys)
    x, y, w = F.col("x"), F.col("y"), F.when(F.col(keep), F.col("w")).otherwise(0.0)
    powers = [F.lit(1.0), x, x * x, x * x * x, x * x * x * x]
    sums = {f"_s{k}": F.sum(w * powers[k]).over(over) for k in range(5)} | {f"_t{k}": F.sum(w * y * powers[k]).over(over) for k in range(3)}
    d = bins.withColumns(sums | {f"{name}n": F.count_if(F.col(keep)).over(over)})
    s, t = [F.col(f"_s{k}") for k in range(5)], [F.col(f"_t{k}") for k in range(3)]
    det = s[0] * (s[2] * s[4] - s[3] * s[3]) - s[1] * (s[1] * s[4] - s[3] * s[2]) + s[2] * (s[1] * s[3] - s[2] * s[2])
    free = (s[0] * (s[2] * t[2] - t[1] * s[3]) - s[1] * (s[1] * t[2] - t[1] * s[2]) + t[0] * (s[1] * s[3] - s[2] * s[2])) / F.nullif(det, F.lit(0.0))
    c = F.lit(0.0) if c_max is None else F.when(c_max == 0, 0.0).otherwise(F.greatest(-c_max, F.least(c_max, F.coalesce(free, F.lit(0.0)))))
    d = d.withColumn(f"{name}c", c)
    # for a given quadratic term the best line follows; at the free term's value it is the free fit's
    u, v, line = t[0] - F.col(f"{name}c") * s[2], t[1] - F.col(f"{name}c") * s[3], F.nullif(s[0] * s[2] - s[1] * s[1], F.lit(0.0))
    return d.withColumns({f"{name}a": (u * s[2] - v * s[1]) / line, f"{name}b": (v * s[0] - u * s[1]) / line}).drop(*sums)


def poly(name: str = "f", x: Column | None = None) -> Column:
    x = F.col("x") if x is None else x
    return F.col(f"{name}a") + F.col(f"{name}b") * x + F.col(f"{name}c") * x * x


def dense_limit(bins: DataFrame, keys: list[str], gap: float, step_up: float, cap: float) -> DataFrame:
    """``bins`` with ``limit``: where the run of ``dense`` bins from the first one ends.

    The run ends at a sparse bin or after a gap; a dense bin that lies over ``step_up`` above the last of the run is
    passed over.  Without a dense bin, and at most, it is ``cap``.
    """
    rows = F.sort_array(F.collect_list(F.struct("x", "y", "dense")).over(Window.partitionBy(*keys)))
    none = F.lit(None).cast("double")
    start = F.struct(none.alias("limit"), F.lit(0.0).alias("y"), F.lit(0.0).alias("x"), F.lit(False).alias("ended"))

    def step(s: Column, b: Column) -> Column:
        fresh = F.struct(F.when(b["dense"], b["x"]).alias("limit"), b["y"].alias("y"), b["x"].alias("x"), F.lit(False).alias("ended"))
        ends = ~b["dense"] | (b["x"] - s["x"] > gap)
        passed = b["y"] - s["y"] > step_up
        on = F.struct(F.when(passed, s["limit"]).otherwise(b["x"]).alias("limit"), F.when(passed, s["y"]).otherwise(b["y"]).alias("y"), b["x"].alias("x"), F.lit(False).alias("ended"))
        stop = F.struct(s["limit"].alias("limit"), s["y"].alias("y"), s["x"].alias("x"), F.lit(True).alias("ended"))
        return F.when(s["ended"], s).when(s["limit"].isNull(), fresh).when(ends, stop).otherwise(on)

    run = F.aggregate(rows, start, step)["limit"]
    return bins.withColumn("limit", F.least(F.lit(cap), F.coalesce(run, F.lit(cap))))


def chained(bins: DataFrame, keys: list[str], ok: Column, gap: float, name: str) -> DataFrame:
    """``name``: bins that are ok and within ``gap`` of the bin taken before, or of ``last`` (a column) at first."""
    rows = F.sort_array(F.collect_list(F.struct("x", ok.alias("ok"), "last")).over(Window.partitionBy(*keys)))
    start = F.struct(F.lit(None).cast("double").alias("at"), F.array().cast("array<double>").alias("taken"))

    def step(s: Column, b: Column) -> Column:
        near = b["ok"] & (b["x"] - F.coalesce(s["at"], b["last"]) <= gap)
        return F.struct(F.when(near, b["x"]).otherwise(s["at"]).alias("at"), F.when(near, F.array_append(s["taken"], b["x"])).otherwise(s["taken"]).alias("taken"))

    return bins.withColumn(name, F.array_contains(F.aggregate(rows, start, step)["taken"], F.col("x")))


def rail_fit(bins: DataFrame, keys: list[str], residual: float = 0.25, far_gate: float = 0.35, far_per_m: float = 0.005, far_gap: float = 20.0, least: int = 4, quad_from: float = 60.0, c_max: float = 5e-4, gap: float = 8.0, step_up: float = 0.8, cap: float = 45.0) -> DataFrame:
    """A frame's rail profile from its bins ``x, y, w, dense``: ``ok, a, b, c, used, rms, reach``.

    The run of dense bins near the sensor is fitted with tightening residual limits; farther bins join if they lie near
    the extrapolation and near a bin taken before, and the fit is repeated with them twice.
    """
    over = Window.partitionBy(*keys)
    d = dense_limit(bins, keys, gap, step_up, cap).withColumn("near", F.col("x") <= F.col("limit"))
    long = (F.col("limit") >= 0.5 * quad_from) & (F.max("x").over(over) >= quad_from)
    d = d.withColumn("cm", F.when(long, c_max).otherwise(0.0))
    middle = F.coalesce(F.percentile(F.when(F.col("near"), F.col("y")), 0.5).over(over), F.percentile("y", 0.5).over(over))
    d = d.withColumn("middle", middle).withColumn("keep", F.col("near") & (F.abs(F.col("y") - F.col("middle")) <= 4 * residual))
    d = d.withColumns({"going": F.lit(True), **{f"k{c}": F.lit(None).cast("double") for c in "abc"}})
    for limit in (2 * residual, residual, residual):
        d = fit_kept(d, keys, F.col("cm")).withColumn("going", F.col("going") & (F.col("fn") >= max(2, least)))
        d = d.withColumns({f"k{c}": F.when(F.col("going"), F.col(f"f{c}")).otherwise(F.col(f"k{c}")) for c in "abc"})
        d = d.withColumn("new", F.coalesce(F.col("near") & (F.abs(F.col("y") - poly()) <= limit), F.lit(False)))
        d = d.withColumn("going", F.col("going") & (F.count_if("new").over(over) >= least))
        d = d.withColumn("keep", F.when(F.col("going"), F.col("new")).otherwise(F.col("keep")))
    d = d.withColumn("ok", F.col("ka").isNotNull() & (F.count_if("keep").over(over) >= least))
    gate = far_gate + far_per_m * F.greatest(F.lit(0.0), F.col("x") - F.col("limit"))
    off = F.abs(F.col("y") - poly("k"))
    d = d.withColumn("last", F.max(F.when(F.col("keep"), F.col("x"))).over(over))
    d = chained(d, keys, F.coalesce(~F.col("near") & (off <= gate), F.lit(False)), far_gap, "far")
    d = d.withColumn("both", F.col("keep") | F.col("far")).withColumn("any_far", F.max("far").over(over))
    d = fit_kept(d, keys, F.col("cm"), "both", "g")
    d = d.withColumn("both", F.coalesce(F.col("both") & (F.abs(F.col("y") - poly("g")) <= F.when(F.col("near"), residual).otherwise(gate)), F.lit(False)))
    d = fit_kept(d, keys, F.col("cm"), "both", "h")
    d = d.withColumn("wide", F.col("any_far") & (F.col("hn") >= least))
    d = d.withColumns({f"k{c}": F.when(F.col("wide"), F.col(f"h{c}")).otherwise(F.col(f"k{c}")) for c in "abc"})
    d = d.withColumn("keep", F.when(F.col("wide"), F.col("both")).otherwise(F.col("keep")))
    miss = F.when(F.col("keep"), F.col("y") - poly("k"))
    return d.groupBy(*keys).agg(
        F.bool_and("ok").alias("ok"), *[F.max(F.when(F.col("ok"), F.col(f"k{c}"))).alias(c) for c in "abc"], F.count_if("keep").alias("used"),
        F.when(F.bool_and("ok"), F.sqrt(F.avg(miss * miss))).alias("rms"), F.max(F.when(F.col("ok") & F.col("keep"), F.col("x"))).alias("reach"),
    )
