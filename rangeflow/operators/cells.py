"""Operators on cells: winners a cell, voxel dedup, neighbourhoods, histograms, free intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import floor_bin


def voxel_keys(d: Column, s: Column, h: Column, size: float = 0.08, slope: float = 0.002) -> list[Column]:
    """Cell of a voxel grid whose cells grow with distance, point by point."""
    v = size + slope * d
    return [F.floor(c / v).cast("long") for c in (d, s, h)]


def first_per_cell(df: DataFrame, cells: dict[str, Column], slot: str, keep: list[str]) -> DataFrame:
    """The lowest slot of each cell, with the columns ``keep``."""
    best = F.min_by(F.struct(slot, *keep), slot)
    return df.groupBy(*[c.alias(k) for k, c in cells.items()]).agg(best.alias("_b"), F.count(F.lit(1)).alias("n")).select(*cells, "n", "_b.*")


def near_far_per_cell(df: DataFrame, keys: list[Column | str], r: str, slot: str) -> DataFrame:
    """Nearest (lowest slot of equals) and farthest (highest slot of equals) of each cell."""
    pair = F.struct(r, slot)
    g = df.groupBy(*keys).agg(F.min(pair).alias("_a"), F.max(pair).alias("_b"), F.count(F.lit(1)).alias("n"))
    return g.select(
        *[c for c in g.columns if c not in ("_a", "_b")],
        F.col(f"_a.{r}").alias("near_r"), F.col(f"_a.{slot}").alias("near_slot"), F.col(f"_b.{r}").alias("far_r"), F.col(f"_b.{slot}").alias("far_slot"),
    )


def neighbour_cells(df: DataFrame, row: str, col: str, reach: int = 1, own: bool = True) -> DataFrame:
    """Each cell once for every cell of its neighbourhood, which ``row`` and ``col`` then name."""
    steps = [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if own or a or b]
    s = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps]))
    return df.withColumn("_s", s).withColumn(row, F.col(row) + F.col("_s.a")).withColumn(col, F.col(col) + F.col("_s.b")).drop("_s")


def row_runs(cells: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """``cells`` (``keys, row, col, id``; ids grow along a row) with ``run``, the first id of the run of cells of a row at most ``reach`` apart."""
    w = Window.partitionBy(*keys, "row").orderBy("col")
    first = F.coalesce(F.col("col") - F.lag("col").over(w) > reach, F.lit(True))
    g = cells.withColumn("_first", F.when(first, F.col("id")))
    return g.withColumn("run", F.last("_first", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_first")


def run_links(cells: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """``keys, run, o_run``: pairs of runs that connect all cells at most ``reach`` rows and columns apart, once each.

    Cells of a row within ``reach`` columns on one side of a column lie in one run, so a cell is linked to the nearest on each side of it in each
    of the rows before its own: ``2 * reach`` links at most, and no row is met in more than ``reach + 1`` copies.
    """
    up = F.explode(F.sequence(F.lit(0), F.lit(reach))).alias("_up")
    g = cells.select(*keys, "row", "col", "run", up).withColumn("row", F.col("row") - F.col("_up"))
    here = F.when(F.col("_up") == 0, F.struct("col", "run"))
    w = Window.partitionBy(*keys, "row")
    before, after = (F.last(here, ignorenulls=True).over(w.orderBy(c, "_up").rowsBetween(Window.unboundedPreceding, 0)) for c in (F.asc("col"), F.desc("col")))
    g = g.withColumn("_a", before).withColumn("_b", after).where("_up > 0")
    g = g.select(*keys, "run", "col", F.explode(F.array("_a", "_b")).alias("_o")).where(F.abs(F.col("col") - F.col("_o.col")) <= reach)
    return g.select(*keys, "run", F.col("_o.run").alias("o_run")).distinct()


def densest_window(df: DataFrame, keys: list[str], x: str, width: float, cells: int) -> DataFrame:
    """``keys, start, n``: the first of the windows of ``cells`` neighbouring bins with the most rows."""
    h = df.groupBy(*keys, floor_bin(F.col(x), width).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*keys).orderBy("bin").rangeBetween(0, cells - 1)
    best = F.max(F.struct(F.col("n"), (-F.col("bin")).alias("m"))).alias("_b")
    return h.withColumn("n", F.sum("c").over(w)).groupBy(*keys).agg(best).select(*keys, (-F.col("_b.m")).alias("start"), F.col("_b.n").alias("n"))


def free_intervals(df: DataFrame, keys: list[str], cell: str, least: int = 1) -> DataFrame:
    """``keys, lo, hi``: runs of at least ``least`` empty cells between occupied ones."""
    w = Window.partitionBy(*keys).orderBy(cell)
    g = df.select(*keys, cell).distinct().withColumn("_n", F.lead(cell).over(w)).where(F.col("_n") - F.col(cell) > least)
    return g.select(*keys, (F.col(cell) + 1).alias("lo"), (F.col("_n") - 1).alias("hi"))
