"""Column builders: angles, corridor geometry, bins, bands, confidence and number formats."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

#: Half-open distance bands of every report; 300 and over has no band.
BANDS = [(0, 20), (20, 50), (50, 100), (100, 150), (150, 200), (200, 300)]


def lit(x: float) -> Column:
    return F.lit(float(x))


def is_valid_point(x: Column, y: Column, z: Column) -> Column:
    """Finite, and not the all-zero placeholder; a single zero coordinate is fine."""
    finite = F.lit(True)
    for c in (x, y, z):
        finite = finite & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return finite & ~((x == 0) & (y == 0) & (z == 0))


def permuted_axes(x: Column, y: Column, z: Column, axes: tuple[str, str, str]) -> tuple[Column, ...]:
    """Signed permutation of axes, such as ``("+x", "-y", "+z")``, as (along, side, up)."""
    by = {"x": x, "y": y, "z": z}
    return tuple(by[a[-1]] if a[0] == "+" else -by[a[-1]] for a in axes)


def range_of(d: Column, s: Column, h: Column) -> Column:
    return F.sqrt(d * d + s * s + h * h)


def azimuth_deg(d: Column, s: Column) -> Column:
    return F.degrees(F.atan2(s, d))


def elevation_deg(h: Column, r: Column) -> Column:
    return F.degrees(F.asin(F.greatest(lit(-1), F.least(lit(1), h / r))))


def wrap_deg(a: Column) -> Column:
    """An angle in (-180, 180]."""
    w = F.pmod(a + 180.0, lit(360)) - 180.0
    return F.when(w == -180.0, lit(180)).otherwise(w)


def rail_height(d: Column, z0: float, grade: float, curv: float, until: float) -> Column:
    """Quadratic up to ``until``, its tangent beyond."""
    near = F.least(d, lit(until))
    slope = grade + 2 * curv * until
    return lit(z0) + grade * near + curv * near * near + slope * F.greatest(lit(0), d - until)


def centre_line(d: Column, l0: float, a: float, b: float) -> Column:
    return lit(l0) + a * d + b * d * d


def curve_factor(b: float, low: float = 2.5e-4, high: float = 3.5e-4, at_low: float = 0.1, at_high: float = 0.25) -> float:
    """Share of a curve's sagitta that narrows the corridor: a ramp in the curvature's size."""
    t = min(1.0, max(0.0, (abs(b) - low) / (high - low)))
    return at_low + t * (at_high - at_low)


def curve_factor_of(b: Column, low: float = 2.5e-4, high: float = 3.5e-4, at_low: float = 0.1, at_high: float = 0.25) -> Column:
    """``curve_factor`` of a column of curvatures."""
    t = F.greatest(lit(0), F.least(lit(1), (F.abs(b) - low) / (high - low)))
    return lit(at_low) + t * (at_high - at_low)


def corridor_bottom(d: Column, bed_until: float, seen_until: float, rms: float, bed_slope: float = 0.004) -> Column:
    """Lower edge of the clearance corridor: it rises where the bed, and then the rail, was not seen."""
    beyond, bed = F.greatest(lit(0), d - seen_until), F.greatest(lit(0), d - bed_until)
    return lit(0.30) + 0.002 * d + bed_slope * (bed - beyond) + 0.008 * beyond + rms


def corridor_top(d: Column, seen_until: float, rms: float) -> Column:
    """Upper edge of the clearance corridor."""
    return lit(3.40) - 0.002 * d - 0.006 * F.greatest(lit(0), d - seen_until) - rms


def corridor_half_width(d: Column, dh: Column, b: float, low: float = 1.0, high: float = 1.4, step: float = 0.8, shrink: float = 0.003, closed: float = 0.7) -> Column:
    """Half width of the clearance corridor at a distance and height; -1 where it is closed."""
    w = F.when(dh < step, lit(low)).otherwise(lit(high)) - shrink * d - curve_factor(b) * abs(b) * d * d
    return F.when(w < closed, lit(-1)).otherwise(w)


def in_corridor(d: Column, dl: Column, dh: Column, b: float, reach: float) -> Column:
    """Corridor membership with floor and ceiling that close in beyond ``reach``."""
    beyond = F.greatest(lit(0), d - reach)
    bottom = lit(0.30) + 0.002 * d + 0.008 * beyond
    top = lit(3.40) - 0.002 * d - 0.006 * beyond
    return (F.abs(dl) <= corridor_half_width(d, dh, b)) & (dh >= bottom) & (dh <= top)


def glob_pattern(pattern: str, separator: bool = False) -> str:
    """A regular expression of a shell pattern, for the whole of a text; with ``separator``, ``*`` stops at a slash but for the last."""
    out, k = "", 0
    last = pattern.rfind("*")
    while k < len(pattern):
        c = pattern[k]
        if c == "*":
            out += "[^/]*" if separator and k != last else ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in pattern[k + 1 :]:
            end = pattern.index("]", k + 1)
            out += "[" + pattern[k + 1 : end].replace("!", "^", 1 if pattern[k + 1] == "!" else 0) + "]"
            k = end
        else:
            out += "\\" + c if c in ".^$+{}()|\\[]" else c
        k += 1
    return f"^{out}$"


def stamp_parts(ns: Column) -> tuple[Column, Column]:
    """Whole seconds and the rest of a stamp in nanoseconds, rounded down before 1970 too."""
    sec = F.floor(ns / F.lit(1_000_000_000).cast("decimal(20,0)")).cast("long")
    return sec, ns - sec * 1_000_000_000


def floor_bin(x: Column, width: float) -> Column:
    """Index of equal-width bins, negative numbers included."""
    return F.floor(x / width).cast("long")


def digitize(x: Column, edges: list[float]) -> Column:
    """Number of edges at or below x: left-closed bins of any widths."""
    out = F.lit(0)
    for e in edges:
        out = out + F.when(x >= e, 1).otherwise(0)
    return out.cast("long")


def histogram_bin(x: Column, low: float, high: float, bins: int) -> Column:
    """Index of equal-width bins from ``low`` to ``high``; the last is closed at both ends, beyond is null."""
    k = F.floor((x - low) / ((high - low) / bins)).cast("long")
    return F.when(x == high, F.lit(bins - 1).cast("long")).when((x >= low) & (x < high), k)


def band_label(d: Column, bands: list[tuple[int, int]] = BANDS) -> Column:
    out = F.lit(None).cast("string")
    for lo, hi in bands:
        out = F.when((d >= lo) & (d < hi), F.lit(f"{lo}-{hi}")).otherwise(out)
    return out


def confidence(n: Column, d: Column) -> Column:
    """Support relative to what is expected at a distance, at most one."""
    k = F.greatest(lit(1), d / 20.0)
    return F.least(lit(1), n / F.greatest(lit(3), 60.0 / (k * k)))


def quantise(x: Column, step: float) -> Column:
    """Nearest multiple of a step, half to even."""
    return F.rint(x / step) * step


def status_of(kind: Column) -> Column:
    """A frame's status by the kind of its event."""
    return F.when(kind == "error", "detected").when(kind == "signup", "unknown").otherwise("clear")


def standard_normal(a: Column, b: Column) -> Column:
    """A standard normal of two uniforms, the first above zero."""
    return F.sqrt(-2.0 * F.log(a)) * F.cos(2.0 * F.pi() * b)


def logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def gauge_overlap(lo: Column, hi: Column, bottom: Column, top: Column, half: float = 1.4, low: float = 0.10, high: float = 3.4) -> Column:
    """Whether an object's side and height ranges meet the gauge."""
    return (lo <= half) & (hi >= -half) & (bottom <= high) & (top >= low)


def precision_recall(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1; F1 is null where either is null or zero."""
    p, r = tp / F.nullif(tp + fp, F.lit(0)), tp / F.nullif(tp + fn, F.lit(0))
    return p, r, F.when((p > 0) & (r > 0), 2 * p * r / (p + r))


def ring_column_firing(slot: Column, rings: int, columns: int) -> tuple[Column, Column, Column]:
    """Ring, column and firing parity of an organised slot."""
    return (slot % rings).cast("long"), F.floor(slot / rings).cast("long") % columns, (F.floor(slot / rings) % 2).cast("long")


def box_distance(origin: tuple, direction: tuple, low: tuple, high: tuple) -> Column:
    """Distance along a ray to an axis-aligned box (slab test); null if it misses."""
    near, far = lit(0), lit(float("inf"))
    miss = F.lit(False)
    for o, v, a, b in zip(origin, direction, low, high, strict=True):
        t1, t2 = (a - o) / F.nullif(v, lit(0)), (b - o) / F.nullif(v, lit(0))
        flat = v == 0
        miss = miss | (flat & ((o < a) | (o > b)))
        near = F.when(flat, near).otherwise(F.greatest(near, F.least(t1, t2)))
        far = F.when(flat, far).otherwise(F.least(far, F.greatest(t1, t2)))
    return F.when(~miss & (near <= far), near)


def erf(x: Column) -> Column:
    """Error function by a rational approximation of absolute error under 1.5e-7."""
    t = 1.0 / (1.0 + 0.3275911 * F.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1.0 - poly * F.exp(-x * x))


def exact_sum(x: Column, over: WindowSpec | None = None) -> Column:
    """Sum of doubles that is rounded once, so it is the same in any order of the rows and a tie at a limit is decided by the values alone.

    Values are whole numbers of 2^-24 and of 2^-64, summed as such; where one is 2^28 or more or not finite, or there are too many, it is the plain sum.
    """
    part = (lambda c: c) if over is None else (lambda c: c.over(over))
    scaled = x * 2.0**24
    usual = F.abs(scaled) < 2.0**52
    high = F.when(usual, F.rint(scaled))
    low = F.rint((scaled - high) * 2.0**40)
    total = (part(F.try_sum(high.cast("long"))) + part(F.try_sum(low.cast("long"))) * 2.0**-40) * 2.0**-24
    return F.coalesce(F.when(part(F.bool_and(usual)), total), part(F.sum(x)))


def exact_avg(x: Column) -> Column:
    """Average of doubles by ``exact_sum``."""
    return exact_sum(x) / F.nullif(F.count(x), F.lit(0))
