"""Quantile functions held as arrays of knots at fixed levels."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..constants import QUANTILE_LEVELS
from .scalars import col


def nearest_level(target: float, levels=QUANTILE_LEVELS) -> int:
    """Index of the level nearest a target; the first one on a tie."""
    return min(range(len(levels)), key=lambda i: (abs(levels[i] - target), i))


def _segment(q: Column, p: Column, levels, i: int) -> Column:
    lo, hi = levels[i], levels[i + 1]
    a, b = F.get(q, F.lit(i)), F.get(q, F.lit(i + 1))
    return a + (b - a) / F.lit(hi - lo) * (p - F.lit(lo))


def interp(q, p, levels=QUANTILE_LEVELS) -> Column:
    """Piecewise linear read of the knots, clamped on both sides."""
    q, p = col(q), col(p)
    out = F.when(p <= F.lit(levels[0]), F.get(q, F.lit(0)))
    for i in range(len(levels) - 1):
        out = out.when(p <= F.lit(levels[i + 1]), _segment(q, p, levels, i))
    return out.otherwise(F.get(q, F.lit(len(levels) - 1)))


def inverse_cdf(q, p, levels=QUANTILE_LEVELS) -> Column:
    """Like ``interp`` but extrapolated linearly above the last level; never negative."""
    q, p = col(q), col(p)
    last = len(levels) - 1
    slope = (F.get(q, F.lit(last)) - F.get(q, F.lit(last - 1))) / F.lit(max(levels[last] - levels[last - 1], 1e-6))
    above = F.get(q, F.lit(last)) + slope * (p - F.lit(levels[last]))
    return F.greatest(F.when(p > F.lit(levels[last]), above).otherwise(interp(q, p, levels)), F.lit(0.0))


def tidy(q) -> Column:
    """Quantiles are not negative and do not cross."""
    return F.sort_array(F.transform(col(q), lambda x: F.greatest(x, F.lit(0.0))))


def shift_levels(q, eps, levels=QUANTILE_LEVELS) -> Column:
    """Knots that report the quantile at ``level + eps`` (kept inside the first and last level)."""
    return F.array(*[interp(q, F.least(F.greatest(F.lit(a) + col(eps), F.lit(levels[0])), F.lit(levels[-1])), levels)
                     for a in levels])


def _high(x: Column) -> Column:
    """The upper 26 bits of a double."""
    t = x * F.lit(134217729.0)
    return t - (t - x)


def fused(parts: Column) -> Column:
    """``x * y + z`` of an array of (x, y, z), rounded once: DuckDB interpolates so, and outcomes are compared with the quantiles bit by bit."""
    halves = F.transform(parts, lambda t: F.struct((t["x"] * t["y"]).alias("p"), t["z"].alias("z"), _high(t["x"]).alias("xh"), _high(t["y"]).alias("yh"),
                                                   t["x"].alias("x"), t["y"].alias("y")))

    def exact(t):
        xl, yl = t["x"] - t["xh"], t["y"] - t["yh"]
        e = ((t["xh"] * t["yh"] - t["p"]) + t["xh"] * yl + xl * t["yh"]) + xl * yl      # what the product lost
        return F.struct((t["p"] + t["z"]).alias("s"), t["p"].alias("p"), t["z"].alias("z"), e.alias("e"))

    def rounded(t):
        v = t["s"] - t["p"]
        lost = (t["p"] - (t["s"] - v)) + (t["z"] - v)                                   # what the sum lost
        return t["s"] + F.nanvl(lost + t["e"], F.lit(0.0))

    return F.transform(F.transform(halves, exact), rounded)


def sorted_quantiles(ascending, levels=QUANTILE_LEVELS) -> Column:
    """Linear-interpolated quantiles of an array that is already sorted.

    Sort in a column of its own first (``F.sort_array``): the array is read twice per level.
    """
    s = col(ascending)
    n = F.size(s)

    def ends(level):
        pos = (n - 1).cast("double") * level
        lo = F.floor(pos).cast("int")
        d = pos - lo
        return F.struct(F.get(s, lo).alias("x"), (F.lit(1.0) - d).alias("y"), (F.get(s, F.least(lo + 1, n - 1)) * d).alias("z"))

    return fused(F.transform(F.array(*[F.lit(a) for a in levels]), ends))


def read_at_grid(q, levels=QUANTILE_LEVELS, grid: int = 99) -> Column:
    """Knots read at ``grid`` mid-levels (member of a mixture); the first and the last segment go on beyond their ends."""
    q = col(q)
    inner = levels[1:-1]                     # borders between segments
    mids = [F.lit((2 * g + 1) / (2 * grid)) for g in range(grid)]
    return F.array(*[_segment(q, p, levels, sum((2 * g + 1) / (2 * grid) > b for b in inner)) for g, p in enumerate(mids)])
