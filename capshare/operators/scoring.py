"""Scores of quantile forecasts."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..constants import QUANTILE_LEVELS
from ..functions import quantiles as Q


def forecast_scores(df: DataFrame, keys: Sequence[str], label: str, q: str, levels=QUANTILE_LEVELS, digits: int | None = 6) -> DataFrame:
    """Pinball loss, coverage per level, median error and central-interval figures, in one aggregate."""
    y = F.col(label)
    at = [F.get(q, F.lit(i)) for i in range(len(levels))]
    pin = None
    for a, v in zip(levels, at):
        term = F.avg(F.greatest(F.lit(a) * (y - v), F.lit(a - 1) * (y - v)))
        pin = term if pin is None else pin + term
    mid, lo, hi = at[Q.nearest_level(0.5, levels)], at[Q.nearest_level(0.05, levels)], at[Q.nearest_level(0.95, levels)]
    mae, mean = F.avg(F.abs(y - mid)), F.greatest(F.avg(y), F.lit(1e-9))
    cols = {f"coverage_q{int(round(a * 100)):02d}": F.avg((y <= v).cast("int")) for a, v in zip(levels, at)}
    cols |= {"pinball_mean": pin / len(levels), "median_mae": mae, "median_mae_rel": mae / mean,
             "interval90_coverage": F.avg(((y >= lo) & (y <= hi)).cast("int")), "interval90_width_rel": F.avg(hi - lo) / mean}
    return df.groupBy(*keys).agg(*[(F.round(c, digits) if digits is not None else c).alias(n) for n, c in cols.items()])
