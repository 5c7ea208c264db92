"""Training, sequence and context tables for forecasters, and a model-free phase forecast."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from ..functions import scalars as S
from . import series
from .series import Clock

ID = ("link_id", "cell_id", "epoch")


def feature_columns(clock: Clock) -> list[str]:
    return ([f"lag_mean_{k + 1}" for k in range(K.LAG_BLOCKS)] + ["lag_mean", "lag_std", "lag_max"]
            + [f"ewma_{n}" for n in (clock.interval, 10 * clock.interval)]
            + [f"last_slot_{k + 1}" for k in range(K.LAST_SLOTS)] + [f"rstar_lag_{k + 1}" for k in range(K.RATE_LAGS)])


def training_table(features: DataFrame, clock: Clock, peak, n_slots: int, sustain: bool = False) -> DataFrame:
    """20 scaled features, one column per cell class, and the scaled label, for epochs with history and a full horizon.

    Scaling uses the configured peak only, never a statistic of the data.
    """
    names = feature_columns(clock)
    cls = F.col("cell_id") % len(K.CELL_CLASSES)
    nominal = F.element_at(F.array(*[F.lit(K.DATA_RES * c[4]) for c in K.CELL_CLASSES]), (cls + 1).cast("int"))
    label = F.greatest("label", "label_mean") if sustain else F.col("label")
    return features.where(series.enough_history(clock) & (F.col("epoch") < n_slots - clock.interval)).select(
        *ID, *[(F.col(c) / peak).alias(c) for c in names], (F.col("se") / nominal).alias("se_rel"),
        (F.col("deadline") / clock.horizon).alias("deadline_rel"),
        *[(cls == i).cast("double").alias(f"cell_{i}") for i in range(len(K.CELL_CLASSES))], (label / peak).alias("y"))


def conditioning(cells: DataFrame, horizon: int) -> DataFrame:
    """Deadline in horizons and priority relative to the highest; the maximum is one row."""
    top = cells.agg(F.max("priority").alias("_top"))
    return cells.crossJoin(F.broadcast(top)).select("cell_id", (F.col("deadline") / horizon).alias("deadline_rel"),
                                                    (F.col("priority") / F.col("_top")).alias("priority_rel"))


def sequence_table(patches: DataFrame, training: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per (link, epoch) that holds every cell of the link, sorted by cell: patches, features, label (single precision).

    A row is as wide as the link has cells, which is what the consumer needs; links x epochs spread over the tasks.
    """
    flt = [F.col(n).cast("float") for n in names]
    j = patches.select(*ID, "patches").join(training.select(*ID, F.array(*flt).alias("x"), F.col("y").cast("float").alias("y")), [*ID])
    packed = j.groupBy("link_id", "epoch").agg(F.sort_array(F.collect_list(F.struct("cell_id", "patches", "x", "y"))).alias("s"))
    return packed.select("link_id", "epoch", F.col("s.cell_id").alias("cells"), F.col("s.patches").alias("patches"), F.col("s.x").alias("x"), F.col("s.y").alias("y"))


def context_table(decisions: DataFrame, training: DataFrame) -> DataFrame:
    """Logged decisions with their features: backlog, weight and raw label next to the scaled features."""
    return decisions.select(*ID, "backlog", "weight", F.col("label").alias("rate")).join(training.drop("y"), [*ID])


def phase_forecast(history: DataFrame, current: DataFrame, levels=K.QUANTILE_LEVELS) -> DataFrame:
    """Quantiles of past rates by (cell, starting phase), read at each current row's phase."""
    fit = history.groupBy("cell_id", "phase").agg(F.percentile("rate", F.array(*[F.lit(a) for a in levels])).alias("q"), F.count("*").alias("seen"))
    return current.join(fit, ["cell_id", "phase"])
