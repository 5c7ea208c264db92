"""Rules that split the capacity of a link among its cells, one decision per (link, epoch).

Input rows: one per (link, epoch, cell) with ``deadline, priority, cap, capacity, queue_fh, hol_age, backlog, weight`` and
whatever a rule reads (``ewma, persist, q, label, volume``).  Output: the same rows plus ``budget``.

Every rule is running sums and totals over (link, epoch): no iteration and no Python.  A link with very many
cells is still spread over tasks by epoch; nothing collects a group.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import constants as K
from ..functions import quantiles as Q, scalars as S
from ..functions.scalars import col

GROUP = ("link_id", "epoch")


def _total(x, group) -> Column:
    return F.sum(x).over(W.partitionBy(*group))


def project_budgets(df: DataFrame, budget: str = "budget", group: Sequence[str] = GROUP, cap="cap", capacity="capacity") -> DataFrame:
    """NaN -> 0, clip to [0, cap], scale the group down when it exceeds the capacity."""
    clipped = df.withColumn(budget, F.least(F.greatest(S.clean(budget), F.lit(0.0)), col(cap)))
    return (clipped.withColumn("_sum", _total(budget, group))
            .withColumn(budget, F.when(F.col("_sum") > col(capacity), F.col(budget) * col(capacity) / F.col("_sum"))
                        .otherwise(F.col(budget))).drop("_sum"))


def water_fill(df: DataFrame, demand, weight, group: Sequence[str] = GROUP, out: str = "budget", leftover: bool = True,
               tie: str = "cell_id") -> DataFrame:
    """Weighted water-fill in closed form.

    Demands that fit are met and the rest of the capacity goes out in proportion to headroom.  Otherwise everyone
    gets ``min(cap, level * weight * want)``; ordered by ``cap / (weight * want)`` the capped cells form a prefix, so
    running sums tell which ones they are and the level follows.
    """
    want = F.least(F.greatest(col(demand).cast("double"), F.lit(0.0)), F.col("cap"))
    df = df.withColumn("_want", want).withColumn(
        "_wd", F.greatest(col(weight).cast("double"), F.lit(1e-9)) * F.col("_want"))
    df = df.withColumn("_ratio", F.when(F.col("_wd") > 0, F.col("cap") / F.col("_wd")).otherwise(F.lit(float("inf"))))
    before = W.partitionBy(*group).orderBy("_ratio", tie).rowsBetween(W.unboundedPreceding, -1)
    # the ordered frames first: their sort also serves the totals
    df = df.withColumns({"_taken": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "_passed": F.coalesce(F.sum("_wd").over(before), F.lit(0.0))})
    df = df.withColumns({"_need": _total("_want", group), "_room": _total(F.col("cap") - F.col("_want"), group), "_open": _total("_wd", group)})
    df = df.withColumn("_open", F.greatest(F.col("_open") - F.col("_passed"), F.col("_wd")))
    df = df.withColumn("_full", (F.col("_wd") > 0) & (F.col("capacity") - F.col("_taken") >= F.col("_ratio") * F.col("_open")))
    df = df.withColumns({
        "_capped": F.coalesce(_total(F.when(F.col("_full"), F.col("cap")), group), F.lit(0.0)),
        "_free": F.coalesce(_total(F.when(~F.col("_full"), F.col("_wd")), group), F.lit(0.0))})
    level = (F.col("capacity") - F.col("_capped")) / F.col("_free")
    short = F.when(F.col("_full"), F.col("cap")).when(F.col("_free") > 0, F.least(level * F.col("_wd"), F.col("cap"))).otherwise(F.lit(0.0))
    left = F.col("capacity") - F.col("_need")
    room = F.col("cap") - F.col("_want")
    extra = F.when((left > 1e-9) & (F.col("_room") > 1e-9), F.least(room, left * room / F.col("_room"))).otherwise(F.lit(0.0))
    fits = F.col("_want") + extra if leftover else F.col("_want")
    return df.withColumn(out, F.when(F.col("_need") <= F.col("capacity"), fits).otherwise(short)).drop(
        "_want", "_wd", "_ratio", "_need", "_room", "_taken", "_passed", "_open", "_full", "_capped", "_free")


def greedy_fill(df: DataFrame, demand, score, group: Sequence[str] = GROUP, out: str = "_given") -> DataFrame:
    """Serve demands in decreasing score from the running remainder; cell_id breaks ties."""
    df = df.withColumn("_d", F.least(col(demand), F.col("cap"))).withColumn("_score", col(score))
    w = W.partitionBy(*group).orderBy(F.desc("_score"), "cell_id").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_d").over(w), F.lit(0.0))
    return df.withColumn(out, F.greatest(F.least(F.col("_d"), F.col("capacity") - before), F.lit(0.0))).drop("_d", "_score")


# --- reactive rules -------------------------------------------------------------------------------------
def static_equal(df: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    df = df.withColumn("_share", F.col("capacity") / F.count("*").over(W.partitionBy(*group)))
    return water_fill(df, "_share", F.lit(1.0), group).drop("_share")


def reactive_proportional(df: DataFrame, interval: int, margin=0.0, group: Sequence[str] = GROUP) -> DataFrame:
    return water_fill(df, F.col("queue_fh") / interval + (F.lit(1.0) + col(margin)) * F.col("ewma"), F.lit(1.0), group)


def deadline_aware(df: DataFrame, margin=0.0, group: Sequence[str] = GROUP) -> DataFrame:
    return water_fill(df, F.col("backlog") + (F.lit(1.0) + col(margin)) * F.col("persist"), "weight", group)


def max_weight(df: DataFrame, interval: int, margin=0.0, hol_weight=0.0, group: Sequence[str] = GROUP) -> DataFrame:
    """Greedy fill by priority x backlog (x head-of-line age), headroom spread afterwards."""
    demand = F.col("queue_fh") / interval + (F.lit(1.0) + col(margin)) * F.col("ewma")
    urgency = F.lit(1.0) + col(hol_weight) * F.col("hol_age") / F.col("deadline")
    score = F.col("priority") * (F.col("queue_fh") + F.lit(1e-6) * F.col("ewma")) * urgency
    return water_fill(greedy_fill(df, demand, score, group), "_given", F.lit(1.0), group).drop("_given")


# --- forecast rules ---------------------------------------------------------------------------------------
def median_of(q="q") -> Column:
    return F.get(col(q), F.lit(Q.nearest_level(0.5)))


def point_forecast(df: DataFrame, margin=0.0, group: Sequence[str] = GROUP) -> DataFrame:
    return water_fill(df, F.col("backlog") + (F.lit(1.0) + col(margin)) * median_of(), "weight", group)


def fixed_quantile(df: DataFrame, level=0.9, group: Sequence[str] = GROUP) -> DataFrame:
    return water_fill(df, F.col("backlog") + Q.interp("q", col(level)), "weight", group)


def predictive_max_weight(df: DataFrame, interval: int, horizon: int, margin=0.0, lookahead=1.0,
                          group: Sequence[str] = GROUP) -> DataFrame:
    demand = F.col("queue_fh") / interval + (F.lit(1.0) + col(margin)) * median_of()
    score = F.col("priority") * (F.col("queue_fh") + col(lookahead) * horizon * median_of())
    return water_fill(greedy_fill(df, demand, score, group), "_given", F.lit(1.0), group).drop("_given")


def class_levels(df: DataFrame, horizon: int, p_ll=0.9, p_embb=0.5, w_ll=3.0, group: Sequence[str] = GROUP) -> DataFrame:
    """Per-class quantile levels and a free low-latency weight (parameters may be columns)."""
    ll = S.is_low_latency("deadline")
    demand = F.col("backlog") + Q.inverse_cdf("q", F.when(ll, col(p_ll)).otherwise(col(p_embb)))
    urgency = S.deadline_weight(F.lit(1.0), "deadline", horizon)
    return water_fill(df, demand, urgency * F.when(ll, col(w_ll)).otherwise(F.lit(1.0)), group)


# --- hindsight rules ----------------------------------------------------------------------------------------
def hindsight(df: DataFrame, group: Sequence[str] = GROUP) -> DataFrame:
    return water_fill(df, F.col("backlog") + F.col("label"), "weight", group)


def hindsight_tiers(df: DataFrame, unit: float, target: str = "label", group: Sequence[str] = GROUP) -> DataFrame:
    """Needs in whole units, weight tiers served in order, the marginal tier shares in proportion to need."""
    need = F.least(S.units_up(F.col("backlog") + F.col(target), F.lit(unit)), F.col("cap"))
    df = df.withColumn("_need1", need).withColumn("_tier", F.round("weight", 9))
    df = water_fill(df, "_need1", "weight", group, out="_fit")
    through = F.sum("_need1").over(W.partitionBy(*group).orderBy(F.desc("_tier")).rangeBetween(W.unboundedPreceding, W.currentRow))
    df = df.withColumns({"_through": through, "_tiersum": _total("_need1", [*group, "_tier"]), "_all": _total("_need1", group)})
    left = F.col("capacity") - (F.col("_through") - F.col("_tiersum"))
    share = (F.when(F.col("_tiersum") <= left, F.col("_need1"))
             .when((left > 0) & (F.col("_tiersum") > 0), F.col("_need1") * left / F.col("_tiersum")).otherwise(F.lit(0.0)))
    return df.withColumn("budget", F.when(F.col("_all") <= F.col("capacity"), F.col("_fit")).otherwise(F.least(share, F.col("cap")))).drop(
        "_need1", "_tier", "_fit", "_through", "_tiersum", "_all")


# --- scoring ------------------------------------------------------------------------------------------------
def weighted_shortfall(df: DataFrame, horizon: int, group: Sequence[str] = GROUP) -> DataFrame:
    """Per decision: sum of priority x (D + 1) x max(backlog + label - budget, 0), relative to capacity x horizon."""
    short = F.greatest(F.col("backlog") + F.col("label") - F.col("budget"), F.lit(0.0))
    return df.groupBy(*group).agg(
        (F.sum(F.col("priority") * (F.col("deadline") + 1) * short) / (F.first("capacity") * horizon)).alias("shortfall"))
