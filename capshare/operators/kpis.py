"""Key figures of replayed runs: every one is an algebraic aggregate that combines before the shuffle."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import scalars as S
from ..functions.scalars import col


def ratio(part, whole) -> Column:
    return F.sum(part) / F.greatest(F.sum(whole).cast("double"), F.lit(1e-9))


def violation_ratios() -> list[Column]:
    """Weighted, plain, low-latency and eMBB violation ratios of (arrived, violated, priority, deadline) rows."""
    ll = S.is_low_latency("deadline")

    def only(cond, name):
        return F.coalesce(F.sum(F.when(cond, F.col(name))), F.lit(0))

    def safe(a, b):
        return a / F.greatest(b.cast("double"), F.lit(1e-9))

    return [
        safe(F.sum(F.col("priority") * F.col("violated")), F.sum(F.col("priority") * F.col("arrived"))).alias("weighted_violation_ratio"),
        F.when(F.sum("arrived") > 0, F.sum("violated") / F.sum("arrived")).otherwise(F.lit(0.0)).alias("violation_ratio"),
        safe(only(ll, "violated"), only(ll, "arrived")).alias("violation_ratio_ll"),
        safe(only(~ll, "violated"), only(~ll, "arrived")).alias("violation_ratio_embb")]


def jain(x) -> Column:
    """Jain index (sum x)^2 / (n sum x^2); 1 when all are zero."""
    x = col(x)
    sq = F.sum(x * x)
    return F.when(sq == 0, F.lit(1.0)).otherwise(F.pow(F.sum(x), F.lit(2.0)) / (F.count(x) * sq))


def service_ratios(df: DataFrame, run: Sequence[str], cell: str = "cell_id") -> DataFrame:
    per = df.groupBy(*run, cell).agg(F.sum("arrived").alias("a"), F.sum("served").alias("s"))
    return per.withColumn("ratio", F.when(F.col("a") > 0, F.col("s") / F.col("a")).otherwise(F.lit(1.0)))


def delay_percentile(hist: DataFrame, keys: Sequence[str], age: str, bits: str, p: float, slot_ms: float) -> DataFrame:
    """Mean and discrete percentile of a delay histogram: the first bucket whose cumulative share reaches p.

    The histogram is summed per (keys, age) first; ages are bounded by the deadline, so the window is tiny.
    """
    h = hist.groupBy(*keys, age).agg(F.sum(bits).alias("_b"))
    w = W.partitionBy(*keys)
    h = h.withColumn("_t", F.sum("_b").over(w)).withColumn(
        "_c", F.sum("_b").over(w.orderBy(age).rowsBetween(W.unboundedPreceding, 0)) / F.col("_t"))
    return h.groupBy(*keys).agg((F.sum(F.col("_b") * F.col(age)) / F.greatest(F.sum("_b"), F.lit(1e-9)) * slot_ms).alias("mean_delay"),
                                (F.min(F.when(F.col("_c") >= p, F.col(age))) * slot_ms).alias("pct_delay"))
