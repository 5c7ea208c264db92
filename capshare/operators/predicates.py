"""Row selection: subsets, fallbacks, splits, thinning."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..constants import QUANTILE_LEVELS
from ..functions import quantiles as Q, scalars as S
from .series import running_total


def method_subset(runs: DataFrame, methods: Sequence[str], also: str | None = None, without_prefix: str | None = None,
                  scenario: str = "scenario", method: str = "method") -> DataFrame:
    """Methods of a list (plus one exception), scenarios without a prefix."""
    keep = F.col(method).isin(list(methods))
    if also:
        keep = keep | (F.col(method) == also)
    if without_prefix:
        keep = keep & ~F.col(scenario).startswith(without_prefix)
    return runs.where(keep)


def whole_group_fallback(df: DataFrame, value: str, fallback: str, group: Sequence[str], out: str) -> DataFrame:
    """One bad value sends its whole group to the fallback."""
    bad = F.max((~S.is_finite(value)).cast("int")).over(W.partitionBy(*group)) == 1
    return df.withColumn(out, F.when(bad, F.col(fallback)).otherwise(F.col(value)))


def positional_split(df: DataFrame, keys: Sequence[str], order: str, share: float, chunk: int) -> DataFrame:
    """First ``share`` of each key's rows along a unique integer order is 'train', the rest 'test'."""
    ranked = running_total(df.withColumn("_one", F.lit(1)), keys, order, "_one", "_rank", chunk)
    n = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    return (ranked.join(n, [*keys]).withColumn("split", F.when(F.col("_rank") <= share * F.col("_n"), "train").otherwise("test"))
            .drop("_one", "_rank", "_n"))


def thin_to_share(df: DataFrame, keys: Sequence[str], row_id: str, value: str, share: float) -> DataFrame:
    """Keep the rows with the smallest hash numbers whose running total stays within ``share`` of the key's total.

    The number is a fixed linear congruence of the row id, so the choice is the same however the data is partitioned.
    The running total is two-level: at most 2^16 buckets per key are summed in one task.
    """
    u = (F.pmod(F.col(row_id), F.lit(2147483648)) * F.lit(1103515245) + F.lit(12345)) % F.lit(2147483648)
    df = df.withColumn("u", u)
    per = df.groupBy(*keys, "u").agg(F.sum(value).alias("_v"))
    run = running_total(per, keys, "u", "_v", "_cum", 1 << 15)
    total = per.groupBy(*keys).agg(F.sum("_v").alias("_total"))
    keep = run.join(total, [*keys]).where(F.col("_cum") <= share * F.col("_total")).select(*keys, "u")
    return df.join(keep, [*keys, "u"], "left_semi")


def first_n(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """Rows whose ``order`` value is among the first ``n`` distinct ones of the key."""
    values = df.select(*keys, order).distinct()
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    keep = values.withColumn("_k", rank).where(F.col("_k") <= n).drop("_k")
    return df.join(keep, [*keys, order], "left_semi")


def mixture(members: DataFrame, keys: Sequence[str], q: str = "q", levels=QUANTILE_LEVELS, grid: int = 99) -> DataFrame:
    """Quantiles of the equal-weight mixture of the members of each key.

    A member travels as its knots; its ``grid`` values are read where the members of a key have met, sorted once and never exploded.
    """
    met = members.groupBy(*keys).agg(F.collect_list(q).alias("_q"))
    pooled = met.select(*keys, F.sort_array(F.array_compact(F.flatten(F.transform("_q", lambda m: Q.read_at_grid(m, levels, grid))))).alias("_v"))
    got = pooled.select(*keys, F.when(F.size("_v") > 0, Q.sorted_quantiles("_v", levels)).alias(q))
    return got.withColumn(q, F.transform(q, lambda x: F.greatest(x, F.lit(0.0))))
