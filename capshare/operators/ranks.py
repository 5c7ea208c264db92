"""Ranks and exact percentiles of groups of any size.

Rows are cut into ranges of (keys, order) that Spark's range partitioning makes even, so one large group spreads over as many ranges as it fills. Ranks are made
inside ranges; only a row per range and group runs through a window.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import shared_dir


def ranked(df: DataFrame, keys: Sequence[str], order: str, weight: str | None = None) -> DataFrame:
    """``pos``: rows (or weight) of the group before the row by ``order``; ``n``: of the whole group."""
    shared_dir(df.sparkSession)
    keys = list(keys)
    each = F.col(weight) if weight else F.lit(1).cast("bigint")
    cut = df.repartitionByRange(*keys, order).withColumn("_range", F.spark_partition_id()).checkpoint()
    w = W.partitionBy(*keys)
    sizes = cut.groupBy(*keys, "_range").agg(F.sum(each).alias("_n")).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), (F.sum("_n").over(w.orderBy("_range")) - F.col("_n")).alias("_before"), F.sum("_n").over(w).alias("n"))
    inside = F.coalesce(F.sum(each).over(W.partitionBy(*keys, "_range").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = cut.withColumn("_inside", inside).join(sizes, same)
    return out.withColumn("pos", F.col("_before") + F.col("_inside")).select(*df.columns, "pos", "n")


def percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], out: str = "q") -> DataFrame:
    """(keys, ``out`` array): linear percentiles of the values that are not null. Equal values are counted first; of each group only the values at the ranks that
    the percentiles lie between meet. Groups without a value are absent."""
    keys = list(keys)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    rows = ranked(counts, keys, "_v", "_c")
    at = [F.lit(float(p)) * (F.col("n") - 1) for p in probs]
    inside = lambda h: (F.col("pos") <= h) & (h < F.col("pos") + F.col("_c"))
    near = None
    for h in at:
        for x in (F.floor(h), F.ceil(h)):
            near = inside(x) if near is None else near | inside(x)
    picked = rows.where(near).groupBy(*keys).agg(*[F.max(F.when(inside(x), F.col("_v"))).alias(f"_{i}{s}") for i, h in enumerate(at) for s, x in (("lo", F.floor(h)), ("hi", F.ceil(h)))], F.max("n").alias("n"))
    lines = [F.col(f"_{i}lo") + (h - F.floor(h)) * (F.col(f"_{i}hi") - F.col(f"_{i}lo")) for i, h in enumerate(at)]
    return picked.select(*keys, F.array(*[F.when(h == F.floor(h), F.col(f"_{i}lo")).otherwise(x).cast("double") for i, (h, x) in enumerate(zip(at, lines, strict=True))]).alias(out))
