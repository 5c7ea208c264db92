"""Phase chains fitted to the last slots of each key: quantile cuts, transitions, phase moments, long-run shares."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

CUTS = (0.45, 0.85)


def assign(series: DataFrame, keys: Sequence[str], value: str, cuts: Sequence[float] = CUTS) -> DataFrame:
    """Phase of each row = number of the key's quantile cuts that are not above the value."""
    q = series.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(c) for c in cuts])).alias("_cuts"), F.count("*").alias("_w"))
    return series.join(q, [*keys]).withColumn("phase", F.size(F.filter("_cuts", lambda c: c <= F.col(value)))).drop("_cuts")


def transitions(phased: DataFrame, keys: Sequence[str], order: str, k: int = 3, prior: float = 0.5, chunk: int = 4096,
                min_rows: int = 10) -> DataFrame:
    """(key, from, to, p): counts of neighbouring slots plus a symmetric prior, rows normalised.

    Slots are dense, so the next phase is an equi-join-free ``lead`` inside a chunk that also holds the next chunk's first slot.
    """
    c = F.floor(F.col(order) / chunk).cast("bigint")
    cut = phased.withColumn("_c", F.explode(F.when((F.col(order) % chunk == 0) & (c > 0), F.array(c - 1, c)).otherwise(F.array(c))))
    nxt = F.lead("phase").over(W.partitionBy(*keys, "_c").orderBy(order))
    pairs = cut.withColumn("to", nxt).where(F.col("to").isNotNull() & (F.floor(F.col(order) / chunk) == F.col("_c")))
    counts = pairs.groupBy(*keys, F.col("phase").alias("from"), "to").agg(F.count("*").alias("_n"))
    grid = (phased.groupBy(*keys).agg(F.first("_w").alias("_w"))
            .select(*keys, "_w", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("from"))
            .select(*keys, "_w", "from", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("to")))
    dense = grid.join(counts, [*keys, "from", "to"], "left").withColumn("_x", F.coalesce(F.col("_n"), F.lit(0)) + prior)
    p = F.col("_x") / F.sum("_x").over(W.partitionBy(*keys, "from"))
    return dense.select(*keys, "from", "to", F.when(F.col("_w") < min_rows, F.lit(1.0 / k)).otherwise(p).alias("p"))


def moments(phased: DataFrame, keys: Sequence[str], value: str, k: int = 3, min_rows: int = 10) -> DataFrame:
    """(key, phase, mean, cv): sample cv clipped to [0.05, 2]; empty phases take the key's mean and cv 0.5."""
    per = phased.groupBy(*keys, "phase").agg(F.count("*").alias("_n"), F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    whole = (phased.groupBy(*keys).agg(F.avg(value).alias("_all"), F.first("_w").alias("_w"))
             .select(*keys, "_all", "_w", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("phase")))
    j = whole.join(per, [*keys, "phase"], "left")
    few = F.col("_w") < min_rows
    cv = F.when((F.col("_n") >= 2) & (F.col("_m") > 0), F.least(F.greatest(F.col("_s") / F.col("_m"), F.lit(0.05)), F.lit(2.0))).otherwise(F.lit(0.5))
    return j.select(*keys, "phase", F.when(few, F.col("_all")).otherwise(F.coalesce("_m", "_all")).alias("mean"),
                    F.when(few, F.lit(0.5)).otherwise(cv).alias("cv"))


def stationary(trans: DataFrame, keys: Sequence[str], k: int = 3, squarings: int = 12) -> DataFrame:
    """Long-run share of each phase, all keys at once.

    The k x k matrix of a key is one small row; squaring it ``squarings`` times inside the row replaces 2^squarings rounds of
    join and aggregate.
    """
    mat = trans.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("from", "to", "p"))).alias("_t"))
    mat = mat.withColumn("_p", F.col("_t.p"))
    idx = F.sequence(F.lit(0), F.lit(k * k - 1))
    for _ in range(squarings):
        def cell(i):
            row, c = F.floor(i / k).cast("int"), i % k
            return F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(0.0),
                               lambda a, m: a + F.get(F.col("_p"), row * k + m) * F.get(F.col("_p"), m * k + c))
        mat = mat.withColumn("_p", F.transform(idx, cell))
    return mat.select(*keys, F.posexplode(F.slice("_p", 1, k)).alias("phase", "share"))
