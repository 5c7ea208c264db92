"""Paired comparison of methods on identical traces: differences, bootstrap intervals, signed-rank test, step-down correction."""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .ranks import ranked
from .relational import paired

EXACT_LIMIT = 25
PAIR = ("scenario", "baseline")


def differences(pairs: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    """n, means, difference statistics, relative reduction and wins of the reference."""
    o = F.avg("o")
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("n"), o.alias("baseline_mean"), F.avg("r").alias("reference_mean"), F.avg("diff").alias("diff_mean"),
        F.coalesce(F.stddev_samp("diff"), F.lit(0.0)).alias("diff_std"), F.min("diff").alias("diff_min"), F.max("diff").alias("diff_max"),
        F.when(o > 0, 100 * F.avg("diff") / o).alias("rel_reduction_pct"), F.sum((F.col("diff") > 0).cast("bigint")).alias("wins"))


def draw(rep, i, n):
    """Resample index in [0, n), the same for arrays and columns: integer arithmetic that any engine repeats exactly (products below 2^63)."""
    m = 2147483647
    a = (rep % m * 1103515245 + 12345) % m
    b = (i % m * 69621 + 7919) % m
    column = isinstance(a, Column)
    shift = F.shiftright if column else np.right_shift
    x = (shift(a * a, 15).bitwiseXOR(shift(b * b, 13)) if column else shift(a * a, 15) ^ shift(b * b, 13)) % m
    y = ((x + a) % m * 48271 + b) % m
    return shift(y * y, 16) % m * 16807 % m % n


def block_counts(sizes: DataFrame, replicates: int, block: int) -> DataFrame:
    """(n, block, m): how many of the n draws of each replicate (in order) fall into a block of positions. The counts are multinomial and depend on n and the
    replicate alone; a sample size needs replicates x blocks of them."""

    def split(n: pd.Series, rep: pd.Series) -> pd.Series:
        out = []
        for size, seed in zip(n, rep, strict=True):
            ends = np.minimum(np.arange(1, -(-size // block) + 1) * block, size)
            out.append(np.random.default_rng([size, seed]).multinomial(size, np.diff(ends, prepend=0) / size))
        return pd.Series(out)

    small = sizes.where(F.col("n") <= block).select("n", F.lit(0).alias("block"), F.array_repeat("n", replicates).alias("m"))
    reps = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(replicates - 1).cast("bigint")))
    large = sizes.where(F.col("n") > block).select("n", reps.alias("rep")).select("n", "rep", F.posexplode(F.pandas_udf(split, "array<bigint>")("n", "rep")).alias("block", "m"))
    packed = large.groupBy("n", "block").agg(F.sort_array(F.collect_list(F.struct("rep", "m")))["m"].alias("m"))
    return small.unionByName(packed)


def _replicate_sums(block: pd.Series, m: pd.Series, *columns: pd.Series) -> pd.Series:
    """Sums of the drawn values of a block, by column and replicate. Draws are made for as many replicates at once as fill about two million."""
    out = []
    for b, counts, *values in zip(block, m, *columns, strict=True):
        values, size = np.stack([np.asarray(v, float) for v in values], axis=1), len(values[0])
        sums, most = np.zeros((len(counts), values.shape[1])), max(1, 2_000_000 // size)
        for start in range(0, len(counts), most):
            n = counts[start:start + most]
            rep = np.repeat(np.arange(len(n)), n)
            i = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
            at = draw(rep + start + int(b) * len(counts), i, size)
            sums[start:start + most] = np.bincount(rep * size + at, minlength=len(n) * size).reshape(len(n), size) @ values
        out.append(list(sums.T))
    return pd.Series(out)


def bootstrap(values: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], statistic, replicates: int,
              probs=(0.025, 0.975), block: int = 4096) -> DataFrame:
    """Percentile interval of ``statistic(means)`` with the same draws for every column.

    A replicate first splits its draws over blocks of positions, then draws inside each block, where the block's values are one array. What is built and
    shuffled is an array of replicates per block; no table has a row or an element per draw.
    """
    v = ranked(values.select(*keys, order, *columns), keys, order)
    packs = v.groupBy(*keys, "n", F.floor(F.col("pos") / block).cast("int").alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", *columns))).alias("_v")).checkpoint()
    j = packs.join(block_counts(packs.select("n").distinct(), replicates, block), ["n", "block"])
    sums = F.pandas_udf(_replicate_sums, "array<array<double>>")("block", "m", *[F.col("_v")[c].cast("array<double>") for c in columns])
    each = F.arrays_zip(*[F.get("_s", F.lit(i)).alias(c) for i, c in enumerate(columns)])
    reps = j.select(*keys, "n", sums.alias("_s")).select(*keys, "n", F.posexplode(each).alias("rep", "_e"))
    means = reps.groupBy(*keys, "rep", "n").agg(*[(F.sum(F.col("_e")[c]) / F.col("n")).alias(c) for c in columns])
    return means.groupBy(*keys).agg(F.percentile(statistic(*[F.col(c) for c in columns]), F.array(*[F.lit(p) for p in probs])).alias("_q"), F.max("n").alias("_n")).select(
        *keys, *[F.when(F.col("_n") > 1, F.get("_q", F.lit(i))).alias(c) for i, c in enumerate(("ci_lo", "ci_hi"))])   # one value has no interval


def bootstrap_reduction(pairs: DataFrame, replicates: int = 10000, keys: Sequence[str] = PAIR) -> DataFrame:
    return bootstrap(pairs, keys, "seed", ["o", "r"], lambda o, r: 100 * (o - r) / F.greatest(o, F.lit(1e-12)), replicates)


def erf(x: Column, terms: int = 120) -> Column:
    """Error function by its all-positive series (exact to rounding for |x| <= 6)."""
    s = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.struct(x.alias("t"), x.alias("s")),
                    lambda a, k: F.struct((a["t"] * 2 * x * x / (2 * k + 1)).alias("t"), (a["s"] + a["t"] * 2 * x * x / (2 * k + 1)).alias("s")))["s"]
    return F.when(x > 6, F.lit(1.0)).otherwise(F.lit(2.0 / math.sqrt(math.pi)) * F.exp(-x * x) * s)


def erfc(x: Column, depth: int = 100) -> Column:
    """Complementary error function for x >= 0: 1 - erf below 2, beyond it the continued fraction, evaluated from its end, so that tails keep their digits."""
    tail = F.aggregate(F.sequence(F.lit(depth), F.lit(1), F.lit(-1)), x, lambda a, k: x + k / (2 * a))
    return F.when(x < 2, F.lit(1.0) - erf(x)).otherwise(F.exp(-x * x) / (F.lit(math.sqrt(math.pi)) * tail))


def null_counts(spark, limit: int = EXACT_LIMIT) -> DataFrame:
    """(n, cum): cumulative number of sign patterns with rank sum 0, 1, .. for every n up to the limit (a rule, not data)."""
    rows, counts = [], [1]
    for n in range(1, limit + 1):
        nxt = [0] * (len(counts) + n)
        for s, c in enumerate(counts):
            nxt[s] += c
            nxt[s + n] += c
        counts, cum, total = nxt, [], 0
        for c in counts:
            total += c
            cum.append(total)
        rows.append((n, cum))
    return spark.createDataFrame(rows, "n bigint, cum array<bigint>")


def signed_rank(pairs: DataFrame, keys: Sequence[str] = PAIR, min_n: int = 6) -> DataFrame:
    """Two-sided signed-rank p: zeros dropped, average ranks; exact without ties up to 25 pairs, else normal with tie correction.

    NULL when fewer than ``min_n`` pairs or when all differences are zero.
    """
    d = pairs.withColumn("_a", F.abs("diff"))
    nz = d.where("diff != 0").groupBy(*keys, "_a").agg(F.count("*").alias("_t"), F.sum((F.col("diff") > 0).cast("bigint")).alias("_p"))
    w = W.partitionBy(*keys).orderBy("_a")
    through = F.sum("_t").over(w.rowsBetween(W.unboundedPreceding, 0))
    nz = nz.withColumn("_rank", through - (F.col("_t") - 1) / 2.0)
    t = F.col("_t").cast("double")
    st = nz.groupBy(*keys).agg(F.sum("_t").alias("n"), F.sum(F.col("_rank") * F.col("_p")).alias("plus"), F.sum(F.col("_rank") * F.col("_t")).alias("all"),
                               F.sum(t * (t * t - 1)).alias("ties"))
    total = pairs.groupBy(*keys).agg(F.count("*").alias("_pairs"))
    j = total.join(st, [*keys], "left").join(F.broadcast(null_counts(pairs.sparkSession)), "n", "left")       # 25 rows
    stat = F.least("plus", F.col("all") - F.col("plus"))
    exact = F.least(F.lit(1.0), 2.0 * F.get("cum", F.floor(stat).cast("int")) / F.pow(F.lit(2.0), F.col("n")))
    n = F.col("n").cast("double")
    se = F.sqrt((n * (n + 1) * (2 * n + 1) - 0.5 * F.col("ties")) / 24)
    j = j.withColumn("_z", F.abs((stat - n * (n + 1) / 4) / se) / F.lit(math.sqrt(2.0)))
    p = F.when((F.col("n") <= EXACT_LIMIT) & (F.col("ties") == 0), exact).otherwise(erfc(F.col("_z")))
    return j.select(*keys, F.when((F.col("_pairs") >= min_n) & (F.coalesce(F.col("n"), F.lit(0)) > 0), p).alias("p"))


def holm(tests: DataFrame, family: Sequence[str] = ("scenario",), p: str = "p", tie: str = "baseline") -> DataFrame:
    """Step-down correction inside each family: running maximum of min(1, (k - rank) p); NULLs stay NULL and do not count."""
    known = tests.where(F.col(p).isNotNull())
    w = W.partitionBy(*family).orderBy(p, tie)
    k = F.count("*").over(W.partitionBy(*family))
    adj = F.least(F.lit(1.0), (k - F.row_number().over(w) + 1) * F.col(p))
    known = known.withColumn("_adj", adj).withColumn("p_holm", F.max("_adj").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_adj")
    return known.unionByName(tests.where(F.col(p).isNull()).withColumn("p_holm", F.lit(None).cast("double")))


def paired_report(runs: DataFrame, reference: str, metric: str, replicates: int = 10000) -> DataFrame:
    """One row per (scenario, baseline) with differences, interval, test and corrected p."""
    pairs = paired(runs, reference, metric)
    tests = holm(signed_rank(pairs))
    return differences(pairs).join(bootstrap_reduction(pairs, replicates), [*PAIR]).join(tests, [*PAIR], "left")


def whiskers(pairs: DataFrame, keys: Sequence[str] = PAIR) -> DataFrame:
    rel = F.when(F.col("o") > 0, 100 * F.col("diff") / F.col("o"))
    return pairs.groupBy(*keys).agg(F.min(rel).alias("lo"), F.avg(rel).alias("mean"), F.max(rel).alias("hi"),
                                    F.concat(F.sum((F.col("diff") > 0).cast("int")).cast("string"), F.lit("/"), F.count("*").cast("string")).alias("wins"))
