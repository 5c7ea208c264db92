"""Roll-ups of run tables: summaries, pivots, rankings, threshold audits, histograms."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .relational import best_by


def summary(runs: DataFrame, keys: Sequence[str], metrics: Sequence[str], digits: int = 6) -> DataFrame:
    """Mean and sample standard deviation of each metric; a single run has deviation 0."""
    aggs = []
    for m in metrics:
        aggs += [F.round(F.avg(m), digits).alias(f"{m}_mean"), F.round(F.coalesce(F.stddev_samp(m), F.lit(0.0)), digits).alias(f"{m}_std")]
    return runs.groupBy(*keys).agg(*aggs, F.count("*").alias("n_runs"))


def pivot_means(runs: DataFrame, rows: str, columns: str, values: Sequence, metric: str, digits: int = 6) -> DataFrame:
    """Rows x columns of means; the column values are given, so no extra pass looks for them."""
    return runs.groupBy(rows).pivot(columns, list(values)).agg(F.round(F.avg(metric), digits))


def best_methods(runs: DataFrame, metric: str, excluded: DataFrame | None = None) -> DataFrame:
    """Best method of each scenario by mean, reference-only methods left out first."""
    if excluded is not None:
        runs = runs.join(excluded, "method", "left_anti")
    means = runs.groupBy("scenario", "method").agg(F.avg(metric).alias("mean"))
    return best_by(means, ["scenario"], "mean", ["method"], ["method"])


def ranked_methods(runs: DataFrame, metric: str) -> DataFrame:
    """Methods of each scenario by mean; one row per (scenario, method) enters the window."""
    means = runs.groupBy("scenario", "method").agg(F.avg(metric).alias("mean"))
    return means.withColumn("rank", F.row_number().over(W.partitionBy("scenario").orderBy("mean", "method")))


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int) -> DataFrame:
    """Density histogram between the extremes of each key; the top edge belongs to the last bin."""
    lim = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1)).cast("bigint")
    # lim holds one row per key and the planner picks the join; counting by bin combines before the shuffle
    return (df.join(lim, [*keys]).where("_hi > _lo").groupBy(*keys, b.alias("bin"), "_lo", "_hi", "_n").agg(F.count("*").alias("count"))
            .withColumn("density", F.col("count") / (F.col("_n") * (F.col("_hi") - F.col("_lo")) / bins)).drop("_lo", "_hi", "_n"))


def thresholds_at(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """(keys, p, threshold, share above) with thresholds at the 1 - p quantiles."""
    qs = df.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(1 - p) for p in probs])).alias("_q"))
    thr = qs.select(*keys, F.posexplode("_q").alias("_i", "threshold")).withColumn(
        "p", F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("_i") + 1))
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return (counts.join(thr, [*keys]).groupBy(*keys, "p", "threshold")
            .agg((F.sum(F.when(F.col(value) > F.col("threshold"), F.col("_n")).otherwise(0)) / F.sum("_n")).alias("share_above")))


def threshold_audit(df: DataFrame, score: str, unsafe: Column, thresholds: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Per threshold: accepted share, accepted but unsafe, n. All thresholds in one pass."""
    aggs = [F.count("*").alias("n")]
    for i, t in enumerate(thresholds):
        ok = F.col(score) <= t
        aggs += [F.sum(ok.cast("bigint")).alias(f"_a{i}"), F.sum((ok & unsafe).cast("bigint")).alias(f"_u{i}")]
    g = df.groupBy(*keys).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"_a{i}").alias("a"), F.col(f"_u{i}").alias("u")) for i, t in enumerate(thresholds)])
    return g.select(*keys, "n", F.explode(rows).alias("r")).select(*keys, "r.threshold", (F.col("r.a") / F.col("n")).alias("accepted"), F.col("r.u").alias("unsafe"), "n")


def log_fit(points: DataFrame, keys: Sequence[str], x: str, y: str, first: int, order: str) -> DataFrame:
    """Slope and constant of log y on log x over the first points of each key."""
    k = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    head = points.withColumn("_k", k).where(F.col("_k") <= first)
    return head.groupBy(*keys).agg(F.regr_slope(F.ln(y), F.ln(x)).alias("slope"), F.exp(F.regr_intercept(F.ln(y), F.ln(x))).alias("constant"))


def cheapest_within(df: DataFrame, keys: Sequence[str], budget: str, loss: str, tolerance: float) -> DataFrame:
    """Smallest budget whose loss is within the tolerance, else '>' and the largest budget."""
    ok = F.min(F.when(F.col(loss) <= tolerance, F.col(budget)))
    return df.groupBy(*keys).agg(F.coalesce(ok.cast("string"), F.concat(F.lit(">"), F.max(budget).cast("string"))).alias("needed"))


def relative_to(df: DataFrame, keys: Sequence[str], name: str, contains: str, value: str) -> DataFrame:
    """Value of the row whose name contains a text, divided by each row's value; one row per key is joined back."""
    base = df.groupBy(*keys).agg(F.max(F.when(F.contains(F.col(name), F.lit(contains)), F.col(value))).alias("_base"))
    return df.join(base, [*keys]).withColumn("speed_up", F.col("_base") / F.greatest(F.col(value), F.lit(1e-9))).drop("_base")
