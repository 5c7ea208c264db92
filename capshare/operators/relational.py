"""Joins, set operations and ranked picks of run tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import constants as K

def delayed_state(slots: DataFrame, states: DataFrame, keys: Sequence[str], interval: int, delay: int,
                  values: Sequence[str] = ("queue", "hol")) -> DataFrame:
    """Point-in-time view at epochs: state after slot ``o - 1`` and efficiency at ``o = max(0, t - delay)``."""
    t = F.col("slot")
    epochs = slots.where(t % interval == 0).select(*keys, t.alias("epoch"), F.greatest(t - delay, F.lit(0)).alias("obs_slot"))
    se = slots.select(*keys, t.alias("obs_slot"), "se")
    state = states.select(*keys, (t + 1).alias("obs_slot"), *values)
    out = epochs.join(se, [*keys, "obs_slot"]).join(state, [*keys, "obs_slot"], "left")
    return out.select(*keys, "epoch", "obs_slot", "se", *[F.coalesce(F.col(v), F.lit(0)).alias(v) for v in values])


def last_before(decisions: DataFrame, events: DataFrame, keys: Sequence[str], time: str, value: str, bucket: int) -> DataFrame:
    """As-of join of irregular events: the last value strictly before each decision time.

    Both sides are united and cut into time buckets, so a hot key is spread; a bucket without an earlier event of its own
    takes the last value carried over from the earlier buckets.
    """
    b = F.floor(F.col(time) / bucket).cast("bigint")
    ev = events.select(*keys, time, F.struct(F.col(time).alias("t"), F.col(value).alias("v")).alias("_e"), F.lit(1).alias("_side"), b.alias("_b"))
    de = decisions.select(*keys, time, F.lit(None).cast(ev.schema["_e"].dataType).alias("_e"), F.lit(0).alias("_side"), b.alias("_b"))
    both = ev.unionByName(de)
    # decisions sort before events of the same instant, so an event at the decision time is not seen
    w = W.partitionBy(*keys, "_b").orderBy(time, "_side").rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = both.withColumn("_l", F.last("_e", ignorenulls=True).over(w)).where("_side = 0")
    last = ev.groupBy(*keys, "_b").agg(F.max("_e").alias("_m"))
    touched = decisions.select(*keys, b.alias("_b")).distinct()
    carry_w = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carry = (last.join(touched, [*keys, "_b"], "full")
             .withColumn("_carry", F.last("_m", ignorenulls=True).over(carry_w)).select(*keys, "_b", "_carry"))
    return (inside.join(carry, [*keys, "_b"], "left")
            .select(*keys, time, F.coalesce(F.col("_l.v"), F.col("_carry.v")).alias(value)))


def spread_budgets(slots: DataFrame, budgets: DataFrame, keys: Sequence[str], interval: int) -> DataFrame:
    """Budgets of an epoch hold for its ``interval`` slots: an equi join on ``slot div interval``."""
    s = slots.withColumn("epoch", (F.floor(F.col("slot") / interval) * interval).cast("bigint"))
    return s.join(budgets, [*keys, "epoch"])


def paired(runs: DataFrame, reference: str, metric: str, keys: Sequence[str] = ("scenario", "seed")) -> DataFrame:
    """Baseline and reference value of the same (scenario, seed); rows without both are dropped."""
    ref = runs.where(F.col("method") == reference).select(*keys, F.col(metric).alias("r"))
    base = runs.where(F.col("method") != reference).select(*keys, F.col("method").alias("baseline"), F.col(metric).alias("o"))
    return base.join(ref, [*keys]).where("o is not null and r is not null").withColumn("diff", F.col("o") - F.col("r"))


def band_lookup(value: Column, levels: Sequence[float] = K.CQI_EFFICIENCY) -> Column:
    """Largest tabulated level not above the value; 0 below the first."""
    table = F.array(*[F.lit(float(x)) for x in levels])
    return F.coalesce(F.array_max(F.filter(table, lambda x: x <= value)), F.lit(0.0))


def method_gap(means: DataFrame, first: str, second: str, value: str, keys: Sequence[str] = ("scenario",)) -> DataFrame:
    """100 * (a - b) / a for two named methods per key."""
    a = F.max(F.when(F.col("method") == first, F.col(value)))
    b = F.max(F.when(F.col("method") == second, F.col(value)))
    return means.groupBy(*keys).agg(F.when(a > 0, F.lit(100.0) * (a - b) / a).alias("gap_pct"))


def present_everywhere(rows: DataFrame, required: DataFrame, item: str, key: str) -> DataFrame:
    """Relational division: items that occur with every required key."""
    need = required.select(key).distinct()
    have = rows.select(item, key).distinct().join(need, key, "left_semi")
    counts = have.groupBy(item).agg(F.count("*").alias("_n"))
    return counts.join(F.broadcast(need.agg(F.count("*").alias("_need"))), F.col("_n") == F.col("_need")).select(item)   # one row


def ordered_by(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Rank of a value in a custom order (unknown values last); sort by it."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))
    return df.withColumn("rank", F.when(rank == 0, F.lit(len(order) + 1)).otherwise(rank).cast("bigint"))


def best_by(df: DataFrame, keys: Sequence[str], value: str, pick: Sequence[str], tie: Sequence[str]) -> DataFrame:
    """Row with the smallest value per key, as an aggregate (no sort, combines before the shuffle)."""
    best = F.min(F.struct(F.col(value).alias("_v"), *[F.col(t).alias(f"_t{i}") for i, t in enumerate(tie)], *[F.col(p) for p in pick]))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b._v").alias(value), *[F.col(f"_b.{p}").alias(p) for p in pick])


def smallest_k(df: DataFrame, keys: Sequence[str], value: str, k: int, tie: Sequence[str]) -> DataFrame:
    """k smallest rows per key; Spark turns the rank filter into a per-task group limit before the shuffle."""
    w = W.partitionBy(*keys).orderBy(value, *tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
