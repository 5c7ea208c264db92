"""Online calibration of a quantile level per key.

After a horizon is fully observed the key's offset moves: ``d <- clip(d + gamma (miss - (1 - level)), lo, hi)``.  A clipped step
is a clamp of a shift, and such maps compose into one clamp of a shift, so a long key is scanned in levels: chunks of ``FAN`` epochs are composed in parallel,
then groups of ``FAN`` chunks, and so on; offsets run down the same levels, each group from the offset it starts with. No array and no frame has more than
``FAN`` parts, except the few groups of the top level.

Sums in levels have other last bits than the plain fold. So each chunk is walked from where the one before it really ends, and those whose start
was off by a bit are walked again until none is: the offsets are those of the plain fold, bit by bit.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import shared_dir

FAN = 64


def maturity(interval: int, delay: int) -> int:
    """Number of epochs after which an epoch's horizon is fully observed."""
    return 1 + math.ceil(delay / interval)


def _applied(x: Column, s: Column) -> Column:
    """The offset behind a summary (shift ``a``, then clamp to ``b`` .. ``c``)."""
    return F.least(F.greatest(x + s["a"], s["b"]), s["c"])


def _running(parts: Column, start: Column, through) -> Column:
    """Offsets before each part, in order, from the offset at the start."""
    state = lambda x, out: F.struct(x.cast("double").alias("x"), out.alias("out"))
    return F.aggregate(parts, state(start, F.array().cast("array<double>")), lambda acc, p: state(through(acc["x"], p), F.concat(acc["out"], F.array(acc["x"]))))["out"]


def _starts(chunks: DataFrame, keys: list[str], compose, unit: Column, levels: int) -> DataFrame:
    """(keys, _c, _s) -> (keys, _c, _start): the offset before each chunk, chunks of a key in order of ``_c``."""
    up = F.floor(F.col("_c") / FAN).cast("bigint") if levels else F.lit(0).cast("bigint")
    packs = chunks.groupBy(*keys, up.alias("_g")).agg(F.sort_array(F.collect_list(F.struct("_c", "_s"))).alias("_r"))
    if levels:
        above = packs.select(*keys, F.col("_g").alias("_c"), F.aggregate("_r", unit, lambda acc, r: compose(acc, r["_s"])).alias("_s"))
        packs = packs.join(_starts(above, keys, compose, unit, levels - 1).withColumnRenamed("_c", "_g"), [*keys, "_g"])
    else:
        packs = packs.withColumn("_start", F.lit(0.0))
    each = F.arrays_zip(F.col("_r._c").alias("c"), _running(F.col("_r._s"), F.col("_start"), _applied).alias("d"))
    return packs.select(*keys, F.explode(each).alias("_o")).select(*keys, F.col("_o.c").alias("_c"), F.col("_o.d").alias("_start"))


def _settled(packs: DataFrame, starts: DataFrame, keys: list[str], through) -> DataFrame:
    """(keys, _c, _start) with every chunk's start at the end of the chunk before. The starts given differ in last bits at most, which a clamp wipes out: a round
    walks the chunks whose predecessor ended elsewhere, the first of each key is right from the beginning."""
    def ends(chunks):
        walked = packs.select(*keys, "_c", "_r").join(chunks, [*keys, "_c"])
        return walked.select(*keys, "_c", "_start", F.aggregate("_r", F.col("_start"), through).alias("_end"))

    done = ends(starts).checkpoint()
    while True:
        want = F.coalesce(F.lag("_end").over(W.partitionBy(*keys).orderBy("_c")), F.lit(0.0))
        seen = done.withColumn("_want", want)
        off = seen.where("_want != _start").select(*keys, "_c", F.col("_want").alias("_start"))
        if off.isEmpty():
            return done.select(*keys, "_c", "_start")
        done = seen.where("_want = _start").select(*keys, "_c", "_start", "_end").unionByName(ends(off)).checkpoint()


def offsets(epochs: DataFrame, keys: Sequence[str], order: str, miss: str, lag: int, gamma: float = 0.02, level: float = 0.9,
            lo: float = -0.3, hi: float = 0.3, chunk: int = FAN, levels: int = 2) -> DataFrame:
    """Offset in force at each epoch. ``order`` counts the epochs per key; ``miss`` is 1 when y exceeded the target (null: no step). ``levels`` of
    groups lie above the chunks, so the top level holds one summary for each ``chunk * FAN ** levels`` epochs of a key."""
    keys = list(keys)

    # an epoch sees outcomes up to ``lag`` epochs back: its step is placed at the epoch where it becomes visible, before that
    # epoch's own entry (side 1, no step)
    step = F.lit(gamma) * (F.col(miss).cast("double") - F.lit(1.0 - level))
    entries = F.array(F.struct(F.col(order).alias("k"), F.lit(1).alias("side"), F.lit(None).cast("double").alias("g")),
                      F.struct((F.col(order) + lag).alias("k"), F.lit(0).alias("side"), step.alias("g")))
    rows = epochs.select(*keys, F.explode(entries).alias("e")).withColumn("_c", F.floor(F.col("e.k") / chunk).cast("bigint"))
    packs = rows.groupBy(*keys, "_c").agg(F.sort_array(F.collect_list("e")).alias("_r"))

    def summary(a, b, c):
        return F.struct(a.alias("a"), b.alias("b"), c.alias("c"))

    def compose(acc, s):
        return summary(acc["a"] + s["a"], _applied(acc["b"], s), _applied(acc["c"], s))

    def single(g):
        return summary(g, F.lit(lo), F.lit(hi))

    unit = summary(F.lit(0.0), F.lit(lo), F.lit(hi))
    # read by the levels above and by the walk below: stored, so that nothing before it runs again
    shared_dir(epochs.sparkSession)
    packs = packs.withColumn("_s", F.aggregate("_r", unit, lambda acc, r: F.when(r["g"].isNull(), acc).otherwise(compose(acc, single(r["g"]))))).checkpoint()

    def through(x, r):
        return F.when(r["g"].isNull(), x).otherwise(_applied(x, single(r["g"])))

    packs = packs.join(_settled(packs, _starts(packs.select(*keys, "_c", "_s"), keys, compose, unit, levels), keys, through), [*keys, "_c"])
    # the offset before an epoch's own entry, which makes no step, is the one in force
    walked = _running(F.col("_r"), F.col("_start"), through)
    out = packs.select(*keys, F.explode(F.arrays_zip(F.col("_r").alias("r"), walked.alias("d"))).alias("_o")).where("_o.r.side = 1")
    return out.select(*keys, F.col("_o.r.k").alias(order), F.col("_o.d").alias("delta"))
