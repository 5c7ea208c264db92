"""Equal-risk split: every cell gets ``backlog + F^-1(1 - level / weight)`` at one common level per (link, epoch).

The level is the smallest one whose budgets fit the capacity.  A cell's budget is piecewise linear in the level, so the
total is too: each cell emits the value changes at its knots and one running sum over the knots of its (link, epoch) finds
the crossing exactly.  This replaces an iterative search with a sort.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..constants import QUANTILE_LEVELS
from ..functions import quantiles as Q, scalars as S
from ..functions.scalars import col
from .allocation import GROUP, greedy_fill, water_fill


def add_budget(df: DataFrame, out: str, level, back, q, weight, delta, cap, floor) -> DataFrame:
    """Budget of each cell at a level. The probability is a column of its own: the quantile read refers to it many times."""
    df = df.withColumn("_p", F.lit(1.0) - col(level) / col(weight))
    df = df.withColumn("_pe", F.least(F.greatest(F.col("_p") + col(delta), F.lit(0.0)), F.lit(1.0)))
    target = F.when(F.col("_p") <= 0, F.lit(0.0)).otherwise(col(back) + Q.inverse_cdf(q, "_pe"))
    return df.withColumn(out, F.greatest(col(floor), F.least(target, col(cap)))).drop("_p", "_pe")


def _spans(q: Column, levels=QUANTILE_LEVELS) -> Column:
    """Linear spans of the quantile function, from the top down: probability range, value at its low end, slope."""
    at = [F.get(q, F.lit(i)) for i in range(len(levels))]
    last = len(levels) - 1
    tail = (at[last] - at[last - 1]) / F.lit(max(levels[last] - levels[last - 1], 1e-6))
    zero = F.lit(0.0)

    def span(p_lo, p_hi, value, slope):
        return F.struct(F.lit(p_lo).alias("p_lo"), F.lit(p_hi).alias("p_hi"), value.alias("value"), slope.alias("slope"))

    inner = [span(levels[i], levels[i + 1], at[i], (at[i + 1] - at[i]) / F.lit(levels[i + 1] - levels[i])) for i in range(last)]
    # the open ends are flat; wide finite bounds keep the arithmetic free of infinities
    return F.array(span(1.0, 9.0, at[last] + tail * F.lit(1.0 - levels[last]), zero),
                   span(levels[last], 1.0, at[last], tail), *inner, span(-9.0, levels[0], at[0], zero))


def with_level(df: DataFrame, back, weight, delta, floor, group: Sequence[str] = GROUP, q="q", out: str = "level",
               levels: Sequence[float] = QUANTILE_LEVELS) -> DataFrame:
    """Add the smallest level whose total budget is within the capacity.

    Each cell becomes the value changes of its piecewise-linear budget, the first of which carries the cell's row; a running
    sum over (group, level) finds the crossing and the carried rows come back with it: one shuffle, no join.
    """
    w, final = F.col("_w"), len(levels) + 1
    keep = [c for c in df.columns if c not in group]
    rows = df.select(*group, F.col("capacity").alias("_c"), F.col("cap").alias("_cap"), col(back).alias("_b"), col(weight).alias("_w"),
                     col(delta).cast("double").alias("_d"), col(floor).cast("double").alias("_f"),
                     F.struct(*keep).alias("_row"), F.posexplode(_spans(col(q), levels)).alias("_i", "_s"))
    zero = F.lit(0.0)
    # budget = icpt + slope * level on [lo, hi)
    rows = rows.select(
        *group, "_c", "_cap", "_f", "_i", F.when(F.col("_i") == 0, F.col("_row")).alias("_row"),
        F.least(F.greatest(w * (F.lit(1.0) - F.col("_s.p_hi") + F.col("_d")), zero), w).alias("_lo"),
        F.least(F.greatest(w * (F.lit(1.0) - F.col("_s.p_lo") + F.col("_d")), zero), w).alias("_hi"),
        (F.col("_b") + F.col("_s.value") + F.col("_s.slope") * (F.lit(1.0) - F.col("_s.p_lo") + F.col("_d"))).alias("_icpt"),
        (-F.col("_s.slope") / w).alias("_m"))
    rows = rows.where(f"_lo < _hi or _i in (0, {final})")
    flat = F.col("_m") == 0
    rows = rows.withColumns({
        "_tocap": F.when(flat, F.when(F.col("_icpt") > F.col("_cap"), F.col("_hi")).otherwise(F.col("_lo")))
        .otherwise((F.col("_icpt") - F.col("_cap")) / -F.col("_m")),
        "_tofloor": F.when(flat, F.when(F.col("_icpt") < F.col("_f"), F.col("_lo")).otherwise(F.col("_hi")))
        .otherwise((F.col("_icpt") - F.col("_f")) / -F.col("_m"))})
    rows = rows.withColumn("_x", F.least(F.greatest("_tocap", "_lo"), F.col("_hi")))
    rows = rows.withColumn("_y", F.least(F.greatest("_tofloor", "_x"), F.col("_hi")))

    lo, hi, x, y, cap, f, icpt, m = (F.col(c) for c in ("_lo", "_hi", "_x", "_y", "_cap", "_f", "_icpt", "_m"))

    def piece(value, slope):
        return F.struct(value.alias("a"), slope.alias("m"))

    # cap on [lo, x), the line on [x, y), the floor on [y, hi); the last span keeps the floor for good
    nothing = piece(zero, zero)
    first = F.when(lo >= hi, nothing).when(x > lo, piece(cap, zero)).when(y > lo, piece(icpt, m)).otherwise(piece(f, zero))
    last = F.when(lo >= hi, nothing).when(y < hi, piece(f, zero)).when(x < hi, piece(icpt, m)).otherwise(piece(cap, zero))
    keep_floor = F.when(F.col("_i") == final, f).otherwise(zero)
    rows = rows.withColumns({"_first": first, "_last": last})

    def change(at, da, dm):
        return F.struct(at.alias("at"), da.alias("a"), dm.alias("m"))

    none = F.lit(None).cast("double")
    inside_x, inside_y = (x > lo) & (x < hi), (y > x) & (y < hi)
    changes = F.array(change(lo, F.col("_first.a"), F.col("_first.m")),
                      change(F.when(inside_x, x).otherwise(none), F.when(y > x, icpt).otherwise(f) - cap, F.when(y > x, m).otherwise(zero)),
                      change(F.when(inside_y, y).otherwise(none), f - icpt, -m),
                      change(hi, keep_floor - F.col("_last.a"), -F.col("_last.m")))
    ev = rows.select(*group, "_c", "_row", F.posexplode(changes).alias("_k", "_e"))
    ev = ev.where("_e.at is not null and (_k = 0 or _e.a != 0 or _e.m != 0)").select(*group, "_c", F.when(F.col("_k") == 0, F.col("_row")).alias("_row"), "_e.at", "_e.a", "_e.m")
    o = W.partitionBy(*group).orderBy("at")
    ev = ev.withColumns({"_a": F.sum("a").over(o), "_sm": F.sum("m").over(o), "_next": F.lead("at").over(o)})
    here, there = F.col("_a") + F.col("_sm") * F.col("at"), F.col("_a") + F.col("_sm") * F.col("_next")
    tol = F.col("_c") * F.lit(1e-13)       # running sums carry rounding noise of this order
    hit = (F.when(here <= F.col("_c") + tol, F.col("at"))
           .when(there <= F.col("_c"), F.least(F.col("at") + (here - F.col("_c")) / -F.col("_sm"), F.col("_next"))))
    ev = ev.withColumn("_hit", hit).withColumn(out, F.min("_hit").over(W.partitionBy(*group)))
    # the group columns stay the ones the rows are partitioned by, so later windows need no shuffle
    return ev.where("_row is not null").select(*group, "_row.*", out)


def equal_risk(df: DataFrame, back="backlog", weight="weight", delta=0.0, group: Sequence[str] = GROUP, q: str = "q") -> DataFrame:
    """Budgets and the common level; level 0 when everything fits (headroom is then spread)."""
    df = df.withColumns({"_back": col(back), "_w": col(weight), "_delta": col(delta).cast("double")})
    at = ("_back", q, "_w", "_delta", "cap", F.lit(0.0))
    df = add_budget(df, "_top", F.lit(0.0), *at)
    df = water_fill(df, "_top", F.lit(1.0), group, out="_fit")       # partitions the cells by group before they fan out
    df = with_level(df, "_back", "_w", "_delta", F.lit(0.0), group, q)
    df = add_budget(df, "_r", "level", *at)
    # at a level that equals its weight a cell falls from this value to zero
    df = df.withColumn("_pj", F.least(F.greatest(F.col("_delta"), F.lit(0.0)), F.lit(1.0)))
    left_limit = F.least(F.col("_back") + Q.inverse_cdf(q, "_pj"), F.col("cap"))
    df = df.withColumn("_jump", F.when(F.col("level") == F.col("_w"), left_limit).otherwise(F.lit(0.0))).drop("_pj")
    g = W.partitionBy(*group)
    df = df.withColumns({"_sum0": F.sum("_top").over(g), "_sum": F.sum("_r").over(g), "_jumps": F.sum("_jump").over(g)})
    slack = F.col("capacity") - F.col("_sum")
    bound = F.col("_r") + F.when((slack > 0) & (F.col("_jumps") > 0),
                                 F.col("_jump") * F.least(F.lit(1.0), slack / F.col("_jumps"))).otherwise(F.lit(0.0))
    fits = F.col("_sum0") <= F.col("capacity")
    return df.withColumns({"budget": F.when(fits, F.col("_fit")).otherwise(bound),
                           "level": F.when(fits, F.lit(0.0)).otherwise(F.col("level"))}).drop(
        "_back", "_w", "_delta", "_top", "_r", "_jump", "_fit", "_sum0", "_sum", "_jumps")


def class_weighted(df: DataFrame, horizon: int, ll_weight=1.0, group: Sequence[str] = GROUP, q: str = "q") -> DataFrame:
    """Equal risk where low-latency cells weigh ``ll_weight`` (a number or a column) instead of their priority."""
    ll = F.when(S.is_low_latency("deadline"), col(ll_weight)).otherwise(F.lit(1.0))
    return equal_risk(df, weight=ll * S.deadline_weight(F.lit(1.0), "deadline", horizon), group=group, q=q)


def two_stage(df: DataFrame, interval: int, horizon: int, p0_ll=0.5, p0_embb=0.5, v_ll=3.0, lookahead=1.0, omega_ll=3.0, a=1.0,
              eta=6.0, mu=0.0, greedy_at: float = 6.0, group: Sequence[str] = GROUP) -> DataFrame:
    """Base demands in back-pressure order, then margins at equal risk that never go below the base.

    With ``eta`` below ``greedy_at`` and a shortage of base demands, the shortage is shared by a water-fill whose weights
    are class weight times relative pressure to the power ``eta``.
    """
    ll = F.col("deadline") <= 10
    med = F.get("q", F.lit(Q.nearest_level(0.5)))
    df = df.withColumns({
        "_back": col(a) * F.col("queue_fh") / interval + (F.lit(1.0) - col(a)) * F.col("backlog"),
        "_v": F.when(ll, col(v_ll)).otherwise(F.lit(1.0)), "_omega": F.when(ll, col(omega_ll)).otherwise(F.lit(1.0)),
        "_pressure": F.col("queue_fh") + col(lookahead) * horizon * med})
    base = F.col("_back") + (F.lit(1.0) + col(mu)) * Q.inverse_cdf("q", F.when(ll, col(p0_ll)).otherwise(col(p0_embb)))
    df = df.withColumn("_base", F.least(base, F.col("cap")))
    g = W.partitionBy(*group)
    df = df.withColumns({"_basesum": F.sum("_base").over(g), "_meanp": F.avg("_pressure").over(g)})
    rel = F.col("_pressure") / F.greatest(F.col("_meanp"), F.lit(1e-9))
    df = water_fill(df, "_base", F.col("_v") * F.pow(F.greatest(rel, F.lit(1e-9)), col(eta)), group, out="_shared", leftover=False)
    df = greedy_fill(df, "_base", F.col("_v") * F.col("_pressure"), group, out="_given")
    df = df.withColumn("_left", F.col("capacity") - F.sum("_given").over(g))
    df = with_level(df, "_back", "_omega", F.lit(0.0), "_given", group)
    df = add_budget(df, "_risk", "level", "_back", "q", "_omega", F.lit(0.0), "cap", "_given")
    df = water_fill(df, "_risk", F.lit(1.0), group, out="_margin")
    shared = (F.col("_basesum") > F.col("capacity")) & (col(eta) < greedy_at)
    budget = F.when(shared, F.col("_shared")).when(F.col("_left") <= 1e-9, F.col("_given")).otherwise(F.col("_margin"))
    return df.withColumn("budget", budget).drop("_back", "_v", "_omega", "_pressure", "_base", "_basesum", "_meanp", "_shared",
                                                "_given", "_left", "level", "_risk", "_margin")
