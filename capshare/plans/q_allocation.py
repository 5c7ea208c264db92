"""Allocation queries. The DuckDB texts solve the same problems by list bisection instead of running sums."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import quantiles as Q, scalars as S
from ..operators import allocation as A, equal_risk as R

from . import views as V
from .registry import query

T, TAU, H = V.FAST.interval, V.FAST.delay, V.FAST.horizon
ID = ["link_id", "epoch", "cell_id"]

# ordinary inverse CDF in SQL: q is a list of six knots
_KNOTS = [0.05, 0.25, 0.5, 0.75, 0.9, 0.95]


def sql_interp(q: str, p: str, extrapolate: bool) -> str:
    parts = [f"WHEN {p} <= 0.05 THEN {q}[1]"]
    for i in range(5):
        lo, hi = _KNOTS[i], _KNOTS[i + 1]
        parts.append(f"WHEN {p} <= {hi} THEN {q}[{i + 1}] + ({q}[{i + 2}] - {q}[{i + 1}]) / {hi - lo!r}::DOUBLE * ({p} - {lo}::DOUBLE)")
    end = f"{q}[6] + ({q}[6] - {q}[5]) / {0.95 - 0.9!r}::DOUBLE * ({p} - 0.95::DOUBLE)" if extrapolate else f"{q}[6]"
    return f"greatest(CASE {' '.join(parts)} ELSE {end} END, 0.0)"


def wf_sql(src: str, demand: str, weight: str, leftover: bool = True, name: str = "wf", group: str = "link_id, epoch") -> str:
    """CTE ``name``: water-fill of ``src`` by bisection on the level, per group, over lists."""
    extra = ("+ CASE WHEN g.capacity - g.need > 1e-9 AND g.room > 1e-9 THEN least(x.cap - x.want, (g.capacity - g.need) * (x.cap - x.want) / g.room) ELSE 0.0 END"
             if leftover else "")
    return f""", {name}_x AS (SELECT *, least(greatest(({demand})::DOUBLE, 0.0), cap) AS want,
      greatest(({weight})::DOUBLE, 1e-9) * least(greatest(({demand})::DOUBLE, 0.0), cap) AS wd FROM {src}),
    {name}_g AS (SELECT {group}, any_value(capacity) AS capacity, sum(want) AS need, sum(cap - want) AS room,
      list({{'c': cap, 'w': wd}}) AS cells, max(CASE WHEN wd > 0 THEN cap / wd END) AS top FROM {name}_x GROUP BY {group}),
    {name}_l AS (SELECT *, CASE WHEN need > capacity THEN list_reduce(range(200), lambda s, i:
      CASE WHEN list_sum(list_transform(cells, lambda y: least(y.c, (s.lo + s.hi) / 2 * y.w))) > capacity
        THEN {{'lo': s.lo, 'hi': (s.lo + s.hi) / 2}} ELSE {{'lo': (s.lo + s.hi) / 2, 'hi': s.hi}} END,
      {{'lo': 0.0::DOUBLE, 'hi': top}}).lo END AS lev FROM {name}_g),
    {name} AS (SELECT x.*, CASE WHEN g.need <= g.capacity THEN x.want {extra} ELSE least(x.cap, g.lev * x.wd) END AS budget
      FROM {name}_x x JOIN {name}_l g USING ({group}))"""


def out_sql(name: str = "wf") -> str:
    return f"SELECT link_id, epoch, cell_id, round(budget + 1e-9, 5) AS budget FROM {name}"


def dec(spark, sf):
    return V.decisions(spark, sf)


def out(df):
    return A.project_budgets(df).select(*ID, F.round(F.col("budget") + 1e-9, 5).alias("budget"))


@query("al_1_water_fill", wf_sql("dec", "backlog + label", "priority") + out_sql(), "dec")
def al1(spark, sf):
    return out(A.water_fill(dec(spark, sf), F.col("backlog") + F.col("label"), "priority"))


@query("al_1_water_fill_no_leftover", wf_sql("dec", "backlog + label", "priority", False) + out_sql(), "dec")
def al1b(spark, sf):
    return out(A.water_fill(dec(spark, sf), F.col("backlog") + F.col("label"), "priority", leftover=False))


@query("al_2_static_equal", ", d2 AS (SELECT *, capacity / count(*) OVER (PARTITION BY link_id, epoch) AS share FROM dec)"
       + wf_sql("d2", "share", "1.0") + out_sql(), "dec")
def al2(spark, sf):
    return out(A.static_equal(dec(spark, sf)))


@query("al_3_reactive_proportional", wf_sql("dec", "queue_fh / 4 + 1.25 * ewma", "1.0") + out_sql(), "dec")
def al3(spark, sf):
    return out(A.reactive_proportional(dec(spark, sf), T, 0.25))


@query("al_4_deadline_aware", wf_sql("dec", "backlog + persist", "weight") + out_sql(), "dec")
def al4(spark, sf):
    return out(A.deadline_aware(dec(spark, sf)))


@query("al_5_point_forecast", wf_sql("dec", "backlog + 1.25 * q[3]", "weight") + out_sql(), "dec")
def al5(spark, sf):
    return out(A.point_forecast(dec(spark, sf), 0.25))


@query("al_6_fixed_quantile", wf_sql("dec", f"backlog + {sql_interp('q', '0.8', False)}", "weight") + out_sql(), "dec")
def al6(spark, sf):
    return out(A.fixed_quantile(dec(spark, sf), 0.8))


def greedy_sql(src: str, demand: str, score: str, name: str = "gr") -> str:
    return f""", {name}_s AS (SELECT *, least({demand}, cap) AS gd, {score} AS gs FROM {src}),
    {name} AS (SELECT *, greatest(least(gd, capacity - coalesce(sum(gd) OVER (PARTITION BY link_id, epoch ORDER BY gs DESC, cell_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)), 0.0) AS given FROM {name}_s)"""


@query("al_7_max_weight", greedy_sql("dec", "queue_fh / 4 + ewma", "priority * (queue_fh + 1e-6 * ewma) * (1 + 0.5 * hol_age / deadline)")
       + wf_sql("gr", "given", "1.0") + out_sql(), "dec")
def al7(spark, sf):
    return out(A.max_weight(dec(spark, sf), T, 0.0, 0.5))


@query("al_8_predictive_max_weight", greedy_sql("dec", "queue_fh / 4 + 1.25 * q[3]", "priority * (queue_fh + 2.0 * 5 * q[3])")
       + wf_sql("gr", "given", "1.0") + out_sql(), "dec")
def al8(spark, sf):
    return out(A.predictive_max_weight(dec(spark, sf), T, H, 0.25, 2.0))


_CLS = wf_sql("dec", f"backlog + {sql_interp('q', '(CASE WHEN deadline <= 10 THEN 0.97 ELSE 0.6 END)', True)}",
              "least(greatest(5.0 / deadline, 0.25), 1.0) * CASE WHEN deadline <= 10 THEN 2.5 ELSE 1.0 END")


@query("al_9_class_levels", _CLS + out_sql(), "dec")
def al9(spark, sf):
    return out(A.class_levels(dec(spark, sf), H, 0.97, 0.6, 2.5))


def risk_sql(src: str, back: str, weight: str, delta: str = "0.0::DOUBLE", q: str = "q", rounds: int = 60) -> str:
    """CTE ``kkt``: equal-risk budgets by bisection on the level over lists, with the slack step."""
    f = sql_interp("y.q", "least(greatest(1 - {l} / y.w + y.d, 0.0), 1.0)", True)
    alloc = "least(greatest(CASE WHEN 1 - {l} / y.w <= 0 THEN 0.0 ELSE y.b + " + f + " END, 0.0), y.c)"

    def al(level: str) -> str:
        return alloc.replace("{l}", level)

    return f""", k_x AS (SELECT *, {back} AS kb, ({weight})::DOUBLE AS kw, {delta} AS kd, {q} AS kq FROM {src}),
    k_g AS (SELECT link_id, epoch, any_value(capacity) AS capacity, list({{'b': kb, 'w': kw, 'd': kd, 'q': kq, 'c': cap}}) AS cells, max(kw) AS top
      FROM k_x GROUP BY ALL),
    k_l AS (SELECT link_id, epoch, capacity, list_sum(list_transform(cells, lambda y: {al('0.0::DOUBLE')})) AS sum0,
      list_reduce(range({rounds}), lambda s, i: CASE WHEN list_sum(list_transform(cells, lambda y: {al('((s.lo + s.hi) / 2)')})) > capacity
        THEN {{'lo': (s.lo + s.hi) / 2, 'hi': s.hi}} ELSE {{'lo': s.lo, 'hi': (s.lo + s.hi) / 2}} END, {{'lo': 0.0::DOUBLE, 'hi': top}}) AS br FROM k_g),
    k_r AS (SELECT x.*, l.sum0, l.br, {al('0.0::DOUBLE').replace('y.q', 'kq').replace('y.w', 'kw').replace('y.d', 'kd').replace('y.b', 'kb').replace('y.c', 'cap')} AS r0,
      {al('br.hi').replace('y.q', 'kq').replace('y.w', 'kw').replace('y.d', 'kd').replace('y.b', 'kb').replace('y.c', 'cap')} AS rhi,
      {al('br.lo').replace('y.q', 'kq').replace('y.w', 'kw').replace('y.d', 'kd').replace('y.b', 'kb').replace('y.c', 'cap')} AS rlo
      FROM k_x x JOIN k_l l USING (link_id, epoch)),
    k_s AS (SELECT *, sum(rhi) OVER g AS shi, sum(greatest(rlo - rhi, 0.0)) OVER g AS sroom, sum(r0) OVER g AS s0, sum(cap - r0) OVER g AS head
      FROM k_r WINDOW g AS (PARTITION BY link_id, epoch)),
    kkt AS (SELECT *, CASE WHEN sum0 <= capacity THEN r0 + CASE WHEN capacity - s0 > 1e-9 AND head > 1e-9 THEN
        least(cap - r0, (capacity - s0) * (cap - r0) / head) ELSE 0.0 END
      ELSE rhi + CASE WHEN capacity - shi > 0 AND sroom > 0 THEN greatest(rlo - rhi, 0.0) * least(1.0, (capacity - shi) / sroom) ELSE 0.0 END END AS budget,
      CASE WHEN sum0 <= capacity THEN 0.0 ELSE br.hi END AS level FROM k_s)"""


@query("al_10_equal_risk", risk_sql("dec", "backlog", "weight")
       + "SELECT link_id, epoch, cell_id, round(budget + 1e-9, 5) AS budget, round(level, 6) AS level FROM kkt", "dec")
def al10(spark, sf):
    d = R.equal_risk(dec(spark, sf))
    return A.project_budgets(d).select(*ID, F.round(F.col("budget") + 1e-9, 5).alias("budget"), F.round("level", 6).alias("level"))


@query("al_11_equal_risk_class_weight", risk_sql("dec", "backlog", "CASE WHEN deadline <= 10 THEN 1.5 ELSE 1.0 END * least(greatest(5.0 / deadline, 0.25), 1.0)")
       + out_sql("kkt"), "dec")
def al11a(spark, sf):
    w = F.when(S.is_low_latency("deadline"), F.lit(1.5)).otherwise(F.lit(1.0)) * S.deadline_weight(F.lit(1.0), "deadline", H)
    return out(R.equal_risk(dec(spark, sf), weight=w))


@query("al_11_equal_risk_volume_weight", risk_sql("dec", "backlog", "priority * volume") + out_sql("kkt"), "dec")
def al11b(spark, sf):
    return out(R.equal_risk(dec(spark, sf), weight=F.col("priority") * F.col("volume")))


@query("al_11_equal_risk_drift_weight", risk_sql("dec", "backlog", "weight * (0.5 + queue_fh / (5 * greatest(q[3], 1e-6)))") + out_sql("kkt"), "dec")
def al11c(spark, sf):
    return out(R.equal_risk(dec(spark, sf), weight=drift_weight()))


def drift_weight(kappa: float = 0.5):
    return F.col("weight") * (F.lit(kappa) + F.col("queue_fh") / (F.lit(H) * F.greatest(A.median_of(), F.lit(1e-6))))


_SHIFT = "[" + ", ".join(sql_interp("q", f"{min(max(a + 0.1, 0.05), 0.95)!r}::DOUBLE", False) for a in _KNOTS) + "]"


@query("al_11_equal_risk_shifted_forecast", risk_sql("dec", "backlog", "weight", q=_SHIFT) + out_sql("kkt"), "dec")
def al11d(spark, sf):
    d = dec(spark, sf).withColumn("qs", Q.shift_levels("q", F.lit(0.1)))
    return out(R.equal_risk(d, q="qs"))


@query("al_11_equal_risk_level_offset", risk_sql("dec", "backlog", "weight", delta="((cell_id % 5) - 2)::DOUBLE * 0.05::DOUBLE") + out_sql("kkt"), "dec")
def al11e(spark, sf):
    return out(R.equal_risk(dec(spark, sf), delta=(F.col("cell_id") % 5 - 2).cast("double") * F.lit(0.05)))





@query("al_11_equal_risk_sustain", risk_sql("dec", "backlog", "weight", q="list_transform(q, lambda v: greatest(v, ewma))") + out_sql("kkt"), "dec")
def al11f(spark, sf):
    """Targets floored at the observed mean rate."""
    d = dec(spark, sf).withColumn("qf", F.transform("q", lambda v: F.greatest(v, F.col("ewma"))))
    return out(R.equal_risk(d, q="qf"))


def _two_stage_sql(eta: float) -> str:
    p0 = "(CASE WHEN deadline <= 10 THEN 0.7 ELSE 0.5 END)"
    f = sql_interp("y.q", "least(greatest(1 - {l} / y.w, 0.0), 1.0)", True)
    al = "greatest(y.f, least(CASE WHEN 1 - {l} / y.w <= 0 THEN 0.0 ELSE y.b + " + f + " END, y.c))"
    row = al.replace("{l}", "hi").replace("y.q", "q").replace("y.w", "om").replace("y.b", "back").replace("y.c", "cap").replace("y.f", "given")
    return (f""", t0 AS (SELECT *, 0.8 * queue_fh / 4 + 0.2 * backlog AS back, CASE WHEN deadline <= 10 THEN 2.0 ELSE 1.0 END AS v,
        CASE WHEN deadline <= 10 THEN 4.0 ELSE 1.0 END AS om, queue_fh + 1.5 * 5 * q[3] AS pressure FROM dec),
      t1 AS (SELECT *, least(back + 1.1 * {sql_interp('q', p0, True)}, cap) AS base FROM t0),
      t2 AS (SELECT *, sum(base) OVER g AS basesum, avg(pressure) OVER g AS meanp FROM t1 WINDOW g AS (PARTITION BY link_id, epoch))"""
            + wf_sql("t2", "base", f"v * pow(greatest(pressure / greatest(meanp, 1e-9), 1e-9), {eta})", False, "sh")
            + greedy_sql("(SELECT t2.*, s.budget AS shared FROM t2 JOIN (SELECT link_id, epoch, cell_id, budget FROM sh) s USING (link_id, epoch, cell_id))",
                         "base", "v * pressure")
            + f""", t3 AS (SELECT link_id, epoch, any_value(capacity) AS capacity, list({{'b': back, 'w': om::DOUBLE, 'q': q, 'c': cap, 'f': given}}) AS cells,
        max(om)::DOUBLE AS top FROM gr GROUP BY ALL),
      t4 AS (SELECT link_id, epoch, CASE WHEN list_sum(list_transform(cells, lambda y: {al.replace('{l}', '0.0::DOUBLE')})) <= capacity THEN 0.0::DOUBLE ELSE
        list_reduce(range(60), lambda s, i: CASE WHEN list_sum(list_transform(cells, lambda y: {al.replace('{l}', '((s.lo + s.hi) / 2)')})) > capacity
        THEN {{'lo': (s.lo + s.hi) / 2, 'hi': s.hi}} ELSE {{'lo': s.lo, 'hi': (s.lo + s.hi) / 2}} END, {{'lo': 0.0::DOUBLE, 'hi': top}}).hi END AS hi FROM t3),
      t5 AS (SELECT gr.*, {row} AS risk, capacity - sum(given) OVER (PARTITION BY link_id, epoch) AS rest FROM gr JOIN t4 USING (link_id, epoch))"""
            + wf_sql("(SELECT * EXCLUDE (gd, gs) FROM t5)", "risk", "1.0", True, "mg")
            + f"""SELECT link_id, epoch, cell_id, round(CASE WHEN basesum > capacity AND {eta} < 6 THEN shared WHEN rest <= 1e-9 THEN given ELSE budget END + 1e-9, 5) AS budget FROM mg""")


_TS = dict(p0_ll=0.7, p0_embb=0.5, v_ll=2.0, lookahead=1.5, omega_ll=4.0, a=0.8, mu=0.1)


@query("al_12_two_stage_greedy", _two_stage_sql(6.0), "dec")
def al12(spark, sf):
    return out(R.two_stage(dec(spark, sf), T, H, eta=6.0, **_TS))


@query("al_12_two_stage_shared", _two_stage_sql(1.5), "dec")
def al12b(spark, sf):
    return out(R.two_stage(dec(spark, sf), T, H, eta=1.5, **_TS))


@query("al_13_hindsight", wf_sql("dec", "backlog + label", "weight") + out_sql(), "dec")
def al13(spark, sf):
    return out(A.hindsight(dec(spark, sf)))


def _tier_sql(target: str) -> str:
    return (f", n0 AS (SELECT *, least(ceil((backlog + {target}) / 2.0) * 2.0, cap) AS need1, round(weight, 9) AS tier FROM dec)"
            + wf_sql("n0", "need1", "weight", True, "fit")
            + """, n1 AS (SELECT link_id, epoch, tier, sum(need1) AS tiersum FROM n0 GROUP BY ALL),
      n2 AS (SELECT *, coalesce(sum(tiersum) OVER (PARTITION BY link_id, epoch ORDER BY tier DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS before,
        sum(tiersum) OVER (PARTITION BY link_id, epoch) AS total FROM n1)
      SELECT f.link_id, f.epoch, f.cell_id, round(CASE WHEN n2.total <= f.capacity THEN f.budget WHEN tiersum <= f.capacity - before THEN need1
        WHEN f.capacity - before > 0 THEN least(need1 * (f.capacity - before) / tiersum, cap) ELSE 0.0 END + 1e-9, 5) AS budget
      FROM fit f JOIN n2 USING (link_id, epoch, tier)""")


@query("al_14_hindsight_tiers", _tier_sql("label"), "dec")
def al14(spark, sf):
    return out(A.hindsight_tiers(dec(spark, sf), V.UNIT))


@query("al_14_hindsight_tiers_sustain", _tier_sql("greatest(label, label_mean)"), "dec")
def al14b(spark, sf):
    return out(A.hindsight_tiers(dec(spark, sf).withColumn("sus", F.greatest("label", "label_mean")), V.UNIT, "sus"))


_SHORT = """SELECT link_id, epoch, round(sum(priority * (deadline + 1) * greatest(backlog + label - budget, 0.0)) / (360.0 * 5), 6) AS shortfall FROM {} GROUP BY ALL"""


@query("al_15_weighted_shortfall", wf_sql("dec", "backlog + persist", "weight") + _SHORT.format("wf"), "dec")
def al15(spark, sf):
    d = A.weighted_shortfall(A.deadline_aware(dec(spark, sf)), H)
    return d.select("link_id", "epoch", F.round("shortfall", 6).alias("shortfall"))


@query("ag_29_level_diagnostics", risk_sql("dec", "backlog", "weight") + """, lv AS (SELECT link_id, epoch, any_value(level) AS level FROM kkt GROUP BY ALL)
    SELECT link_id, count(*)::BIGINT AS epochs, round(avg((level > 0)::INT), 6) AS binding, round(avg((level >= 1.0 - 1e-9)::INT), 6) AS at_floor,
      round(quantile_cont(level, 0.25), 5) AS q25, round(quantile_cont(level, 0.5), 5) AS median, round(quantile_cont(level, 0.75), 5) AS q75,
      round(1 - least(quantile_cont(level, 0.5), 3.0) / 3.0, 5) AS ll_level FROM lv GROUP BY link_id""", "dec")
def ag29(spark, sf):
    d = R.with_level(dec(spark, sf).select("link_id", "epoch", "cap", "capacity", "backlog", "weight", "q"), "backlog", "weight", F.lit(0.0), F.lit(0.0))
    d = d.groupBy("link_id", "epoch").agg(F.first("level").alias("level"))
    med = F.percentile("level", 0.5)
    return d.groupBy("link_id").agg(
        F.count("*").alias("epochs"), F.round(F.avg((F.col("level") > 0).cast("int")), 6).alias("binding"),
        F.round(F.avg((F.col("level") >= 1.0 - 1e-9).cast("int")), 6).alias("at_floor"),
        F.round(F.percentile("level", 0.25), 5).alias("q25"), F.round(med, 5).alias("median"), F.round(F.percentile("level", 0.75), 5).alias("q75"),
        F.round(1 - F.least(med, F.lit(3.0)) / 3.0, 5).alias("ll_level"))
