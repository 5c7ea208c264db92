"""Paired statistics, replay, calibration and tuning."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scalars as S
from ..operators import allocation as A, calibration as CAL, equal_risk as ER, paired as PA, registry as RG, relational as R, replay as RE, reports as RP, search, series
from ..sources import dims, tables
from . import views as V
from .q_allocation import greedy_sql, risk_sql, sql_interp, wf_sql
from .registry import query


def r(name, n=6):
    return F.round(name, n).alias(name)


_PAIRS = """, pairs AS (SELECT b.scenario, b.method AS baseline, b.seed, b.wvr AS o, r.wvr AS r, b.wvr - r.wvr AS diff FROM runs b JOIN runs r
    ON r.scenario = b.scenario AND r.seed = b.seed AND r.method = 'BUILDING' WHERE b.method != 'BUILDING')"""


def pairs(spark, sf):
    return R.paired(V.runs(spark, sf), "BUILDING", "wvr")


@query("st_1_paired_differences", _PAIRS + """ SELECT scenario, baseline, count(*)::BIGINT AS n, round(avg(o), 6) AS baseline_mean, round(avg(r), 6) AS reference_mean, round(avg(diff), 6) AS diff_mean,
    round(coalesce(stddev_samp(diff), 0.0), 6) AS diff_std, round(min(diff), 6) AS diff_min, round(max(diff), 6) AS diff_max, round(100 * avg(diff) / avg(o), 6) AS rel_reduction_pct,
    sum((diff > 0)::INT)::BIGINT AS wins FROM pairs GROUP BY ALL""", "runs")
def st1(spark, sf):
    d = PA.differences(pairs(spark, sf))
    return d.select("scenario", "baseline", "n", *[r(c) for c in ("baseline_mean", "reference_mean", "diff_mean", "diff_std", "diff_min", "diff_max", "rel_reduction_pct")], "wins")


def _boot_sql(src: str, keys: str, reps: int, order: str, stat: str) -> str:
    return f""", pos AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) - 1 AS pos, count(*) OVER (PARTITION BY {keys}) AS n FROM {src}),
    dr0 AS (SELECT n, rep, i, (rep * 1103515245 + 12345) % 2147483647 AS a, (i * 69621 + 7919) % 2147483647 AS b FROM (SELECT DISTINCT n FROM pos) CROSS JOIN range({reps}) r(rep) CROSS JOIN range(100000) p(i) WHERE i < n),
    dr1 AS (SELECT n, rep, ((xor((a * a) >> 15, (b * b) >> 13) % 2147483647 + a) % 2147483647 * 48271 + b) % 2147483647 AS y FROM dr0),
    dr AS (SELECT n, rep, ((y * y) >> 16) % 2147483647 * 16807 % 2147483647 % n AS idx FROM dr1),
    bt AS (SELECT {keys}, rep, max(pos.n) AS n, {stat} AS v FROM dr JOIN pos ON pos.n = dr.n AND pos.pos = dr.idx GROUP BY {keys}, rep)
    SELECT {keys}, CASE WHEN max(bt.n) > 1 THEN round(quantile_cont(v, 0.025), 5) END AS ci_lo, CASE WHEN max(bt.n) > 1 THEN round(quantile_cont(v, 0.975), 5) END AS ci_hi FROM bt GROUP BY {keys}"""


@query("st_2_bootstrap_reduction", _PAIRS + _boot_sql("pairs", "scenario, baseline", 10000, "seed", "100 * (avg(o) - avg(r)) / greatest(avg(o), 1e-12)").replace("range(100000) p(i)", "range(64) p(i)"), "runs")
def st2(spark, sf):
    return PA.bootstrap_reduction(pairs(spark, sf)).select("scenario", "baseline", r("ci_lo", 5), r("ci_hi", 5))


_NULL = """, nc(n, w, c) AS (SELECT 0::BIGINT, 0::BIGINT, 1::BIGINT UNION ALL SELECT n + 1, w2, sum(c2)::BIGINT FROM (
      SELECT n, w AS w2, c AS c2 FROM nc WHERE n < 25 UNION ALL SELECT n, w + n + 1, c FROM nc WHERE n < 25) GROUP BY n, w2)"""
_WIL = """, rk AS (SELECT *, abs(diff) AS a FROM pairs WHERE diff != 0),
    rr AS (SELECT *, rank() OVER (PARTITION BY scenario, baseline ORDER BY a) + (count(*) OVER (PARTITION BY scenario, baseline, a) - 1) / 2.0 AS rnk,
      count(*) OVER (PARTITION BY scenario, baseline, a) AS t FROM rk),
    ws AS (SELECT scenario, baseline, count(*) AS n, sum(CASE WHEN diff > 0 THEN rnk ELSE 0 END)::DOUBLE AS plus, sum(rnk)::DOUBLE AS al, sum((t * t - 1)::DOUBLE) AS ties FROM rr GROUP BY ALL),
    wz AS (SELECT *, least(plus, al - plus) AS st, abs(least(plus, al - plus) - n * (n + 1) / 4.0) / sqrt((n * (n + 1) * (2 * n + 1) - 0.5 * ties) / 24) / sqrt(2.0) AS z FROM ws),
    wp AS (SELECT scenario, baseline, CASE WHEN n < 6 THEN NULL WHEN n <= 25 AND ties = 0 THEN least(1.0, 2.0 * (SELECT sum(c) FROM nc WHERE nc.n = wz.n AND nc.w <= wz.st) / pow(2.0, n))
      ELSE 1 - CASE WHEN z > 6 THEN 1.0 ELSE 2 / sqrt(pi()) * exp(-z * z) * list_reduce(range(1, 121), lambda acc, k: {'t': acc.t * 2 * z * z / (2 * k + 1), 's': acc.s + acc.t * 2 * z * z / (2 * k + 1)}, {'t': z, 's': z}).s END END AS p FROM wz)"""


@query("st_3_signed_rank", _NULL + _PAIRS + _WIL + " SELECT scenario, baseline, round(p, 6) AS p FROM wp", "runs", recursive=True)
def st3(spark, sf):
    return PA.signed_rank(pairs(spark, sf)).select("scenario", "baseline", r("p"))


_RUNS60 = """, runs60 AS (SELECT o_orderpriority AS scenario, c_mktsegment AS method, o_orderkey % 60 AS seed, sum(CAST(round(o_totalprice * 100) AS BIGINT))::DOUBLE / count(*) / 5e8 AS wvr
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""


def runs60(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    c = V.table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("o_orderpriority").alias("scenario"), F.col("c_mktsegment").alias("method"), (F.col("o_orderkey") % 60).alias("seed")).agg(
        (F.sum(cents) / F.count("*") / F.lit(5e8)).alias("wvr"))


@query("st_3_signed_rank_large", _NULL + _RUNS60 + _PAIRS.replace("FROM runs b JOIN runs r", "FROM runs60 b JOIN runs60 r") + _WIL + " SELECT scenario, baseline, round(p, 6) AS p FROM wp", "scenarios", recursive=True)
def st3b(spark, sf):
    return PA.signed_rank(R.paired(runs60(spark, sf), "BUILDING", "wvr")).select("scenario", "baseline", r("p"))


_HOLM = """, hk AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY p, baseline) AS rn, count(*) OVER (PARTITION BY scenario) AS k FROM wp WHERE p IS NOT NULL),
    hm AS (SELECT scenario, baseline, p, max(least(1.0, (k - rn + 1) * p)) OVER (PARTITION BY scenario ORDER BY rn) AS p_holm FROM hk)"""


@query("st_4_holm", _NULL + _PAIRS + _WIL + _HOLM + " SELECT scenario, baseline, round(p, 6) AS p, round(p_holm, 6) AS p_holm FROM hm UNION ALL SELECT scenario, baseline, NULL, NULL FROM wp WHERE p IS NULL", "runs", recursive=True)
def st4(spark, sf):
    return PA.holm(PA.signed_rank(pairs(spark, sf))).select("scenario", "baseline", r("p"), r("p_holm"))


@query("st_5_whiskers", _PAIRS + """ SELECT scenario, baseline, round(min(100 * diff / o) FILTER (o > 0), 5) AS lo, round(avg(100 * diff / o) FILTER (o > 0), 5) AS mean, round(max(100 * diff / o) FILTER (o > 0), 5) AS hi,
    sum((diff > 0)::INT) || '/' || count(*) AS wins FROM pairs GROUP BY ALL""", "runs")
def st5(spark, sf):
    return PA.whiskers(pairs(spark, sf)).select("scenario", "baseline", r("lo", 5), r("mean", 5), r("hi", 5), "wins")


_RIVALS = ["MACHINERY", "FURNITURE", "HOUSEHOLD"]


@query("st_6_head_to_head", _NULL + _PAIRS + _WIL + _HOLM + """, d AS (SELECT scenario, baseline, round_even(100 * avg(diff) / avg(o), 0)::BIGINT AS rel FROM pairs GROUP BY ALL),
    t AS (SELECT d.scenario, d.baseline, CASE WHEN rel = 0 THEN '0' WHEN rel > 0 THEN '+' || rel ELSE rel::VARCHAR END || CASE WHEN p_holm < 0.01 THEN '**' WHEN p_holm < 0.05 THEN '*' ELSE '' END AS cell FROM d JOIN hm USING (scenario, baseline)),
    b AS (SELECT scenario, arg_min(method, v) AS best FROM (SELECT scenario, method, avg(wvr) AS v FROM runs GROUP BY ALL) GROUP BY scenario)
    SELECT t.scenario, """ + ", ".join(f"max(cell) FILTER (baseline = '{m}') AS \"{m}\"" for m in _RIVALS) + ", any_value(best) AS best FROM t JOIN b USING (scenario) GROUP BY t.scenario", "runs", recursive=True)
def st6(spark, sf):
    p = pairs(spark, sf)
    t = PA.differences(p).join(PA.holm(PA.signed_rank(p)), ["scenario", "baseline"])
    t = t.withColumn("cell", F.concat(S.signed_int("rel_reduction_pct"), S.significance_mark("p_holm")))
    best = RP.best_methods(V.runs(spark, sf), "wvr").select("scenario", F.col("method").alias("best"))
    return t.groupBy("scenario").pivot("baseline", _RIVALS).agg(F.max("cell")).join(best, "scenario").select("scenario", *_RIVALS, "best")


@query("st_7_bootstrap_mean", (_boot_sql("(SELECT scenario, method, seed, wvr FROM runs)", "scenario, method", 2000, "seed", "avg(wvr)").replace("range(100000) p(i)", "range(64) p(i)")), "runs")
def st7(spark, sf):
    return PA.bootstrap(V.runs(spark, sf), ["scenario", "method"], "seed", ["wvr"], lambda m: m, 2000).select("scenario", "method", r("ci_lo", 5), r("ci_hi", 5))


_SF = "sum(priority * (deadline + 1) * greatest(backlog + label - budget, 0.0)) / (360.0 * 5)"


_INV = "least(greatest(5.0 / deadline, 0.25), 1.0)"
#: SQL of each tuned rule over rows that carry their candidate's parameters: text of the views, name of the last one
_RULE_SQL = {
    "reactive_prop": lambda src, w: wf_sql(src, "queue_fh / 4 + (1 + margin) * ewma", "1.0", True, w),
    "queue_aware": lambda src, w: wf_sql(src, "backlog + (1 + margin) * persist", "weight", True, w),
    "maxweight": lambda src, w: greedy_sql(src, "queue_fh / 4 + (1 + margin) * ewma", "priority * (queue_fh + 1e-6 * ewma) * (1 + hol_weight * hol_age / deadline)", w + "_gr")
    + wf_sql(w + "_gr", "given", "1.0", True, w),
    "point_forecast": lambda src, w: wf_sql(src, "backlog + (1 + margin) * q[3]", "weight", True, w),
    "fixed_quantile": lambda src, w: wf_sql(src, f"backlog + {sql_interp('q', 'level', False)}", "weight", True, w),
    "pred_maxweight": lambda src, w: greedy_sql(src, "queue_fh / 4 + (1 + margin) * q[3]", "priority * (queue_fh + lookahead * 5 * q[3])", w + "_gr")
    + wf_sql(w + "_gr", "given", "1.0", True, w),
    "equal_risk_class": lambda src, w: risk_sql(src, "backlog", f"CASE WHEN deadline <= 10 THEN ll_weight ELSE 1.0 END * {_INV}") + f", {w} AS (SELECT * FROM kkt)",
}


def _tune_sql(grids, by: str = "0") -> str:
    """View ``best`` (method, fam, cand, cost); the candidate rides in the link number, so the rules' own SQL serves all of them."""
    text, costs, values = "", [], []
    for i, (name, grid) in enumerate(grids.items()):
        rows = search.candidates(grid)
        cols = ", ".join(grid)
        text += f""", v{i}(cand, {cols}) AS (VALUES {", ".join(f"({c}, {', '.join(f'{x!r}::DOUBLE' for x in row)})" for c, row in enumerate(rows))}),
    s{i} AS (SELECT dec.* REPLACE (link_id * 100 + cand AS link_id), {by} AS fam, v{i}.* FROM dec CROSS JOIN v{i})""" + _RULE_SQL[name](f"s{i}", f"w{i}")
        costs.append(f"SELECT '{name}' AS method, fam, cand, round(avg(s), 9) AS cost FROM (SELECT fam, cand, link_id, epoch, {_SF} AS s FROM w{i} GROUP BY ALL) GROUP BY ALL")
        values += [f"('{name}', {c}, '{p}', {x!r}::DOUBLE)" for c, row in enumerate(rows) for p, x in zip(grid, row)]
    return (text + f", costs AS ({' UNION ALL '.join(costs)}), best AS (SELECT method, fam, arg_min(cand, {{'cost': cost, 'cand': cand}}) AS cand, min(cost) AS cost FROM costs GROUP BY ALL)"
            + f", par(method, cand, param, value) AS (VALUES {', '.join(values)}) ")


@query("st_8_grid_tuning", _tune_sql(search.GRIDS) + """SELECT b.method, p.param, p.value, round(b.cost, 6) AS cost, 'new' AS source FROM best b JOIN par p USING (method, cand)
    UNION ALL SELECT 'static_share', 'margin', 0.5::DOUBLE, NULL, 'old'""", "dec")
def st8(spark, sf):
    """Seven rules, every value of the grids on all decisions, the best of each merged over earlier selections."""
    new = search.tune(V.decisions(spark, sf), V.FAST)
    old = spark.createDataFrame([("static_share", {"margin": 0.5}, None, "old"), ("queue_aware", {"margin": 9.0}, 9.0, "old")], "method string, params map<string,double>, cost double, source string")
    both = tables.upsert(old, new.withColumn("source", F.lit("new")), ["method"])
    return both.select("method", F.explode("params").alias("param", "value"), r("cost"), "source")


_LEVELS = {"fixed_quantile": search.GRIDS["fixed_quantile"]}


@query("udf_method_registry_tuned", _tune_sql(_LEVELS, "link_id % 2") + ", chosen AS (SELECT dec.*, p.value AS level FROM dec JOIN best b ON b.fam = link_id % 2 JOIN par p USING (method, cand))"
       + _RULE_SQL["fixed_quantile"]("chosen", "fin") + "SELECT 'fixed_quantile' AS method, link_id, epoch, cell_id, round(budget + 1e-9, 5) AS budget FROM fin", "dec")
def tuned_rule(spark, sf):
    """Parameters by method and family (odd and even links) from the tuning table, never by hand."""
    d = V.decisions(spark, sf).withColumn("family", (F.col("link_id") % 2).cast("string"))
    table = search.tune(d, V.FAST, _LEVELS, ["family"]).checkpoint()
    parts = [RG.allocate("fixed_quantile", d.where(F.col("family") == f), V.FAST, tuned=table, family=f) for f in ("0", "1")]
    return parts[0].unionByName(parts[1]).select("method", "link_id", "epoch", "cell_id", F.round(F.col("budget") + 1e-9, 5).alias("budget"))


@query("st_9_policy_search")
def st9(spark, sf):
    """Eight generations of sixteen points from three starts; a generation scores the points of all starts in one job."""
    return search.class_level_search(V.decisions(spark, sf), V.FAST.horizon, seed=0, starts=((0.85, 0.5, math.log(3.0)), (0.95, 0.75, 0.0), (0.6, 0.25, math.log(8.0))))


# --- replay ---------------------------------------------------------------------------------------------------
_ALLOW = "least(60, floor((60 + (cell_id * 7 + slot // 20 * 11) % 50) / 2.0)) * 1.5"


def replay_input(spark, sf):
    s = V.slots(spark, sf).select("link_id", "cell_id", "slot", "deadline", "priority", F.col("fh_bits").alias("arrived"))
    budgets = (s.where("slot % 20 = 0").select("cell_id", F.col("slot").alias("epoch"),
                                               (60 + (F.col("cell_id") * 7 + (F.col("slot") / 20).cast("bigint") * 11) % 50).alias("budget")))
    j = R.spread_budgets(s, budgets, ["cell_id"], 20)
    return j.withColumn("allowed", RE.allowance("budget", F.lit(2.0), F.lit(1.5), F.lit(60.0)))


# the recursion keeps one list of D + 1 ages per cell and walks the slots
_FIFO = f""", inp AS (SELECT cell_id, slot, deadline, fh_bits::DOUBLE AS a, {_ALLOW} AS allow FROM slots),
    ff(cell_id, slot, st, served, violated, queue, hol, taken) AS (
      SELECT cell_id, -1::BIGINT, list_transform(range(deadline + 1), lambda x: 0.0::DOUBLE), 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0::BIGINT, list_transform(range(deadline + 1), lambda x: 0.0::DOUBLE)
        FROM (SELECT DISTINCT cell_id, deadline FROM slots)
      UNION ALL
      SELECT cell_id, slot, nst, list_sum(tk), left_d, list_sum(nst), coalesce(list_max(list_filter(list_transform(nst, lambda v, i: CASE WHEN v > 0 THEN i - 1 ELSE 0 END), lambda z: z >= 0)), 0)::BIGINT, tk FROM (
        SELECT *, list_prepend(0.0::DOUBLE, list_transform(range(1, deadline + 1), lambda j: st1[j] - tk[j])) AS nst, st1[deadline + 1] - tk[deadline + 1] AS left_d FROM (
          SELECT *, list_transform(range(1, deadline + 2), lambda j: greatest(least(allow - coalesce(list_sum(st1[j + 1:]), 0.0), st1[j]), 0.0)) AS tk FROM (
            SELECT i.cell_id, i.slot, i.deadline, i.allow, list_prepend(f.st[1] + i.a, f.st[2:]) AS st1 FROM ff f JOIN inp i ON i.cell_id = f.cell_id AND i.slot = f.slot + 1))))"""


@query("str_4_fifo_replay", _FIFO + " SELECT cell_id, slot, round(served, 6) AS served, round(violated, 6) AS violated, round(queue, 6) AS queue, hol FROM ff WHERE slot >= 0", "slots", recursive=True)
def str4(spark, sf):
    out = RE.per_slot(RE.replay(replay_input(spark, sf), ["cell_id"], V.weeks(spark, sf)), ["cell_id"])
    return out.select("cell_id", "slot", r("served"), r("violated"), r("queue"), "hol")


@query("str_4_fifo_replay_chunked", _FIFO + " SELECT cell_id, slot, round(served, 6) AS served, round(violated, 6) AS violated, round(queue, 6) AS queue, hol FROM ff WHERE slot >= 0", "slots", recursive=True)
def str4b(spark, sf):
    """The same replay with four chunks per cell, settled in rounds."""
    out = RE.per_slot(RE.replay(replay_input(spark, sf), ["cell_id"], V.weeks(spark, sf), chunk=100), ["cell_id"])
    return out.select("cell_id", "slot", r("served"), r("violated"), r("queue"), "hol")


@query("str_4_delay_histogram", _FIFO + """, ex AS (SELECT cell_id, unnest(range(len(taken))) AS age, unnest(taken) AS b FROM ff WHERE slot >= 0)
    SELECT cell_id, age, round(sum(b), 5) AS bits FROM ex GROUP BY ALL""", "slots", recursive=True)
def str4c(spark, sf):
    h = RE.delay_histogram(RE.replay(replay_input(spark, sf), ["cell_id"], V.weeks(spark, sf)), ["cell_id"])
    return h.select("cell_id", F.col("age").cast("bigint").alias("age"), r("bits", 5))


@query("wn_18_delayed_state", _FIFO + """ SELECT cell_id, slot, round(lag(queue, 3, 0.0) OVER w, 6) AS queue_seen, lag(hol, 3, 0::BIGINT) OVER w AS hol_seen FROM ff WHERE slot >= 0 WINDOW w AS (PARTITION BY cell_id ORDER BY slot)""", "slots", recursive=True)
def wn18(spark, sf):
    """Queue and age seen at slot t with delay 2: the values after slot t - 3, by equi join on the shifted slot."""
    s = RE.per_slot(RE.replay(replay_input(spark, sf), ["cell_id"], V.weeks(spark, sf)), ["cell_id"])
    past = s.select("cell_id", (F.col("slot") + 3).alias("slot"), "queue", "hol")
    return s.select("cell_id", "slot").join(past, ["cell_id", "slot"], "left").select(
        "cell_id", "slot", F.round(F.coalesce("queue", F.lit(0.0)), 6).alias("queue_seen"), F.coalesce("hol", F.lit(0)).alias("hol_seen"))


@query("wn_16_shortage_ranking", greedy_sql("dec", "queue_fh / 4 + ewma", "priority * queue_fh") + """
    SELECT link_id, epoch, cell_id, row_number() OVER (PARTITION BY link_id, epoch ORDER BY gs DESC, cell_id)::INT AS rank, round(given + 1e-9, 5) AS given FROM gr""", "dec")
def wn16(spark, sf):
    from pyspark.sql import Window as W
    score = F.col("priority") * F.col("queue_fh")
    d = V.decisions(spark, sf).withColumn("s", score)
    d = A.greedy_fill(d, F.col("queue_fh") / V.FAST.interval + F.col("ewma"), "s")
    rank = F.row_number().over(W.partitionBy("link_id", "epoch").orderBy(F.desc("s"), "cell_id"))
    return d.select("link_id", "epoch", "cell_id", rank.alias("rank"), F.round(F.col("_given") + 1e-9, 5).alias("given"))


@query("wn_17_step_down_maximum", _PAIRS + """, p AS (SELECT scenario, baseline, avg(abs(diff)) AS p FROM pairs GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY p, baseline) AS rn, count(*) OVER (PARTITION BY scenario) AS k FROM p)
    SELECT scenario, baseline, round(p, 6) AS p, round(max(least(1.0, (k - rn + 1) * p)) OVER (PARTITION BY scenario ORDER BY rn), 6) AS p_holm FROM k""", "runs")
def wn17(spark, sf):
    p = pairs(spark, sf).groupBy("scenario", "baseline").agg(F.avg(F.abs("diff")).alias("p"))
    return PA.holm(p).select("scenario", "baseline", r("p"), r("p_holm"))


# --- shortfall sandwich ---------------------------------------------------------------------------------------
_SAND = """, hz AS (SELECT o.cell_id, o.epoch, o.deadline, o.obs_slot, r.rate AS rstar FROM epochs22 o JOIN roll22 r ON r.cell_id = o.cell_id AND r.e = o.obs_slot + 22),
    rt AS (SELECT cell_id, quantile_cont(rstar, 0.5) AS rate FROM hz GROUP BY cell_id), hr AS (SELECT hz.*, rt.rate FROM hz JOIN rt USING (cell_id)),
    fl(cell_id, epoch, k, st, dropped) AS (SELECT cell_id, epoch, -1, list_transform(range(deadline + 1), lambda x: 0.0::DOUBLE), 0.0::DOUBLE FROM hr UNION ALL
      SELECT cell_id, epoch, k, list_prepend(0.0::DOUBLE, list_transform(range(1, deadline + 1), lambda j: st1[j] - tk[j])), dropped + st1[deadline + 1] - tk[deadline + 1] FROM (
        SELECT *, list_transform(range(1, deadline + 2), lambda j: greatest(least(rate - coalesce(list_sum(st1[j + 1:]), 0.0), st1[j]), 0.0)) AS tk FROM (
          SELECT f.cell_id, f.epoch, f.k + 1 AS k, h.deadline, h.rate, f.dropped, list_prepend(f.st[1] + CASE WHEN f.k + 1 < 22 THEN coalesce(s.fh_bits, 0) ELSE 0 END, f.st[2:]) AS st1
          FROM fl f JOIN hr h ON h.cell_id = f.cell_id AND h.epoch = f.epoch LEFT JOIN slots s ON s.cell_id = f.cell_id AND s.slot = h.obs_slot + f.k + 1 WHERE f.k + 1 < 22 + h.deadline + 1)))"""


@query("al_16_shortfall_sandwich", _SAND + """, b AS (SELECT hr.cell_id, hr.epoch, (hr.deadline + 1) * greatest(rstar - rate, 0.0) AS lower, (SELECT sum(greatest(s.fh_bits - rate, 0.0)) FROM slots s WHERE s.cell_id = hr.cell_id AND s.slot >= obs_slot AND s.slot < obs_slot + 22) AS upper,
      (SELECT max(dropped) FROM fl WHERE fl.cell_id = hr.cell_id AND fl.epoch = hr.epoch) AS drops FROM hr)
    SELECT cell_id, epoch, round(lower + 1e-8, 5) AS lower, round(drops + 1e-8, 5) AS drops, round(upper + 1e-8, 5) AS upper, NOT (lower - 1e-6 <= drops AND drops <= upper + 1e-6) AS broken FROM b""", "epochs22 roll22", recursive=True)
def al16(spark, sf):
    from pyspark.sql import Window as W
    from ..functions.demand import required_rate
    clock, n = V.SLOW, V.weeks(spark, sf)
    s = V.slots(spark, sf, n).select("cell_id", "slot", "deadline", "fh_bits")
    # horizons overlap by the delay: a slot belongs to at most two of them
    k = F.floor((F.col("slot") + clock.delay) / clock.interval)
    near = F.filter(F.array(k - 1, k), lambda j: (j >= 1) & (F.col("slot") >= j * clock.interval - clock.delay) & (F.col("slot") < (j + 1) * clock.interval))
    h = s.withColumn("j", F.explode(near)).withColumn("epoch", F.col("j") * clock.interval).where(F.col("epoch") + clock.interval <= n)
    h = h.groupBy("cell_id", "epoch").agg(F.first("deadline").alias("deadline"), F.sort_array(F.collect_list(F.struct("slot", "fh_bits"))).alias("a"))
    h = h.select("cell_id", "epoch", "deadline", F.col("a.fh_bits").cast("array<double>").alias("a")).withColumn("rstar", required_rate("a", "deadline"))
    h = h.join(h.groupBy("cell_id").agg(F.percentile("rstar", 0.5).alias("rate")), "cell_id")
    h = h.withColumns({"lower": (F.col("deadline") + 1) * F.greatest(F.col("rstar") - F.col("rate"), F.lit(0.0)), "drops": RE.fluid_drops("a", "deadline", "rate"),
                       "upper": F.aggregate("a", F.lit(0.0), lambda acc, x: acc + F.greatest(x - F.col("rate"), F.lit(0.0)))})
    broken = ~((F.col("lower") - 1e-6 <= F.col("drops")) & (F.col("drops") <= F.col("upper") + 1e-6))
    return h.select("cell_id", F.col("epoch").cast("bigint").alias("epoch"), *[F.round(F.col(c) + 1e-8, 5).alias(c) for c in ("lower", "drops", "upper")], broken.alias("broken"))


# --- calibration -----------------------------------------------------------------------------------------------
_CAL = """, m AS (SELECT cell_id, epoch, (row_number() OVER (PARTITION BY cell_id ORDER BY epoch) - 1)::BIGINT AS k, (label > q[5])::INT AS miss FROM dec),
    cal(cell_id, k, delta) AS (SELECT DISTINCT cell_id, 0::BIGINT, 0.0::DOUBLE FROM m UNION ALL
      SELECT c.cell_id, c.k + 1, CASE WHEN g.miss IS NULL THEN c.delta ELSE least(greatest(c.delta + 0.02::DOUBLE * (g.miss - (1 - 0.9::DOUBLE)), -0.05), 0.1) END
      FROM cal c JOIN m h ON h.cell_id = c.cell_id AND h.k = c.k + 1 LEFT JOIN m g ON g.cell_id = c.cell_id AND g.k = c.k + 1 - 2)"""


def calibrated(spark, sf, chunk=CAL.FAN):
    d = V.decisions(spark, sf).withColumns({"k": ((F.col("epoch") - 36) / 4).cast("bigint"), "miss": (F.col("label") > F.get("q", F.lit(4))).cast("int")})
    return d, CAL.offsets(d.select("cell_id", "k", "miss"), ["cell_id"], "k", "miss", CAL.maturity(V.FAST.interval, V.FAST.delay), lo=-0.05, hi=0.1, chunk=chunk)


def signed(name, n=6):
    """Rounded as DuckDB rounds: what is just below zero becomes -0.0, which ``round`` of Spark gives no sign."""
    return (F.rint(F.col(name) * 10.0 ** n) / 10.0 ** n).alias(name)


@query("str_5_calibration", _CAL + " SELECT cell_id, k, round(delta, 6) AS delta FROM cal", "dec", recursive=True)
def str5(spark, sf):
    return calibrated(spark, sf)[1].select("cell_id", "k", signed("delta"))


@query("str_5_calibration_chunked", _CAL + " SELECT cell_id, k, round(delta, 6) AS delta FROM cal", "dec", recursive=True)
def str5b(spark, sf):
    return calibrated(spark, sf, chunk=16)[1].select("cell_id", "k", signed("delta"))


from .q_allocation import out, out_sql, risk_sql  # noqa: E402


@query("al_11_equal_risk_calibrated", _CAL + ", dc AS (SELECT dec.*, cal.delta FROM dec JOIN m USING (cell_id, epoch) JOIN cal ON cal.cell_id = m.cell_id AND cal.k = m.k)"
       + risk_sql("dc", "backlog", "weight", delta="delta") + out_sql("kkt"), "dec", recursive=True)
def al11cal(spark, sf):
    d, off = calibrated(spark, sf)
    return out(ER.equal_risk(d.join(off, ["cell_id", "k"]), delta="delta"))
