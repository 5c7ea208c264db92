"""Aggregations: key figures of runs, report tables, forecasts scores, phase fits."""
from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from .. import constants as K
from ..functions import scalars as S
from ..operators import kpis as KP, phases as PH, ranks, relational as R, reports as RP, scoring as SC, series
from ..sources import dims
from . import views as V
from .registry import query


def r(name, n=6):
    return F.round(name, n).alias(name)


@query("ag_1_violation_ratios", """SELECT link_id, round(sum(priority * violated) / greatest(sum(priority * arrived), 1e-9), 6) AS weighted_violation_ratio,
    round(sum(violated)::DOUBLE / sum(arrived), 6) AS violation_ratio,
    round(coalesce(sum(violated) FILTER (deadline <= 10), 0)::DOUBLE / greatest(coalesce(sum(arrived) FILTER (deadline <= 10), 0), 1e-9), 6) AS violation_ratio_ll,
    round(coalesce(sum(violated) FILTER (deadline > 10), 0)::DOUBLE / greatest(coalesce(sum(arrived) FILTER (deadline > 10), 0), 1e-9), 6) AS violation_ratio_embb
    FROM run_slots WHERE slot >= 20 GROUP BY link_id""", "run_slots")
def ag1(spark, sf):
    g = V.run_slots(spark, sf).where("slot >= 20").groupBy("link_id").agg(*KP.violation_ratios())
    return g.select("link_id", r("weighted_violation_ratio"), r("violation_ratio"), r("violation_ratio_ll"), r("violation_ratio_embb"))


@query("ag_2_utilisation", """SELECT link_id, round(sum(served)::DOUBLE / (360.0 * count(DISTINCT slot)), 6) AS utilisation, round(sum(arrived) * 1.25 / (360.0 * count(DISTINCT slot)), 6) AS allocated,
    round((sum(arrived) * 1.25 - sum(served)) / greatest(sum(arrived) * 1.25, 1e-9), 6) AS unused FROM run_slots GROUP BY link_id""", "run_slots")
def ag2(spark, sf):
    g = V.run_slots(spark, sf).groupBy("link_id", "slot").agg(F.sum("served").alias("used"), (F.sum("arrived") * 1.25).alias("alloc"))
    room = F.lit(V.CAPACITY) * F.count("*")
    return g.groupBy("link_id").agg(F.round(F.sum("used") / room, 6).alias("utilisation"), F.round(F.sum("alloc") / room, 6).alias("allocated"),
                                    F.round((F.sum("alloc") - F.sum("used")) / F.greatest(F.sum("alloc"), F.lit(1e-9)), 6).alias("unused"))


@query("ag_3_offered_load", "SELECT link_id, round(sum(fh_bits)::DOUBLE / (360.0 * count(DISTINCT slot)), 6) AS offered FROM slots WHERE slot >= 20 GROUP BY link_id", "slots")
def ag3(spark, sf):
    g = V.slots(spark, sf).where("slot >= 20").groupBy("link_id", "slot").agg(F.sum("fh_bits").alias("b"))
    return g.groupBy("link_id").agg(F.round(F.sum("b") / (F.lit(V.CAPACITY) * F.count("*")), 6).alias("offered"))


_SR = ", sr AS (SELECT link_id, cell_id, CASE WHEN sum(arrived) > 0 THEN sum(served)::DOUBLE / sum(arrived) ELSE 1.0 END AS ratio, sum(served) AS s, sum(arrived) AS a FROM run_slots GROUP BY link_id, cell_id)"


@query("ag_4_service_ratios", _SR + " SELECT link_id, round(sum(s)::DOUBLE / sum(a), 6) AS served_ratio, round(min(ratio), 6) AS min_ratio FROM sr GROUP BY link_id", "run_slots")
def ag4(spark, sf):
    s = KP.service_ratios(V.run_slots(spark, sf), ["link_id"])
    return s.groupBy("link_id").agg(F.round(F.sum("s") / F.sum("a"), 6).alias("served_ratio"), F.round(F.min("ratio"), 6).alias("min_ratio"))


@query("ag_5_jain_index", _SR + " SELECT link_id, round(pow(sum(ratio), 2) / (count(*) * sum(ratio * ratio)), 6) AS jain FROM sr GROUP BY link_id", "run_slots")
def ag5(spark, sf):
    return KP.service_ratios(V.run_slots(spark, sf), ["link_id"]).groupBy("link_id").agg(F.round(KP.jain("ratio"), 6).alias("jain"))


def _delay_sql(key: str) -> str:
    return f""", h AS (SELECT {key}, age, sum(served) AS b FROM run_slots GROUP BY ALL), c AS (SELECT *, sum(b) OVER (PARTITION BY {key} ORDER BY age) / sum(b) OVER (PARTITION BY {key}) AS cdf FROM h)
    SELECT {key}, round(sum(b * age)::DOUBLE / greatest(sum(b), 1e-9) * 0.5, 6) AS mean_delay, min(age) FILTER (cdf >= 0.95) * 0.5::DOUBLE AS pct_delay FROM c GROUP BY {key}"""


@query("ag_6_delay_percentile", _delay_sql("cell_id"), "run_slots")
def ag6(spark, sf):
    return KP.delay_percentile(V.run_slots(spark, sf), ["cell_id"], "age", "served", 0.95, 0.5).select("cell_id", r("mean_delay"), "pct_delay")


@query("ag_6_delay_percentile_link", _delay_sql("link_id"), "run_slots")
def ag6b(spark, sf):
    return KP.delay_percentile(V.run_slots(spark, sf), ["link_id"], "age", "served", 0.95, 0.5).select("link_id", r("mean_delay"), "pct_delay")


@query("ag_7_backlog", """SELECT cell_id, round(sum(fh_bits)::DOUBLE / count(*), 6) AS mean_backlog, arg_max(fh_bits, slot) AS residual FROM slots WHERE slot >= 20 GROUP BY cell_id""", "slots")
def ag7(spark, sf):
    return V.slots(spark, sf).where("slot >= 20").groupBy("cell_id").agg(
        F.round(F.sum("fh_bits") / F.count("*"), 6).alias("mean_backlog"), F.max_by("fh_bits", "slot").alias("residual"))


@query("ag_8_cell_report", """, p AS (SELECT cell_id, slot, any_value(name) AS name, sum(arrived) AS a, sum(served) AS s, sum(violated) AS v, sum(served * age) AS sa, max(age) AS m FROM run_slots GROUP BY cell_id, slot)
    SELECT cell_id, any_value(name) AS name, sum(a)::BIGINT AS arrived, sum(s)::BIGINT AS served, sum(v)::BIGINT AS violated, round(sum(v)::DOUBLE / sum(a), 6) AS violation_ratio,
    round(sum(sa)::DOUBLE / sum(s), 6) AS mean_delay, max(m)::BIGINT AS max_delay, round(sum(a * 1.25) / (SELECT n FROM weeks), 6) AS mean_budget, round(sum(s) / (SELECT n::DOUBLE FROM weeks), 6) AS mean_used,
    round(sum(a) / (SELECT n::DOUBLE FROM weeks), 6) AS mean_demand, round(sum(a - s) / (SELECT n::DOUBLE FROM weeks), 6) AS mean_backlog FROM p GROUP BY cell_id""", "run_slots")
def ag8(spark, sf):
    n = F.lit(float(V.weeks(spark, sf)))
    return V.run_slots(spark, sf).groupBy("cell_id").agg(
        F.first("name").alias("name"), F.sum("arrived").alias("arrived"), F.sum("served").alias("served"), F.sum("violated").alias("violated"),
        F.round(F.sum("violated") / F.sum("arrived"), 6).alias("violation_ratio"),
        F.round(F.sum(F.col("served") * F.col("age")) / F.sum("served"), 6).alias("mean_delay"), F.max("age").cast("bigint").alias("max_delay"),
        F.round(F.sum("arrived") * 1.25 / n, 6).alias("mean_budget"), F.round(F.sum("served") / n, 6).alias("mean_used"),
        F.round(F.sum("arrived") / n, 6).alias("mean_demand"), F.round(F.sum(F.col("arrived") - F.col("served")) / n, 6).alias("mean_backlog"))


@query("ag_9_latency", "SELECT method, round(avg(ms), 4) AS mean_ms, round(quantile_cont(ms, 0.95), 4) AS p95_ms FROM bench_rows GROUP BY method", "bench_rows")
def ag9(spark, sf):
    b = V.bench_rows(spark, sf)
    mean = b.groupBy("method").agg(F.round(F.avg("ms"), 4).alias("mean_ms"))
    return mean.join(ranks.percentiles(b, ["method"], "ms", [0.95]), "method").select("method", "mean_ms", F.round(F.get("q", F.lit(0)), 4).alias("p95_ms"))


def _sum_sql(keys: str, metrics) -> str:
    cols = ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(coalesce(stddev_samp({m}), 0.0), 6) AS {m}_std" for m in metrics)
    return f"SELECT {keys}, {cols}, count(*)::BIGINT AS n_runs FROM runs_x GROUP BY ALL"


_X = ", runs_x AS (SELECT *, seed % 4 AS sweep FROM runs)"
_M4 = ["wvr", "vr", "ll", "embb"]


@query("ag_10_summary", _X + _sum_sql("scenario, method", _M4), "runs")
def ag10(spark, sf):
    return RP.summary(V.runs(spark, sf), ["scenario", "method"], _M4)


@query("ag_10_trade_off", _X + _sum_sql("method", ["ll", "embb"]), "runs")
def ag10b(spark, sf):
    return RP.summary(V.runs(spark, sf), ["method"], ["ll", "embb"])


# the five sweeps differ in the swept column only: interval, delay, width, class weight, level shift
for _i, (_name, _expr, _sql) in enumerate([
        ("interval", F.lit, "CASE seed % 4 WHEN 0 THEN 4 WHEN 1 THEN 10 WHEN 2 THEN 20 ELSE 40 END"),
        ("delay", F.lit, "seed % 5"), ("width", F.lit, "6 + seed % 3 * 3"), ("class_weight", F.lit, "(1 + seed % 3 * 2)::DOUBLE"),
        ("level_shift", F.lit, "(seed % 7 - 3)::DOUBLE / 10")]):
    def _sweep(spark, sf, name=_name):
        s = F.col("seed")
        swept = {"interval": F.when(s % 4 == 0, 4).when(s % 4 == 1, 10).when(s % 4 == 2, 20).otherwise(40), "delay": s % 5,
                 "width": s % 3 * 3 + 6, "class_weight": (s % 3 * 2 + 1).cast("double"), "level_shift": (s % 7 - 3).cast("double") / 10}[name]
        return RP.summary(V.runs(spark, sf).withColumn("sweep", swept), ["scenario", "sweep", "method"], ["wvr", "ll"])
    query(f"ag_11_sweep_{_name}", f", runs_x AS (SELECT *, {_sql} AS sweep FROM runs)" + _sum_sql("scenario, sweep, method", ["wvr", "ll"]), "runs")(_sweep)


_SC = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("ag_12_pivot", "SELECT method, " + ", ".join(f"round(avg(wvr) FILTER (scenario = '{s}'), 6) AS \"{s}\"" for s in _SC) + " FROM runs GROUP BY method", "runs")
def ag12(spark, sf):
    return RP.pivot_means(V.runs(spark, sf), "method", "scenario", _SC, "wvr")


_MEANS = ", m AS (SELECT scenario, method, avg(wvr) AS v, avg(vr) AS u FROM runs GROUP BY ALL)"


@query("ag_13_best_method", _MEANS + " SELECT scenario, arg_min(method, v) AS method, round(min(v), 6) AS mean FROM m WHERE method != 'MACHINERY' GROUP BY scenario", "runs")
def ag13(spark, sf):
    skip = dims.grid(spark, "method", ["MACHINERY"], "string")
    return RP.best_methods(V.runs(spark, sf), "wvr", F.broadcast(skip)).select("scenario", "method", r("mean"))


@query("ag_13_wins", _MEANS + ", b AS (SELECT scenario, arg_min(method, v) AS method FROM m GROUP BY scenario) SELECT method, count(*)::BIGINT AS wins FROM b GROUP BY method", "runs")
def ag13b(spark, sf):
    return RP.best_methods(V.runs(spark, sf), "wvr").groupBy("method").agg(F.count("*").alias("wins"))


@query("ag_14_wins_and_runner_up", _MEANS + """, k AS (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY u, method) AS rank FROM m)
    SELECT scenario, max((rank = 1 AND method = 'BUILDING')::INT)::BIGINT AS wins, arg_min(method, rank) FILTER (method != 'BUILDING') AS best_other FROM k GROUP BY scenario""", "runs")
def ag14(spark, sf):
    k = RP.ranked_methods(V.runs(spark, sf), "vr")
    me = F.col("method") == "BUILDING"
    return k.groupBy("scenario").agg(F.max((me & (F.col("rank") == 1)).cast("bigint")).alias("wins"),
                                     F.min_by(F.when(~me, F.col("method")), F.when(~me, F.col("rank"))).alias("best_other"))


def score_sql(src: str, keys: str) -> str:
    """Forecast scores of ``src`` with columns q (list) and y."""
    levels = K.QUANTILE_LEVELS
    pin = [f"avg(greatest({a}::DOUBLE * (y - q[{i + 1}]), ({a}::DOUBLE - 1) * (y - q[{i + 1}])))" for i, a in enumerate(levels)]
    cov = ", ".join(f"round(avg((y <= q[{i + 1}])::INT), 6) AS coverage_q{int(round(a * 100)):02d}" for i, a in enumerate(levels))
    group = f"GROUP BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""SELECT {lead}{cov}, round(({' + '.join(pin)}) / 6, 6) AS pinball_mean, round(avg(abs(y - q[3])), 6) AS median_mae,
      round(avg(abs(y - q[3])) / greatest(avg(y), 1e-9), 6) AS median_mae_rel, round(avg((y >= q[1] AND y <= q[6])::INT), 6) AS interval90_coverage,
      round(avg(q[6] - q[1]) / greatest(avg(y), 1e-9), 6) AS interval90_width_rel FROM {src} {group}"""


_FY = ", fy AS (SELECT link_id, cell_id, epoch, deadline, q, label AS y, persist FROM dec)"


@query("ag_15_forecast_scores", _FY + score_sql("fy", "link_id"), "dec")
def ag15(spark, sf):
    return SC.forecast_scores(V.decisions(spark, sf), ["link_id"], "label", "q")


@query("ag_16_scores_by_class", _FY + score_sql("(SELECT *, deadline <= 10 AS ll FROM fy)", "ll"), "dec")
def ag16(spark, sf):
    return SC.forecast_scores(V.decisions(spark, sf).withColumn("ll", S.is_low_latency("deadline")), ["ll"], "label", "q")


@query("ag_16_mean_of_traces", _FY + ", t AS (" + score_sql("(SELECT *, deadline <= 10 AS ll FROM fy)", "ll, link_id").replace("round(", "(").replace(", 6) AS", ") AS") + """)
    SELECT ll, round(avg(pinball_mean), 6) AS pinball, round(avg(interval90_coverage), 6) AS coverage, count(*)::BIGINT AS traces FROM t GROUP BY ll""", "dec")
def ag16b(spark, sf):
    per = SC.forecast_scores(V.decisions(spark, sf).withColumn("ll", S.is_low_latency("deadline")), ["ll", "link_id"], "label", "q", digits=None)
    return per.groupBy("ll").agg(F.round(F.avg("pinball_mean"), 6).alias("pinball"), F.round(F.avg("interval90_coverage"), 6).alias("coverage"), F.count("*").alias("traces"))


@query("ag_17_persistence_error", "SELECT link_id, round(avg(abs(label - rstar_lag_1)), 6) AS mae, round(avg(abs(label - rstar_lag_1)) / avg(label), 6) AS mae_rel FROM feat5 WHERE obs_slot >= 35 AND label IS NOT NULL GROUP BY link_id", "feat5")
def ag17(spark, sf):
    f = V.epochs_features(spark, sf).where(series.enough_history(V.FAST) & F.col("label").isNotNull())
    mae = F.avg(F.abs(F.col("label") - F.col("rstar_lag_1")))
    return f.groupBy("link_id").agg(F.round(mae, 6).alias("mae"), F.round(mae / F.avg("label"), 6).alias("mae_rel"))


@query("ag_18_empirical_tail", """, q AS (SELECT cell_id % 8 AS cls, unnest([0.1, 0.01]::DOUBLE[]) AS p, unnest(quantile_cont(fh_bits, [0.9, 0.99])) AS threshold FROM slots GROUP BY cell_id % 8)
    SELECT q.cls, q.p, round(q.threshold, 6) AS threshold, round(avg((s.fh_bits > q.threshold)::INT), 6) AS share_above FROM q JOIN slots s ON s.cell_id % 8 = q.cls GROUP BY ALL""", "slots")
def ag18(spark, sf):
    s = V.slots(spark, sf).select((F.col("cell_id") % 8).alias("cls"), "fh_bits")
    return RP.thresholds_at(s, ["cls"], "fh_bits", [0.1, 0.01]).select("cls", "p", r("threshold"), r("share_above"))


@query("ag_19_histogram", """WITH l AS (SELECT l_returnflag AS flag, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT flag, least(floor((l_extendedprice - lo) / ((hi - lo) / 60)), 59)::BIGINT AS bin, count(*)::BIGINT AS count, round(count(*) / (any_value(n) * (any_value(hi) - any_value(lo)) / 60) * 1e6, 6) AS density
    FROM lineitem JOIN l ON l.flag = l_returnflag GROUP BY 1, 2""")
def ag19(spark, sf):
    li = V.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    return RP.histogram(li, ["flag"], "l_extendedprice", 60).select("flag", "bin", "count", F.round(F.col("density") * 1e6, 6).alias("density"))


_PH = """, cuts AS (SELECT cell_id, quantile_cont(bits, 0.45) AS c1, quantile_cont(bits, 0.85) AS c2, count(*) AS w FROM event_slots GROUP BY cell_id),
    ph AS (SELECT e.cell_id, e.slot, e.bits, (c1 <= bits)::INT + (c2 <= bits)::INT AS phase FROM event_slots e JOIN cuts USING (cell_id)),
    cnt AS (SELECT a.cell_id, a.phase AS f, b.phase AS t, count(*) AS n FROM ph a JOIN ph b ON a.cell_id = b.cell_id AND b.slot = a.slot + 1 GROUP BY ALL),
    tr AS (SELECT c.cell_id, f.f, t.t, (coalesce(n, 0) + 0.5) / sum(coalesce(n, 0) + 0.5) OVER (PARTITION BY c.cell_id, f.f) AS p
      FROM cuts c CROSS JOIN range(3) f(f) CROSS JOIN range(3) t(t) LEFT JOIN cnt ON cnt.cell_id = c.cell_id AND cnt.f = f.f AND cnt.t = t.t)"""


def phased(spark, sf):
    return PH.assign(V.event_slots(spark, sf), ["cell_id"], "bits")


@query("ag_20_phase_transitions", _PH + " SELECT cell_id, f AS from_phase, t AS to_phase, round(p, 6) AS p FROM tr", "event_slots")
def ag20(spark, sf):
    t = PH.transitions(phased(spark, sf), ["cell_id"], "slot", chunk=128)
    return t.select("cell_id", F.col("from").cast("bigint").alias("from_phase"), F.col("to").cast("bigint").alias("to_phase"), r("p"))


@query("ag_20_phase_moments", _PH + """, pm AS (SELECT cell_id, phase, count(*) AS n, avg(bits) AS m, stddev_samp(bits) AS s FROM ph GROUP BY ALL), allm AS (SELECT cell_id, avg(bits) AS m FROM ph GROUP BY cell_id)
    SELECT a.cell_id, k.k AS phase, round(coalesce(pm.m, a.m), 5) AS mean, round(CASE WHEN pm.n >= 2 AND pm.m > 0 THEN least(greatest(pm.s / pm.m, 0.05), 2.0) ELSE 0.5 END, 6) AS cv
    FROM allm a CROSS JOIN range(3) k(k) LEFT JOIN pm ON pm.cell_id = a.cell_id AND pm.phase = k.k""", "event_slots")
def ag20b(spark, sf):
    return PH.moments(phased(spark, sf), ["cell_id"], "bits").select("cell_id", F.col("phase").cast("bigint").alias("phase"), r("mean", 5), r("cv"))


@query("ag_21_stationary", _PH + """, pw(i, cell_id, k, x) AS (SELECT 0, cell_id, k.k, 1.0::DOUBLE / 3 FROM cuts CROSS JOIN range(3) k(k)
    UNION ALL SELECT pw.i + 1, pw.cell_id, tr.t, sum(pw.x * tr.p) FROM pw JOIN tr ON tr.cell_id = pw.cell_id AND tr.f = pw.k WHERE pw.i < 300 GROUP BY pw.i, pw.cell_id, tr.t)
    SELECT cell_id, k AS phase, round(x, 6) AS share FROM pw WHERE i = 300""", "event_slots", recursive=True)
def ag21(spark, sf):
    t = PH.transitions(phased(spark, sf), ["cell_id"], "slot", chunk=128)
    return PH.stationary(t, ["cell_id"]).select("cell_id", F.col("phase").cast("bigint").alias("phase"), r("share"))


@query("ag_22_benchmark_summary", """SELECT dim, method, round(avg(ms), 4) AS mean_ms, round(quantile_cont(ms, 0.5), 4) AS median_ms, round(quantile_cont(ms, 0.95), 4) AS p95_ms, round(avg(residual), 6) AS residual, round(avg(rel_err), 6) AS rel_err
    FROM bench_rows GROUP BY ALL ORDER BY dim, mean_ms""", "bench_rows")
def ag22(spark, sf):
    b = V.bench_rows(spark, sf)
    g = b.groupBy("dim", "method").agg(F.round(F.avg("ms"), 4).alias("mean_ms"), F.round(F.avg("residual"), 6).alias("residual"), F.round(F.avg("rel_err"), 6).alias("rel_err"))
    g = g.join(ranks.percentiles(b, ["dim", "method"], "ms", [0.5, 0.95]), ["dim", "method"])
    return g.select("dim", "method", "mean_ms", F.round(F.get("q", F.lit(0)), 4).alias("median_ms"), F.round(F.get("q", F.lit(1)), 4).alias("p95_ms"), "residual", "rel_err").orderBy("dim", "mean_ms")


@query("ag_23_interval_coverage", """SELECT l_returnflag AS setting, l_linestatus AS scenario, round(avg((l_quantity >= 10 + l_discount * 100)::INT), 6) AS p_low, round(avg((l_quantity <= 40 + l_tax * 100)::INT), 6) AS p_high,
    round(avg(((40 + l_tax * 100) / (10 + l_discount * 100)) / (l_quantity / l_linenumber)), 6) AS ratio FROM lineitem GROUP BY ALL""")
def ag23(spark, sf):
    lo, hi, v = F.lit(10) + F.col("l_discount") * 100, F.lit(40) + F.col("l_tax") * 100, F.col("l_quantity")
    return V.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("setting"), F.col("l_linestatus").alias("scenario")).agg(
        F.round(F.avg((v >= lo).cast("int")), 6).alias("p_low"), F.round(F.avg((v <= hi).cast("int")), 6).alias("p_high"),
        F.round(F.avg(hi / lo / (v / F.col("l_linenumber"))), 6).alias("ratio"))


@query("ag_24_threshold_audit", """SELECT l_linestatus AS grp, t AS threshold, round(avg((l_discount <= t)::INT), 6) AS accepted, sum((l_discount <= t AND l_returnflag = 'R')::INT)::BIGINT AS unsafe, count(*)::BIGINT AS n
    FROM lineitem CROSS JOIN (VALUES (0.015::DOUBLE), (0.035), (0.055), (0.075)) v(t) GROUP BY ALL""")
def ag24(spark, sf):
    li = V.table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("grp"), "l_discount", "l_returnflag")
    return RP.threshold_audit(li, "l_discount", F.col("l_returnflag") == "R", [0.015, 0.035, 0.055, 0.075], ["grp"]).select("grp", "threshold", r("accepted"), "unsafe", "n")


@query("ag_25_log_fit", """, p AS (SELECT c_nationkey AS k, c_custkey + 1 AS x, c_acctbal + 1001 AS y FROM customer), h AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY x) AS n FROM p)
    SELECT k, round(regr_slope(ln(y), ln(x)), 6) AS slope, round(ln(exp(regr_intercept(ln(y), ln(x)))), 5) AS log_constant FROM h WHERE n <= 6 GROUP BY k""".replace(", p AS", "WITH p AS", 1))
def ag25(spark, sf):
    p = V.table(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), (F.col("c_custkey") + 1).alias("x"), (F.col("c_acctbal") + 1001).alias("y"))
    return RP.log_fit(p, ["k"], "x", "y", 6, "x").select("k", r("slope"), F.round(F.ln("constant"), 5).alias("log_constant"))


@query("ag_26_measured_over_predicted", "SELECT scenario, round(quantile_cont(wvr / (ll * 0.1), 0.5), 6) AS median, round(min(wvr / (ll * 0.1)), 6) AS lo, round(max(wvr / (ll * 0.1)), 6) AS hi FROM runs GROUP BY scenario", "runs")
def ag26(spark, sf):
    x = V.runs(spark, sf).withColumn("x", F.col("wvr") / (F.col("ll") * 0.1))
    return x.groupBy("scenario").agg(F.round(F.percentile("x", 0.5), 6).alias("median"), F.round(F.min("x"), 6).alias("lo"), F.round(F.max("x"), 6).alias("hi"))


@query("ag_27_cheapest_within", """, g AS (SELECT scenario, method, seed % 7 AS budget, avg(embb) AS loss FROM runs GROUP BY ALL)
    SELECT scenario, method, coalesce((min(budget) FILTER (loss <= 0.02))::VARCHAR, '>' || max(budget)) AS needed FROM g GROUP BY ALL""", "runs")
def ag27(spark, sf):
    g = V.runs(spark, sf).groupBy("scenario", "method", (F.col("seed") % 7).alias("budget")).agg(F.avg("embb").alias("loss"))
    return RP.cheapest_within(g, ["scenario", "method"], "budget", "loss", 0.02)


@query("ag_28_best_of_grid", """, g AS (SELECT scenario, seed % 7 AS budget, method, avg(embb) AS loss FROM runs GROUP BY ALL) SELECT scenario, budget, round(min(loss), 6) AS best FROM g GROUP BY ALL""", "runs")
def ag28(spark, sf):
    g = V.runs(spark, sf).groupBy("scenario", (F.col("seed") % 7).alias("budget"), "method").agg(F.avg("embb").alias("loss"))
    return g.groupBy("scenario", "budget").agg(F.round(F.min("loss"), 6).alias("best"))


@query("ag_30_extremes", _MEANS + """ SELECT method, round(min(v), 6) AS lo, round(max(v), 6) AS hi, round(max(CASE WHEN scenario = '3-MEDIUM' THEN v END), 6) AS base,
    round(100 * (max(v) - max(CASE WHEN scenario = '3-MEDIUM' THEN v END)) / max(CASE WHEN scenario = '3-MEDIUM' THEN v END), 6) AS worst_rel FROM m GROUP BY method""", "runs")
def ag30(spark, sf):
    m = V.runs(spark, sf).groupBy("scenario", "method").agg(F.avg("wvr").alias("v"))
    base = F.max(F.when(F.col("scenario") == "3-MEDIUM", F.col("v")))
    return m.groupBy("method").agg(F.round(F.min("v"), 6).alias("lo"), F.round(F.max("v"), 6).alias("hi"), F.round(base, 6).alias("base"),
                                   F.round(100 * (F.max("v") - base) / base, 6).alias("worst_rel"))


@query("ag_31_distinct_counts", "SELECT count(DISTINCT seed)::BIGINT AS seeds, count(DISTINCT method)::BIGINT AS methods, count(DISTINCT scenario)::BIGINT AS scenarios, count(*)::BIGINT AS runs FROM runs", "runs")
def ag31(spark, sf):
    return V.runs(spark, sf).agg(F.count_distinct("seed").alias("seeds"), F.count_distinct("method").alias("methods"),
                                 F.count_distinct("scenario").alias("scenarios"), F.count("*").alias("runs"))


_GAIN = ", g AS (SELECT l_partkey % 40 AS grp, l_suppkey % 8 AS rx, l_linenumber AS tx, sum(l_quantity) AS gain FROM lineitem GROUP BY ALL)"


@query("ag_32_sum_rate", _GAIN.replace(", g AS", "WITH g AS", 1) + """, s AS (SELECT grp, rx, sum(gain) AS total, coalesce(sum(gain) FILTER (rx = tx), 0) AS sig FROM g GROUP BY ALL),
    t AS (SELECT grp, sum(log2(1 + sig / (total - sig + 1.0))) AS rate FROM s GROUP BY grp) SELECT round(avg(rate), 6) AS mean_rate, count(*)::BIGINT AS groups FROM t""")
def ag32(spark, sf):
    li = V.table(spark, sf, "lineitem").groupBy((F.col("l_partkey") % 40).alias("grp"), (F.col("l_suppkey") % 8).alias("rx"), F.col("l_linenumber").alias("tx")).agg(F.sum("l_quantity").alias("gain"))
    s = li.groupBy("grp", "rx").agg(F.sum("gain").alias("total"), F.coalesce(F.sum(F.when(F.col("rx") == F.col("tx"), F.col("gain"))), F.lit(0.0)).alias("sig"))
    t = s.groupBy("grp").agg(F.sum(F.log2(F.lit(1.0) + F.col("sig") / (F.col("total") - F.col("sig") + 1.0))).alias("rate"))
    return t.agg(F.round(F.avg("rate"), 6).alias("mean_rate"), F.count("*").alias("groups"))


@query("ag_33_best_server", """WITH p AS (SELECT o_custkey AS usr, l_suppkey % 19 AS server, sum(l_quantity) AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)
    SELECT usr, arg_max(server, p * 100 - server) AS server, round(max(p) / (sum(p) - max(p) + 0.5), 6) AS sinr FROM p GROUP BY usr""")
def ag33(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("usr"))
    li = V.table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 19).alias("server"), "l_quantity")
    p = li.join(o, li.l_orderkey == o.o_orderkey).groupBy("usr", "server").agg(F.sum("l_quantity").alias("p"))
    return p.groupBy("usr").agg(F.max_by("server", F.col("p") * 100 - F.col("server")).alias("server"), F.round(F.max("p") / (F.sum("p") - F.max("p") + 0.5), 6).alias("sinr"))


@query("ag_34_split_shares", """WITH r AS (SELECT p_brand AS grp, p_size / 50.0 AS f FROM part) SELECT grp, round(avg((f < 0.15)::INT), 6) AS low, round(avg((f >= 0.15 AND f < 0.55)::INT), 6) AS mid, round(avg((f >= 0.55)::INT), 6) AS high,
    round(1 - avg(CASE WHEN f < 0.15 THEN 0.1 WHEN f < 0.55 THEN 0.5 ELSE 1.0 END), 6) AS reduction, round(1 - (0.1 * 0.15 + 0.5 * (0.55 - 0.15) + 1.0 * (1 - 0.55)), 6)::DOUBLE AS closed_form FROM r GROUP BY grp""")
def ag34(spark, sf):
    f = F.col("p_size") / 50.0
    p = V.table(spark, sf, "part").select(F.col("p_brand").alias("grp"), f.alias("f"))
    cost = F.when(F.col("f") < 0.15, 0.1).when(F.col("f") < 0.55, 0.5).otherwise(1.0)
    return p.groupBy("grp").agg(F.round(F.avg((F.col("f") < 0.15).cast("int")), 6).alias("low"), F.round(F.avg(((F.col("f") >= 0.15) & (F.col("f") < 0.55)).cast("int")), 6).alias("mid"),
                                F.round(F.avg((F.col("f") >= 0.55).cast("int")), 6).alias("high"), F.round(1 - F.avg(cost), 6).alias("reduction"),
                                F.round(F.lit(1 - (0.1 * 0.15 + 0.5 * (0.55 - 0.15) + 1.0 * (1 - 0.55))), 6).alias("closed_form"))


@query("ag_35_gram_matrix", "SELECT a.pos AS i, b.pos AS j, round(sum(a.x * b.x) + CASE WHEN a.pos = b.pos THEN 0.1 ELSE 0.0 END, 6) AS g FROM coords a JOIN coords b ON a.id = b.id AND b.pos >= a.pos GROUP BY a.pos, b.pos", "coords")
def ag35(spark, sf):
    from ..operators import compression as C
    g = C.gram_table(V.vectors(spark, sf))
    return g.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"),
                    F.round(F.col("g") + F.when(F.col("i") == F.col("j"), 0.1).otherwise(0.0), 6).alias("g"))


@query("ag_36_relative_to_baseline", """, m AS (SELECT dim, CASE method WHEN 'A' THEN 'fast' WHEN 'N' THEN 'exact SVD' ELSE 'slow' END AS method, avg(ms) AS ms FROM bench_rows GROUP BY ALL)
    SELECT dim, method, round(max(CASE WHEN contains(method, 'SVD') THEN ms END) OVER (PARTITION BY dim) / greatest(ms, 1e-9), 6) AS speed_up, ms < 37500 AS fits FROM m""", "bench_rows")
def ag36(spark, sf):
    name = F.when(F.col("method") == "A", "fast").when(F.col("method") == "N", "exact SVD").otherwise("slow")
    m = V.bench_rows(spark, sf).groupBy("dim", name.alias("method")).agg(F.avg("ms").alias("ms"))
    return RP.relative_to(m, ["dim"], "method", "SVD", "ms").select("dim", "method", r("speed_up"), (F.col("ms") < 37500).alias("fits"))
