"""Projections, predicates and scalar functions."""
from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from .. import constants as K
from ..functions import quantiles as Q, scalars as S
from ..operators import allocation as A, predicates as P, series
from ..sources import dims
from . import views as V
from .q_allocation import _KNOTS, sql_interp
from .registry import query

BETA9 = (12 * 2 * 9 + 8) * 14 * 1.08


def r(name, n=6):
    return F.round(name, n).alias(name)


@query("prj_1_prb_layer_bits", """SELECT p_partkey, p_size % 14 + 2 AS width, round((24 * (p_size % 14 + 2) + 8) * 14 * 1.08::DOUBLE, 6) AS beta FROM part""")
def prj1(spark, sf):
    p = V.table(spark, sf, "part").select("p_partkey", (F.col("p_size") % 14 + 2).alias("width"))
    return p.withColumn("beta", F.round(S.prb_layer_bits("width"), 6))


@query("prj_2_link_bits", f"SELECT cell_id, slot, round(arrivals_bits / se * {BETA9!r}::DOUBLE, 4) AS link_bits FROM slots", "slots")
def prj2(spark, sf):
    return V.slots(spark, sf).select("cell_id", "slot", F.round(S.link_bits("arrivals_bits", "se", S.prb_layer_bits(F.lit(9.0))), 4).alias("link_bits"))


@query("prj_3_link_columns", f"""SELECT link_id, round(25.0 * 1e9 * 0.0005 * (1 - 0.03), 3) AS usable, round(sum(273 * layers * {BETA9!r}::DOUBLE), 3) AS peak,
    round(sum(273 * layers * {BETA9!r}::DOUBLE) / (25.0 * 1e9 * 0.0005 * (1 - 0.03)), 6) AS oversubscription
    FROM (SELECT DISTINCT link_id, cell_id, layers FROM slots) GROUP BY link_id""", "slots")
def prj3(spark, sf):
    cells = V.slots(spark, sf).select("link_id", "cell_id", "layers").distinct()
    j = cells.join(F.broadcast(dims.links(spark)))          # one row
    usable, peak = S.usable_bits_per_slot("gbps", "reserve"), S.peak_bits_per_slot("prbs", "layers", S.prb_layer_bits("width", "overhead"))
    return j.groupBy("link_id").agg(F.round(F.first(usable), 3).alias("usable"), F.round(F.sum(peak), 3).alias("peak"),
                                    F.round(F.sum(peak) / F.first(usable), 6).alias("oversubscription"))


@query("prj_4_width_what_if", f"""SELECT cell_id, m AS width, sum(arrivals_bits)::BIGINT AS user_bits,
    round(sum(fh_bits) * ((24 * m + 8) * 14 * 1.08::DOUBLE / {BETA9!r}::DOUBLE), 5) AS link_bits, round(150 * ((24 * m + 8) * 14 * 1.08::DOUBLE / {BETA9!r}::DOUBLE), 5) AS cap
    FROM slots CROSS JOIN (VALUES (6), (9), (12)) v(m) GROUP BY cell_id, m""", "slots")
def prj4(spark, sf):
    """Cells are summed before the grid multiplies them."""
    per = V.slots(spark, sf).groupBy("cell_id").agg(F.sum("arrivals_bits").alias("user_bits"), F.sum("fh_bits").alias("fh"))
    ratio = S.prb_layer_bits("width") / S.prb_layer_bits(F.lit(9.0))
    return per.crossJoin(F.broadcast(dims.grid(spark, "width", [6, 9, 12], "int"))).select(
        "cell_id", "width", "user_bits", F.round(F.col("fh") * ratio, 5).alias("link_bits"), F.round(F.lit(V.CELL_CAP) * ratio, 5).alias("cap"))


@query("prj_5_priority_what_if", """SELECT link_id, w AS ll_priority, sum(CASE WHEN priority != 1 THEN w ELSE priority END * fh_bits)::DOUBLE AS weighted
    FROM slots CROSS JOIN (VALUES (1.0::DOUBLE), (3.0), (5.0)) v(w) GROUP BY ALL""", "slots")
def prj5(spark, sf):
    per = V.slots(spark, sf).groupBy("link_id", "priority").agg(F.sum("fh_bits").alias("fh"))
    j = per.crossJoin(F.broadcast(dims.grid(spark, "ll_priority", [1.0, 3.0, 5.0])))
    return j.groupBy("link_id", "ll_priority").agg(
        F.sum(F.when(F.col("priority") != 1, F.col("ll_priority")).otherwise(F.col("priority")) * F.col("fh")).alias("weighted"))


@query("prj_6_normalise", "SELECT cell_id, slot, round(fh_bits / 150.0, 6) AS level FROM slots", "slots")
def prj6(spark, sf):
    return V.slots(spark, sf).select("cell_id", "slot", F.round(F.col("fh_bits") / F.lit(V.CELL_CAP), 6).alias("level"))


@query("prj_7_project_budgets", """, b AS (SELECT link_id, cell_id, slot, CASE WHEN (cell_id + slot) % 11 = 0 THEN 0.0 ELSE least(greatest(fh_bits * 2.0 - 10, 0.0), 150.0) END AS x FROM slots)
    SELECT link_id, cell_id, slot, round(CASE WHEN sum(x) OVER g > 360 THEN x * 360 / sum(x) OVER g ELSE x END, 6) AS budget FROM b WINDOW g AS (PARTITION BY link_id, slot)""", "slots")
def prj7(spark, sf):
    raw = F.when((F.col("cell_id") + F.col("slot")) % 11 == 0, F.lit(float("nan"))).otherwise(F.col("fh_bits") * 2.0 - 10)
    s = V.slots(spark, sf).select("link_id", "cell_id", "slot", raw.alias("budget"), F.lit(V.CELL_CAP).alias("cap"), F.lit(V.CAPACITY).alias("capacity"))
    return A.project_budgets(s, group=["link_id", "slot"]).select("link_id", "cell_id", "slot", r("budget"))




def observed():
    """Epochs that have seen one whole horizon; before it a forecast repeats one partial rate."""
    return series.enough_history(V.FAST, 1)


@query("prj_8_tidy_quantiles", "SELECT cell_id, epoch, " + ", ".join(f"round(s[{i}], 6) AS q{i}" for i in range(1, 7))
       + " FROM (SELECT cell_id, epoch, list_sort(list_transform(q, lambda x: greatest(15 - x, 0.0))) AS s FROM fc5)", "fc5")
def prj8(spark, sf):
    f = series.window_forecast(V.packed(spark, sf), V.FAST).where(observed())
    f = f.withColumn("s", Q.tidy(F.transform("q", lambda x: F.lit(15.0) - x)))
    return f.select("cell_id", "epoch", *[F.round(F.get("s", F.lit(i)), 6).alias(f"q{i + 1}") for i in range(6)])


@query("prj_9_round_mantissa", """SELECT id, pos, CASE WHEN x = 0 THEN 0.0 ELSE round_even(x * pow(2.0, 5 - (floor(log2(abs(x))) + 1)), 0) * pow(2.0, (floor(log2(abs(x))) + 1) - 5) END AS x5 FROM coords""", "coords")
def prj9(spark, sf):
    v = V.vectors(spark, sf).select("id", F.posexplode("vec").alias("pos", "x"))
    return v.select("id", F.col("pos").cast("bigint").alias("pos"), S.round_mantissa("x", F.lit(5)).alias("x5"))


@query("prj_10_stream_rates", """SELECT n_nationkey, w AS width, u AS every, round((64 + n_nationkey) * 273 * 14.0 * (24 * w + 8) * 1.08 * 2000 / 1e9, 6) AS stream_gbps,
    round(91.0 * ((n_regionkey * 4 + 4) * ((64 + n_nationkey) * 2 * w + 8)) * 1.08 * 2000 / u / 1e9, 6) AS weight_gbps
    FROM nation CROSS JOIN (VALUES (4), (6), (8), (12)) a(w) CROSS JOIN (VALUES (1), (4), (16)) b(u)""")
def prj10(spark, sf):
    n = V.table(spark, sf, "nation").select("n_nationkey", (F.col("n_nationkey") + 64).alias("m"), (F.col("n_regionkey") * 4 + 4).alias("k"))
    g = dims.grid(spark, "width", [4, 6, 8, 12], "int").crossJoin(dims.grid(spark, "every", [1, 4, 16], "int"))
    return n.crossJoin(F.broadcast(g)).select("n_nationkey", "width", "every", F.round(S.stream_gbps("m", "width"), 6).alias("stream_gbps"),
                                              F.round(S.weight_update_gbps("m", "k", "width", "every"), 6).alias("weight_gbps"))


@query("prj_11_deadline_weight", """SELECT DISTINCT cell_id, h AS horizon, round(priority * least(greatest(h / deadline::DOUBLE, 0.25), 1.0), 6) AS weight
    FROM slots CROSS JOIN (VALUES (5), (22)) v(h)""", "slots")
def prj11(spark, sf):
    c = V.slots(spark, sf).select("cell_id", "priority", "deadline").distinct()
    g = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), S.deadline_weight("priority", "deadline", h).alias("weight")) for h in (5, 22)]))
    return c.select("cell_id", g.alias("g")).select("cell_id", "g.horizon", F.round("g.weight", 6).alias("weight"))


@query("prj_12_weight_variants", """SELECT link_id, cell_id, epoch, round(CASE WHEN deadline <= 10 THEN 1.5 ELSE 1.0 END * least(greatest(5.0 / deadline, 0.25), 1.0), 6) AS by_class,
    round(priority * volume, 6) AS by_volume, round(weight * (0.5 + queue_fh / (5 * greatest(q[3], 1e-6))), 6) AS by_drift FROM dec""", "dec")
def prj12(spark, sf):
    from .q_allocation import drift_weight
    cls = F.when(S.is_low_latency("deadline"), F.lit(1.5)).otherwise(F.lit(1.0)) * S.deadline_weight(F.lit(1.0), "deadline", V.FAST.horizon)
    return V.decisions(spark, sf).select("link_id", "cell_id", "epoch", F.round(cls, 6).alias("by_class"),
                                         F.round(F.col("priority") * F.col("volume"), 6).alias("by_volume"), F.round(drift_weight(), 6).alias("by_drift"))


@query("prj_13_whole_units", """SELECT cell_id, slot, ceil(fh_bits * 1.7 / 2.0) * 2.0 AS need_up, floor(fh_bits * 1.7 / 2.0) * 2.0 AS budget_down,
    ceil(fh_bits * 1.5 / 3.0 - 1e-9) * 3.0 AS used FROM slots""", "slots")
def prj13(spark, sf):
    x = F.col("fh_bits").cast("double")
    return V.slots(spark, sf).select("cell_id", "slot", S.units_up(x * 1.7, F.lit(2.0)).alias("need_up"), S.units_down(x * 1.7, F.lit(2.0)).alias("budget_down"),
                                     S.units_used(x * 1.5, F.lit(3.0)).alias("used"))


@query("prj_14_backlog_rate", """SELECT link_id, cell_id, epoch, queue_fh, hol_age,
    round(queue_fh / least(greatest(deadline - hol_age - 1 + 1, ceil(deadline / 2.0)), 4.0), 6) AS backlog FROM obs5""", "obs5")
def prj14(spark, sf):
    d = V.slots(spark, sf).select("cell_id", "deadline").distinct()
    o = V.observations(spark, sf).join(d, "cell_id")
    return o.select("link_id", "cell_id", "epoch", "queue_fh", "hol_age",
                    F.round(S.backlog_rate("queue_fh", "deadline", "hol_age", V.FAST.interval, V.FAST.delay), 6).alias("backlog"))


@query("prj_15_warm_residual", """SELECT n_nationkey, round(1.3 * 2 * sqrt(k / (m - k)) * sqrt(one), 6) AS residual,
    round(0.3 / (1.0 * 2 * sqrt(k / (m - k)) * pi() * 0.0005) * 299792458.0 / 3.5e9 * 3.6, 5) AS max_kmh
    FROM (SELECT n_nationkey, (n_regionkey * 4 + 4)::DOUBLE AS k, (64 + n_nationkey)::DOUBLE AS m, (n_nationkey + 1) / 100.0 AS one FROM nation)""")
def prj15(spark, sf):
    n = V.table(spark, sf, "nation").select("n_nationkey", (F.col("n_regionkey") * 4 + 4).cast("double").alias("k"),
                                            (F.col("n_nationkey") + 64).cast("double").alias("m"), ((F.col("n_nationkey") + 1) / 100.0).alias("one"))
    return n.select("n_nationkey", F.round(S.warm_residual("k", "m", "one", 1.3), 6).alias("residual"),
                    F.round(S.warm_speed_limit_kmh("k", "m"), 5).alias("max_kmh"))


# --- predicates --------------------------------------------------------------------------------------------
@query("flt_1_warm_up", "SELECT cell_id, count(*)::BIGINT AS slots, sum(fh_bits)::BIGINT AS bits FROM slots WHERE slot >= 100 GROUP BY cell_id", "slots")
def flt1(spark, sf):
    return V.slots(spark, sf).where(F.col("slot") >= 100).groupBy("cell_id").agg(F.count("*").alias("slots"), F.sum("fh_bits").alias("bits"))


@query("flt_2_service_class", """SELECT link_id, sum(fh_bits) FILTER (deadline <= 10)::BIGINT AS ll, sum(fh_bits) FILTER (deadline > 10)::BIGINT AS embb FROM slots GROUP BY link_id""", "slots")
def flt2(spark, sf):
    ll = S.is_low_latency("deadline")
    return V.slots(spark, sf).groupBy("link_id").agg(F.sum(F.when(ll, F.col("fh_bits"))).alias("ll"), F.sum(F.when(~ll, F.col("fh_bits"))).alias("embb"))


@query("flt_3_subset", """SELECT scenario, method, seed, round(wvr, 6) AS wvr FROM runs WHERE (method IN ('BUILDING', 'MACHINERY') OR method = 'FURNITURE')
    AND NOT starts_with(scenario, '5-')""", "runs")
def flt3(spark, sf):
    return P.method_subset(V.runs(spark, sf), ["BUILDING", "MACHINERY"], also="FURNITURE", without_prefix="5-").select("scenario", "method", "seed", r("wvr"))


@query("flt_4_min_history", """SELECT cell_id, count(*)::BIGINT AS epochs, min(epoch) AS first_epoch FROM epochs22 WHERE obs_slot >= 7 * 22 GROUP BY cell_id""", "epochs22")
def flt4(spark, sf):
    s = V.slots(spark, sf).where((F.col("slot") + V.SLOW.delay) % V.SLOW.interval == 0)
    e = s.select("cell_id", F.col("slot").alias("obs_slot"), (F.col("slot") + V.SLOW.delay).alias("epoch"))
    return e.where(series.enough_history(V.SLOW)).groupBy("cell_id").agg(F.count("*").alias("epochs"), F.min("epoch").alias("first_epoch"))


@query("flt_5_non_finite_fallback", """, b AS (SELECT *, (cell_id * 7 + epoch) % 97 = 0 AS bad FROM dec)
    SELECT link_id, cell_id, epoch, round(CASE WHEN bool_or(bad) OVER (PARTITION BY link_id, epoch) THEN persist ELSE q[3] END, 6) AS forecast FROM b""", "dec")
def flt5(spark, sf):
    d = V.decisions(spark, sf).select("link_id", "cell_id", "epoch", "persist",
                                      F.when((F.col("cell_id") * 7 + F.col("epoch")) % 97 == 0, F.lit(float("nan"))).otherwise(A.median_of()).alias("m"))
    return P.whole_group_fallback(d, "m", "persist", ["link_id", "epoch"], "forecast").select("link_id", "cell_id", "epoch", r("forecast"))


@query("flt_5_loss_guard", "SELECT o_orderkey, CASE WHEN o_custkey % 50 = 0 THEN 100.0 ELSE round(o_totalprice / (o_custkey % 50) + 1e-7, 4) END AS loss FROM orders")
def flt5b(spark, sf):
    o = V.table(spark, sf, "orders")
    loss = F.try_divide(F.col("o_totalprice"), (F.col("o_custkey") % 50).cast("double"))
    return o.select("o_orderkey", F.when(S.is_finite(loss), F.round(loss + 1e-7, 4)).otherwise(F.lit(100.0)).alias("loss"))


@query("flt_6_seed_split", """SELECT scenario, seed + 1000 * (seed % 4) + 990 AS run_seed, CASE WHEN seed + 1000 * (seed % 4) + 990 BETWEEN 1000 AND 1015 THEN 'train'
    WHEN seed + 1000 * (seed % 4) + 990 BETWEEN 2000 AND 2003 THEN 'val' WHEN seed + 1000 * (seed % 4) + 990 BETWEEN 3000 AND 3019 THEN 'test' END AS split, count(*)::BIGINT AS n FROM runs GROUP BY ALL""", "runs")
def flt6(spark, sf):
    g = V.runs(spark, sf).withColumn("run_seed", F.col("seed") + 1000 * (F.col("seed") % 4) + 990)
    return g.withColumn("split", dims.seed_split("run_seed")).groupBy("scenario", "run_seed", "split").agg(F.count("*").alias("n"))


@query("flt_6_positional_split", """SELECT o_orderpriority AS scenario, sum((rn <= 0.8 * n)::INT)::BIGINT AS train_rows, sum((rn > 0.8 * n)::INT)::BIGINT AS test_rows,
    max(o_orderkey) FILTER (rn <= 0.8 * n) AS last_train FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn,
    count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) GROUP BY 1""")
def flt6b(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("scenario"), "o_orderkey")
    d = P.positional_split(o, ["scenario"], "o_orderkey", 0.8, chunk=4096)
    tr = F.col("split") == "train"
    return d.groupBy("scenario").agg(F.sum(tr.cast("bigint")).alias("train_rows"), F.sum((~tr).cast("bigint")).alias("test_rows"),
                                     F.max(F.when(tr, F.col("o_orderkey"))).alias("last_train"))


@query("flt_7_thin_to_target", """, u AS (SELECT event_type, event_id, bits, (event_id * 1103515245 + 12345) % 2147483648 AS u FROM event_hits),
    c AS (SELECT *, sum(bits) OVER (PARTITION BY event_type ORDER BY u, event_id) AS cum, sum(bits) OVER (PARTITION BY event_type) AS total FROM u)
    SELECT event_type, count(*)::BIGINT AS kept, sum(bits)::BIGINT AS bits, max(u) AS threshold FROM c WHERE cum <= 0.4 * total GROUP BY event_type""", "event_hits")
def flt7(spark, sf):
    e = V.event_hits(spark, sf).select("event_type", "event_id", "bits")
    k = P.thin_to_share(e, ["event_type"], "event_id", "bits", 0.4)
    return k.groupBy("event_type").agg(F.count("*").alias("kept"), F.sum("bits").alias("bits"), F.max("u").alias("threshold"))


@query("flt_8_first_seeds", """SELECT scenario, method, seed FROM (SELECT *, dense_rank() OVER (PARTITION BY scenario ORDER BY seed) AS k FROM runs) WHERE k <= 5""", "runs")
def flt8(spark, sf):
    return P.first_n(V.runs(spark, sf), ["scenario"], "seed", 5).select("scenario", "method", "seed")


@query("flt_8_every_second_epoch", "SELECT link_id, count(*)::BIGINT AS n, sum(epoch)::BIGINT AS s FROM epochs5 WHERE (epoch // 4) % 2 = 0 GROUP BY link_id", "epochs5")
def flt8b(spark, sf):
    s = V.slots(spark, sf).where((F.col("slot") + 1) % 4 == 0).select("link_id", (F.col("slot") + 1).alias("epoch"))
    return s.where((F.col("epoch") / 4).cast("bigint") % 2 == 0).groupBy("link_id").agg(F.count("*").alias("n"), F.sum("epoch").alias("s"))


# --- scalar functions ------------------------------------------------------------------------------------------
_P = "((cell_id % 21) / 20.0)::DOUBLE"


@query("sc_1_inverse_cdf", f"SELECT link_id, cell_id, epoch, round({sql_interp('q', _P, True)} + 1e-9, 6) AS rate FROM fc5", "fc5")
def sc1(spark, sf):
    f = series.window_forecast(V.packed(spark, sf), V.FAST).where(observed())
    return f.select("link_id", "cell_id", "epoch", F.round(Q.inverse_cdf("q", (F.col("cell_id") % 21) / 20.0) + 1e-9, 6).alias("rate"))


@query("sc_2_interp", f"SELECT link_id, cell_id, epoch, round({sql_interp('q', _P, False)} + 1e-9, 6) AS rate FROM fc5", "fc5")
def sc2(spark, sf):
    f = series.window_forecast(V.packed(spark, sf), V.FAST).where(observed())
    return f.select("link_id", "cell_id", "epoch", F.round(Q.interp("q", (F.col("cell_id") % 21) / 20.0) + 1e-9, 6).alias("rate"))


@query("sc_3_shift_levels", "SELECT link_id, cell_id, epoch, " + ", ".join(
    f"round({sql_interp('q', f'least(greatest({a}::DOUBLE + -0.2::DOUBLE, 0.05), 0.95)', False)}, 6) AS q{i + 1}" for i, a in enumerate(_KNOTS))
    + " FROM fc5", "fc5")
def sc3(spark, sf):
    f = series.window_forecast(V.packed(spark, sf), V.FAST).where(observed()).withColumn("s", Q.shift_levels("q", F.lit(-0.2)))
    return f.select("link_id", "cell_id", "epoch", *[F.round(F.get("s", F.lit(i)), 6).alias(f"q{i + 1}") for i in range(6)])


@query("sc_4_mixture", """, m AS (SELECT link_id, epoch, unnest(list_transform(range(99), lambda g: CASE
      WHEN (g + 0.5) / 99 <= 0.25 THEN q[1] + ((g + 0.5) / 99 - 0.05) / (0.25 - 0.05) * (q[2] - q[1])
      WHEN (g + 0.5) / 99 <= 0.5 THEN q[2] + ((g + 0.5) / 99 - 0.25) / 0.25 * (q[3] - q[2])
      WHEN (g + 0.5) / 99 <= 0.75 THEN q[3] + ((g + 0.5) / 99 - 0.5) / 0.25 * (q[4] - q[3])
      WHEN (g + 0.5) / 99 <= 0.9 THEN q[4] + ((g + 0.5) / 99 - 0.75) / (0.9 - 0.75) * (q[5] - q[4])
      ELSE q[5] + ((g + 0.5) / 99 - 0.9) / (0.95 - 0.9) * (q[6] - q[5]) END)) AS v FROM fc5)
    SELECT link_id, epoch, """ + ", ".join(f"round(greatest(quantile_cont(v, {a}), 0.0) + 1e-9, 5) AS q{i + 1}" for i, a in enumerate(_KNOTS)) + " FROM m GROUP BY ALL", "fc5")
def sc4(spark, sf):
    f = series.window_forecast(V.packed(spark, sf), V.FAST).where(observed())
    return P.mixture(f, ["link_id", "epoch"], "q").select(
        "link_id", "epoch", *[F.round(F.get("q", F.lit(i)) + 1e-9, 5).alias(f"q{i + 1}") for i in range(6)])


@query("sc_5_nearest_level", """SELECT scenario, method, seed, list_position(d, list_min(d))::BIGINT - 1 AS level_index FROM (
    SELECT *, list_transform([0.05, 0.25, 0.5, 0.75, 0.9, 0.95]::DOUBLE[], lambda a: abs(a - wvr * 10)) AS d FROM runs)""", "runs")
def sc5(spark, sf):
    d = F.array(*[F.abs(F.lit(a) - F.col("wvr") * 10) for a in K.QUANTILE_LEVELS])
    return V.runs(spark, sf).withColumn("d", d).select("scenario", "method", "seed", (F.array_position("d", F.array_min("d")) - 1).alias("level_index"))


@query("sc_6_json_params", """SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k,
    coalesce(CAST(json_extract_string(props, '$.missing') AS DOUBLE), 0.5) AS missing,
    '{"k":' || (CAST(json_extract_string(props, '$.k') AS BIGINT) + 1) || ',"v":"' || event_type || '"}' AS rewritten FROM events""")
def sc6(spark, sf):
    e = V.table(spark, sf, "events")
    k = F.from_json("props", "k bigint")["k"]
    return e.select("event_id", F.coalesce(k, F.lit(-1)).alias("k"), S.json_param("props", "missing", 0.5).alias("missing"),
                    F.to_json(F.struct((k + 1).alias("k"), F.col("event_type").alias("v"))).alias("rewritten"))


@query("sc_7_run_key", """SELECT scenario, method, seed, method || '_' || printf('L%.3f', round(wvr, 3)) || '_s' || seed || '_sh' || list_aggregate([(seed % 3)::VARCHAR, n::VARCHAR], 'string_agg', '-') AS key FROM runs""", "runs")
def sc7(spark, sf):
    key = S.run_key("method", F.format_string("L%.3f", F.round("wvr", 3)), F.concat(F.lit("s"), F.col("seed").cast("string")),
                    F.concat(F.lit("sh"), F.array_join(F.array((F.col("seed") % 3).cast("string"), F.col("n").cast("string")), "-")))
    return V.runs(spark, sf).select("scenario", "method", "seed", key.alias("key"))


_SPELL = "regexp_replace(p_brand || '/' || p_name || p_size, '[^A-Za-z0-9]', '', 'g')"
for _d in range(10):
    _SPELL = f"replace({_SPELL}, '{_d}', '{K.DIGIT_WORDS[_d]}')"


@query("sc_8_spell_label", f"SELECT p_partkey, {_SPELL} AS label FROM part")
def sc8(spark, sf):
    label = F.concat("p_brand", F.lit("/"), "p_name", F.col("p_size").cast("string"))
    return V.table(spark, sf, "part").select("p_partkey", S.spell_label(label).alias("label"))


@query("sc_9_significance_mark", "SELECT scenario, method, seed, CASE WHEN embb < 0.01 THEN '**' WHEN embb < 0.05 THEN '*' ELSE '' END AS mark FROM runs", "runs")
def sc9(spark, sf):
    return V.runs(spark, sf).select("scenario", "method", "seed", S.significance_mark("embb").alias("mark"))


@query("sc_10_number_text", """SELECT o_orderkey, CASE WHEN v = 0 THEN '0' WHEN v > 0 THEN '+' || v ELSE v::VARCHAR END AS signed,
    printf('%.2f', round(o_totalprice / 777.0, 2)) || '±' || printf('%.2f', round(o_custkey / 7.0, 2)) AS pm
    FROM (SELECT *, CAST(round_even((o_orderkey % 13 - 6) / 2.0, 0) AS BIGINT) AS v FROM orders)""")
def sc10(spark, sf):
    o = V.table(spark, sf, "orders")
    return o.select("o_orderkey", S.signed_int((F.col("o_orderkey") % 13 - 6) / 2.0).alias("signed"),
                    S.mean_pm_std(F.col("o_totalprice") / 777.0, F.col("o_custkey") / 7.0).alias("pm"))


@query("sc_11_decibel_efficiency", """SELECT l_orderkey, l_linenumber, round(sum(10 * log10(x)), 6) AS db, round(sum(pow(10, x / 100 / 10)), 6) AS lin,
    round(sum(CASE WHEN 10 * log10(greatest(x / 20, 1e-12)) < -10 THEN 0.0 ELSE least(0.6 * log2(1 + x / 20), 5.5547) END), 6) AS se
    FROM (SELECT l_orderkey, l_linenumber, l_quantity / l_linenumber AS x FROM lineitem) GROUP BY ALL""")
def sc11(spark, sf):
    x = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / F.col("l_linenumber")).alias("x"))
    return x.groupBy("l_orderkey", "l_linenumber").agg(
        F.round(F.sum(S.to_db("x")), 6).alias("db"), F.round(F.sum(S.from_db(F.col("x") / 100)), 6).alias("lin"),
        F.round(F.sum(S.attenuated_shannon(F.col("x") / 20)), 6).alias("se"))


@query("sc_12_one_hot", "SELECT DISTINCT cell_id, " + ", ".join(f"(class = {i})::INT::DOUBLE AS cell_{i}" for i in range(8)) + " FROM slots", "slots")
def sc12(spark, sf):
    c = V.slots(spark, sf).select("cell_id").distinct()
    return c.select("cell_id", *[(F.col("cell_id") % 8 == i).cast("double").alias(f"cell_{i}") for i in range(8)])
