"""Sources, sinks, joins, set operations and ranked picks."""
from __future__ import annotations


from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scalars as S
from ..operators import allocation as A, predicates as P, relational as R, series
from ..session import shared_dir
from ..sources import dims, tables
from . import views as V
from .registry import query


def scratch(spark, name: str) -> str:
    """A directory of its own below the shared folder of the cluster."""
    import uuid
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def r(name, n=6):
    return F.round(name, n).alias(name)


# --- sources and sinks -------------------------------------------------------------------------------------
@query("src_1_trace_scan", "SELECT cell_id, count(*)::BIGINT AS slots, sum(fh_bits)::BIGINT AS bits FROM slots WHERE class = 3 GROUP BY cell_id", "slots")
def src1(spark, sf):
    """Write the series partitioned by class, read one partition back (directory pruning)."""
    path = scratch(spark, "traces")
    tables.write_traces(V.slots(spark, sf).select("cell_id", "class", "slot", "fh_bits"), path, ["class"])
    return tables.read_traces(spark, path, **{"class": 3}).groupBy("cell_id").agg(
        F.count("*").alias("slots"), F.sum("fh_bits").alias("bits"))


@query("src_2_run_records", "SELECT scenario, method, cell, round(x, 6) AS x, n FROM (SELECT scenario, method, seed AS cell, wvr AS x, n FROM runs)", "runs")
def src2(spark, sf):
    """Nested run documents (per-cell arrays inside) -> one row per (run, cell)."""
    path = scratch(spark, "records")
    docs = V.runs(spark, sf).groupBy("scenario", "method").agg(F.sort_array(F.collect_list(F.struct("seed", "wvr", "n"))).alias("c"))
    docs = docs.select("scenario", "method", F.col("c.seed").alias("seed"), F.col("c.wvr").alias("x"), F.col("c.n").alias("n"))
    tables.write_documents(docs, path, ["scenario", "method"])
    back = tables.read_documents(spark, path, "seed array<bigint>, x array<double>, n array<bigint>")
    cells = tables.explode_cells(back, ["scenario", "method"], ["seed", "x", "n"])
    return cells.select("scenario", "method", F.col("seed").alias("cell"), r("x"), "n")


@query("src_2_indented_records", "SELECT scenario, method, cell, round(x, 6) AS x, n FROM (SELECT scenario, method, seed AS cell, wvr AS x, n FROM runs)", "runs")
def src2_indented(spark, sf):
    """The same from documents that span several lines, one in a file."""
    path = scratch(spark, "indented")
    docs = V.runs(spark, sf).groupBy("scenario", "method").agg(F.sort_array(F.collect_list(F.struct("seed", "wvr", "n"))).alias("c"))
    docs = docs.select("scenario", "method", F.col("c.seed").alias("seed"), F.col("c.wvr").alias("x"), F.col("c.n").alias("n"))
    tables.write_documents(docs, path, ["scenario", "method"], pretty=True)
    back = tables.read_documents(spark, path, "seed array<bigint>, x array<double>, n array<bigint>", multi_line=True)
    cells = tables.explode_cells(back, ["scenario", "method"], ["seed", "x", "n"])
    return cells.select("scenario", "method", F.col("seed").alias("cell"), r("x"), "n")


@query("src_3_run_csv", "SELECT scenario, method, seed, round(wvr, 6) AS wvr, round(vr, 6) AS vr, n FROM runs", "runs")
def src3(spark, sf):
    path = scratch(spark, "csv")
    tables.write_csv(V.runs(spark, sf), path)
    absent = tables.read_csv(spark, path + "-absent", tables.RUN_SCHEMA)
    return tables.read_csv(spark, path, tables.RUN_SCHEMA).unionByName(absent).select("scenario", "method", "seed", r("wvr"), r("vr"), "n")


@query("src_4_dimensions", """SELECT c.class, c.name, c.deadline, c.priority, round(c.se, 6) AS se, s.scenario, s.family, s.load, count(*)::BIGINT AS cells
    FROM classes c JOIN (SELECT DISTINCT l_suppkey FROM lineitem) l ON l.l_suppkey % 8 = c.class CROSS JOIN scenarios s GROUP BY ALL""", "classes scenarios")
def src4(spark, sf):
    cells = V.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("cell_id")).distinct()
    per = cells.groupBy((F.col("cell_id") % 8).alias("class")).agg(F.count("*").alias("cells"))
    return per.join(F.broadcast(dims.cell_classes(spark)), "class").crossJoin(F.broadcast(dims.scenarios(spark))).select(
        "class", "name", "deadline", "priority", F.round("se", 6).alias("se"), "scenario", "family", "load", "cells")


@query("src_5_event_slots", "SELECT cell_id, slot, bits FROM event_slots", "event_slots")
def src5(spark, sf):
    e = V.table(spark, sf, "events").select(F.col("user_id").alias("cell_id"), "ts", F.round(F.col("value") * 100).alias("bits"))
    return series.slot_events(e, ["cell_id"], "ts", "bits", "2024-01-01", 3600)


@query("snk_1_trace_write_once", "SELECT class, count(*)::BIGINT AS n, sum(fh_bits)::BIGINT AS bits FROM slots GROUP BY class", "slots")
def snk1(spark, sf):
    """A second write of other values leaves the partitions that are there alone."""
    path = scratch(spark, "once")
    s = V.slots(spark, sf).select("class", "cell_id", "slot", "fh_bits")
    tables.write_traces(s.where("class < 5"), path, ["class"])
    tables.write_traces(s.withColumn("fh_bits", F.when(F.col("class") < 5, F.lit(0).cast("bigint")).otherwise(F.col("fh_bits"))), path, ["class"])
    return spark.read.parquet(path).groupBy(F.col("class").cast("bigint").alias("class")).agg(F.count("*").alias("n"), F.sum("fh_bits").alias("bits"))


_UP = """SELECT scenario, method, seed, round(CASE WHEN seed < 5 THEN wvr * 2 ELSE wvr END, 6) AS wvr, CASE WHEN seed < 5 THEN 'new' END AS tag FROM runs"""


@query("snk_2_upsert", _UP, "runs")
def snk2(spark, sf):
    old = V.runs(spark, sf).select("scenario", "method", "seed", "wvr")
    new = old.where("seed < 5").select("scenario", "method", "seed", (F.col("wvr") * 2).alias("wvr"), F.lit("new").alias("tag"))
    return tables.upsert(old, new, ["scenario", "method", "seed"]).select("scenario", "method", "seed", r("wvr"), "tag")


@query("snk_2_versioned_upsert", _UP, "runs")
def snk2b(spark, sf):
    path = scratch(spark, "runs")
    old = V.runs(spark, sf).select("scenario", "method", "seed", "wvr", F.lit(None).cast("string").alias("tag"))
    new = old.where("seed < 5").select("scenario", "method", "seed", (F.col("wvr") * 2).alias("wvr"), F.lit("new").alias("tag"))
    tables.write_upsert(spark, path, old, ["scenario", "method", "seed"], "0001")
    tables.write_upsert(spark, path, new, ["scenario", "method", "seed"], "0002")
    return tables.read_current(spark, path, old.schema).select("scenario", "method", "seed", r("wvr"), "tag")


@query("snk_3_summary_csv", "SELECT scenario, method, round(avg(wvr), 6) AS wvr_mean, count(*)::BIGINT AS n FROM runs GROUP BY ALL", "runs")
def snk3(spark, sf):
    path = scratch(spark, "summary")
    tables.write_csv(V.runs(spark, sf).groupBy("scenario", "method").agg(F.round(F.avg("wvr"), 6).alias("wvr_mean"), F.count("*").alias("n")), path)
    return tables.read_csv(spark, path, "scenario string, method string, wvr_mean double, n bigint")


@query("snk_4_run_documents", "SELECT scenario, method, seed, round(wvr, 6) AS wvr, n FROM runs", "runs")
def snk4(spark, sf):
    path = scratch(spark, "docs")
    tables.write_documents(V.runs(spark, sf).select("scenario", "method", "seed", F.round("wvr", 6).alias("wvr"), "n"), path, ["scenario", "method"])
    return tables.read_documents(spark, path, "seed bigint, wvr double, n bigint")


@query("snk_5_series_side_by_side", """SELECT cell_id, slot, sum(arrived) FILTER (flag = 'A')::BIGINT AS a, sum(arrived) FILTER (flag = 'N')::BIGINT AS n, sum(arrived) FILTER (flag = 'R')::BIGINT AS r
    FROM (SELECT l_suppkey AS cell_id, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) // 7 AS slot, l_returnflag AS flag, CAST(round(l_quantity) AS BIGINT) AS arrived FROM lineitem) GROUP BY ALL""")
def snk5(spark, sf):
    path = scratch(spark, "series")
    week = F.floor(F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")) / 7).cast("bigint")
    li = V.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("cell_id"), week.alias("slot"), F.col("l_returnflag").alias("method"),
                                               F.round("l_quantity").cast("bigint").alias("arrived"))
    tables.write_traces(li.groupBy("cell_id", "slot", "method").agg(F.sum("arrived").alias("arrived")), path, ["method"])
    return spark.read.parquet(path).groupBy("cell_id", "slot").pivot("method", ["A", "N", "R"]).agg(F.sum("arrived")).select(
        "cell_id", "slot", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r"))


# --- joins ---------------------------------------------------------------------------------------------------
@query("jn_1_cell_dimension", "SELECT c.name, c.deadline, count(*)::BIGINT AS rows, sum(fh_bits * c.priority)::DOUBLE AS weighted FROM hits h JOIN classes c ON c.class = h.cell_id % 8 GROUP BY ALL", "hits classes")
def jn1(spark, sf):
    return dims.with_cells(V.hits(spark, sf), dims.cell_classes(spark)).groupBy("name", "deadline").agg(
        F.count("*").alias("rows"), F.sum(F.col("fh_bits") * F.col("priority")).alias("weighted"))


@query("jn_2_point_in_time", """, st AS (SELECT cell_id, slot, fh_bits * 2 AS queue, slot % 5 AS hol FROM slots),
    e AS (SELECT cell_id, slot AS epoch, greatest(slot - 2, 0) AS obs_slot FROM slots WHERE slot % 20 = 0)
    SELECT e.cell_id, e.epoch, e.obs_slot, round(s.se, 6) AS se, coalesce(st.queue, 0) AS queue, coalesce(st.hol, 0) AS hol
    FROM e JOIN slots s ON s.cell_id = e.cell_id AND s.slot = e.obs_slot LEFT JOIN st ON st.cell_id = e.cell_id AND st.slot = e.obs_slot - 1""", "slots")
def jn2(spark, sf):
    s = V.slots(spark, sf).select("cell_id", "slot", "se", "fh_bits")
    st = s.select("cell_id", "slot", (F.col("fh_bits") * 2).alias("queue"), (F.col("slot") % 5).alias("hol"))
    return R.delayed_state(s, st, ["cell_id"], 20, 2).select("cell_id", "epoch", "obs_slot", r("se"), "queue", "hol")


@query("jn_2_as_of_events", """, d AS (SELECT DISTINCT cell_id, (h.h * 6 + 3) * 3600000000 AS t FROM event_hits CROSS JOIN range((SELECT max(slot) // 6 + 1 FROM event_hits)) h(h)),
    ev AS (SELECT user_id AS cell_id, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS t, max(round(value * 100))::BIGINT AS v FROM events GROUP BY ALL)
    SELECT d.cell_id, d.t, e.v FROM d ASOF LEFT JOIN ev e ON d.cell_id = e.cell_id AND d.t > e.t""", "event_hits")
def jn2b(spark, sf):
    us = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    ev = (V.table(spark, sf, "events").select(F.col("user_id").alias("cell_id"), us.alias("t"), F.round(F.col("value") * 100).cast("bigint").alias("v"))
          .groupBy("cell_id", "t").agg(F.max("v").alias("v")))
    last = series.span(V.event_hits(spark, sf).select("slot")) - 1
    d = ev.select("cell_id").distinct().select("cell_id", F.explode(F.sequence(F.lit(0), F.lit(last // 6))).alias("h")).select(
        "cell_id", ((F.col("h") * 6 + 3) * F.lit(3_600_000_000)).alias("t"))
    return R.last_before(d, ev, ["cell_id"], "t", "v", 5 * 86_400_000_000)


@query("jn_3_epoch_labels", "SELECT f.link_id, f.cell_id, f.epoch, round(f.lag_mean, 6) AS lag_mean, round(r.rate, 6) AS label FROM feat5 f JOIN roll5 r ON r.cell_id = f.cell_id AND r.e = f.epoch + 4 WHERE f.obs_slot >= 35", "feat5 roll5")
def jn3(spark, sf):
    """Features at the observation slot joined with rates of the window that ends with the epoch."""
    rates = V.rates(spark, sf)
    feats = series.features(rates, V.FAST).where(series.enough_history(V.FAST)).select("link_id", "cell_id", "epoch", "lag_mean")
    labels = rates.where(series.owned(V.FAST.chunk)).select("link_id", "cell_id", (F.col("slot") + 1 - V.FAST.interval).alias("epoch"), F.col("rate").alias("label"))
    return feats.join(labels, ["link_id", "cell_id", "epoch"]).select("link_id", "cell_id", "epoch", r("lag_mean"), r("label"))


@query("jn_4_interval_join", """, b AS (SELECT cell_id, slot AS epoch, fh_bits + 10 AS budget FROM slots WHERE slot % 20 = 0)
    SELECT s.cell_id, b.epoch, sum(least(s.fh_bits, b.budget))::BIGINT AS used, count(*)::BIGINT AS slots FROM slots s JOIN b ON b.cell_id = s.cell_id AND s.slot >= b.epoch AND s.slot < b.epoch + 20 GROUP BY ALL""", "slots")
def jn4(spark, sf):
    s = V.slots(spark, sf).select("cell_id", "slot", "fh_bits")
    b = s.where("slot % 20 = 0").select("cell_id", F.col("slot").alias("epoch"), (F.col("fh_bits") + 10).alias("budget"))
    return R.spread_budgets(s, b, ["cell_id"], 20).groupBy("cell_id", "epoch").agg(F.sum(F.least("fh_bits", "budget")).alias("used"), F.count("*").alias("slots"))


@query("jn_5_paired_join", """SELECT b.scenario, b.method AS baseline, b.seed, round(b.wvr - r.wvr, 6) AS diff FROM runs b JOIN runs r ON r.scenario = b.scenario AND r.seed = b.seed
    AND r.method = 'BUILDING' WHERE b.method != 'BUILDING'""", "runs")
def jn5(spark, sf):
    return R.paired(V.runs(spark, sf), "BUILDING", "wvr").select("scenario", "baseline", "seed", r("diff"))


@query("jn_6_anti_join", "SELECT scenario, method, seed FROM runs WHERE method NOT IN ('MACHINERY') AND NOT (scenario = '1-URGENT' AND seed < 3)", "runs")
def jn6(spark, sf):
    runs = V.runs(spark, sf)
    ref_only = dims.grid(spark, "method", ["MACHINERY"], "string")
    replaced = runs.where("scenario = '1-URGENT' and seed < 3").select("scenario", "method", "seed").distinct()
    return runs.join(F.broadcast(ref_only), "method", "left_anti").join(replaced, ["scenario", "method", "seed"], "left_anti").select("scenario", "method", "seed")


@query("jn_7_semi_join", "SELECT scenario, method, seed FROM runs WHERE scenario IN ('1-URGENT', '2-HIGH') AND method IN (SELECT method FROM runs GROUP BY method HAVING avg(wvr) > 0.05)", "runs")
def jn7(spark, sf):
    runs = V.runs(spark, sf)
    sc = dims.grid(spark, "scenario", ["1-URGENT", "2-HIGH"], "string")
    heavy = runs.groupBy("method").agg(F.avg("wvr").alias("m")).where("m > 0.05").select("method")
    return runs.join(F.broadcast(sc), "scenario", "left_semi").join(heavy, "method", "left_semi").select("scenario", "method", "seed")


_CQI = ", ".join(f"({x}::DOUBLE)" for x in K.CQI_EFFICIENCY)


@query("jn_8_band_lookup", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(x, 6) AS x, coalesce((SELECT max(t.v) FROM (VALUES {_CQI}) t(v) WHERE t.v <= x), 0.0) AS level
    FROM (SELECT *, CASE WHEN 10 * log10(s) < -10 THEN 0.0 ELSE least(0.6 * log2(1 + s), 5.5547) END AS x FROM (SELECT *, l_quantity * l_quantity / (l_linenumber * 3 + l_extendedprice / 1000) AS s FROM lineitem))""")
def jn8(spark, sf):
    s = F.col("l_quantity") * F.col("l_quantity") / (F.col("l_linenumber") * 3 + F.col("l_extendedprice") / 1000)
    li = V.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.attenuated_shannon(s).alias("x"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("x", 6).alias("x"), R.band_lookup(F.col("x")).alias("level"))


@query("jn_9_parameter_grid", """SELECT scenario, method, seed, m AS margin, w AS win, n, round(n * m + w, 6) AS score FROM runs CROSS JOIN (VALUES (0.0::DOUBLE), (0.25), (0.5)) a(m) CROSS JOIN (VALUES (20), (60)) b(w)""", "runs")
def jn9(spark, sf):
    g = dims.grid(spark, "margin", [0.0, 0.25, 0.5]).crossJoin(dims.grid(spark, "win", [20, 60], "int"))
    return V.runs(spark, sf).crossJoin(F.broadcast(g)).select(
        "scenario", "method", "seed", "margin", "win", "n", F.round(F.col("n") * F.col("margin") + F.col("win"), 6).alias("score"))


@query("jn_10_theta_pairs", """SELECT cell_id, horizon, round(max((b.cs - a.cs) / (b.slot - a.slot + a.deadline)::DOUBLE), 6) AS rstar FROM
    (SELECT p.*, h.h AS horizon FROM pre p JOIN range((SELECT CAST(max(slot) // 22 + 1 AS BIGINT) FROM pre)) h(h) ON p.slot BETWEEN h.h * 22 AND h.h * 22 + 21) a JOIN pre b USING (cell_id)
    WHERE b.slot > a.slot AND b.slot <= horizon * 22 + 22 GROUP BY ALL""", "pre")
def jn10(spark, sf):
    """Rates of fixed horizons by the array expression (the theta join is the check)."""
    from ..functions.demand import required_rate
    h = V.slots(spark, sf).groupBy("cell_id", F.floor(F.col("slot") / 22).alias("horizon")).agg(
        F.first("deadline").alias("deadline"), F.sort_array(F.collect_list(F.struct("slot", "fh_bits"))).alias("a"))
    return h.select("cell_id", "horizon", F.round(required_rate(F.col("a.fh_bits").cast("array<double>"), "deadline"), 6).alias("rstar"))


@query("jn_11_chosen_on_validation", """, v AS (SELECT scenario, method, avg(wvr) AS m FROM runs WHERE seed < 10 GROUP BY ALL),
    c AS (SELECT scenario, arg_min(method, m) AS method FROM v GROUP BY scenario)
    SELECT c.scenario, c.method, round(avg(r.wvr), 6) AS test_wvr, count(*)::BIGINT AS n FROM c JOIN runs r ON r.scenario = c.scenario AND r.method = c.method AND r.seed >= 10 GROUP BY ALL""", "runs")
def jn11(spark, sf):
    runs = V.runs(spark, sf)
    val = runs.where("seed < 10").groupBy("scenario", "method").agg(F.avg("wvr").alias("m"))
    chosen = R.best_by(val, ["scenario"], "m", ["method"], ["method"]).select("scenario", "method")
    return runs.where("seed >= 10").join(chosen, ["scenario", "method"]).groupBy("scenario", "method").agg(
        F.round(F.avg("wvr"), 6).alias("test_wvr"), F.count("*").alias("n"))


@query("jn_12_method_gap", """, m AS (SELECT scenario, method, avg(wvr) AS v FROM runs GROUP BY ALL)
    SELECT a.scenario, round(100 * (a.v - b.v) / a.v, 6) AS gap_pct FROM m a JOIN m b USING (scenario) WHERE a.method = 'BUILDING' AND b.method = 'MACHINERY'""", "runs")
def jn12(spark, sf):
    m = V.runs(spark, sf).groupBy("scenario", "method").agg(F.avg("wvr").alias("v"))
    return R.method_gap(m, "BUILDING", "MACHINERY", "v").select("scenario", r("gap_pct"))


@query("jn_13_same_rows", """, s AS (SELECT d.link_id, abs(d.label - d.q[3]) AS e1, abs(d.label - d.persist) AS e2 FROM dec d)
    SELECT link_id, round(avg(e1), 6) AS window_mae, round(avg(e2), 6) AS persist_mae, count(*)::BIGINT AS n FROM s GROUP BY link_id""", "dec")
def jn13(spark, sf):
    """Two forecasts scored on identical rows: predictions meet on the row key before either is scored."""
    rates, n = V.rates(spark, sf), V.weeks(spark, sf)
    key = ["link_id", "cell_id", "epoch"]
    a = series.window_forecast(V.packed(spark, sf, n=n), V.FAST).where(V.full_epochs(n)).select(*key, A.median_of().alias("p1"))
    b = series.features(rates, V.FAST).where(V.full_epochs(n)).select(*key, F.col("rstar_lag_1").alias("p2"), "label")
    return a.join(b, key).groupBy("link_id").agg(F.round(F.avg(F.abs(F.col("label") - F.col("p1"))), 6).alias("window_mae"),
                                                 F.round(F.avg(F.abs(F.col("label") - F.col("p2"))), 6).alias("persist_mae"), F.count("*").alias("n"))


@query("jn_14_union_new_wins", """, n AS (SELECT scenario, method, seed, wvr + 1 AS wvr FROM runs WHERE method = 'BUILDING' AND seed < 7)
    SELECT scenario, method, seed, round(wvr, 6) AS wvr FROM n UNION ALL SELECT scenario, method, seed, round(wvr, 6) FROM runs r
    WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.scenario = r.scenario AND n.method = r.method AND n.seed = r.seed)""", "runs")
def jn14(spark, sf):
    old = V.runs(spark, sf).select("scenario", "method", "seed", "wvr")
    new = old.where("method = 'BUILDING' and seed < 7").withColumn("wvr", F.col("wvr") + 1)
    return old.join(new, ["scenario", "method", "seed"], "left_anti").unionByName(new).select("scenario", "method", "seed", r("wvr"))


# --- ranked picks --------------------------------------------------------------------------------------------
_ORDER = ["MACHINERY", "BUILDING", "AUTOMOBILE"]


@query("tk_1_custom_order", """SELECT scenario, method, CASE method WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'AUTOMOBILE' THEN 3 ELSE 4 END::BIGINT AS rank, round(avg(wvr), 6) AS wvr FROM runs GROUP BY ALL ORDER BY scenario, rank, method""", "runs")
def tk1(spark, sf):
    g = V.runs(spark, sf).groupBy("scenario", "method").agg(F.round(F.avg("wvr"), 6).alias("wvr"))
    return R.ordered_by(g, "method", _ORDER).orderBy("scenario", "rank", "method")


@query("tk_2_best_params", """, g AS (SELECT method, seed % 6 AS params, avg(wvr) AS v FROM runs GROUP BY ALL)
    SELECT method, params, round(v, 6) AS v FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY v, params) AS k FROM g) WHERE k = 1""", "runs")
def tk2(spark, sf):
    g = V.runs(spark, sf).groupBy("method", (F.col("seed") % 6).alias("params")).agg(F.avg("wvr").alias("v"))
    return R.best_by(g, ["method"], "v", ["params"], ["params"]).select("method", "params", r("v"))


@query("tk_3_elite", "SELECT scenario, method, seed, rank FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY wvr, method, seed)::INT AS rank FROM runs) WHERE rank <= 4", "runs")
def tk3(spark, sf):
    return R.smallest_k(V.runs(spark, sf), ["scenario"], "wvr", 4, ["method", "seed"]).select("scenario", "method", "seed", "rank")


@query("tk_4_top_energy", """, e AS (SELECT pos, sum(x * x) AS energy FROM coords GROUP BY pos), k AS (SELECT pos FROM e ORDER BY energy DESC, pos LIMIT 16)
    SELECT c.id, round(sum(CASE WHEN k.pos IS NOT NULL THEN x * x ELSE 0 END), 9) AS kept, round(sum(x * x), 9) AS total FROM coords c LEFT JOIN k ON k.pos = c.pos GROUP BY c.id""", "coords")
def tk4(spark, sf):
    """Coefficients with the most energy over the whole table, the others zeroed."""
    from ..operators import compression as C
    z = C.keep_top_positions(V.vectors(spark, sf), 16)
    sq = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x), 9)
    return z.select("id", sq("kept").alias("kept"), sq("vec").alias("total"))


@query("tk_5_sorted_summary", "SELECT dim, method, round(avg(ms), 4) AS mean_ms FROM bench_rows GROUP BY ALL ORDER BY dim, mean_ms", "bench_rows")
def tk5(spark, sf):
    return V.bench_rows(spark, sf).groupBy("dim", "method").agg(F.round(F.avg("ms"), 4).alias("mean_ms")).orderBy("dim", "mean_ms")


# --- sets -----------------------------------------------------------------------------------------------------
@query("so_1_bag_union", "SELECT scenario, method, seed, round(wvr, 6) AS wvr, NULL::DOUBLE AS vr FROM runs UNION ALL SELECT scenario, method, seed, NULL, round(vr, 6) FROM runs WHERE seed < 10", "runs")
def so1(spark, sf):
    runs = V.runs(spark, sf)
    return runs.select("scenario", "method", "seed", r("wvr")).unionByName(runs.where("seed < 10").select("scenario", "method", "seed", r("vr")), allowMissingColumns=True)


@query("so_2_division", """SELECT c_mktsegment AS method FROM (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer)
    WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 4) GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM nation WHERE n_regionkey < 4)""")
def so2(spark, sf):
    c = V.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("method"), F.col("c_nationkey").alias("key"))
    need = V.table(spark, sf, "nation").where("n_regionkey < 4").select(F.col("n_nationkey").alias("key"))
    return R.present_everywhere(c, need, "method", "key")


@query("so_3_key_difference", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def so3(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return o.where("o_orderstatus = 'F'").select("k").distinct().join(o.where("o_orderstatus = 'O'").select("k"), "k", "left_anti")


@query("so_4_key_intersection", "SELECT scenario, seed FROM runs WHERE method = 'BUILDING' INTERSECT SELECT scenario, seed FROM runs WHERE method = 'MACHINERY'", "runs")
def so4(spark, sf):
    runs = V.runs(spark, sf)
    return runs.where("method = 'BUILDING'").select("scenario", "seed").intersect(runs.where("method = 'MACHINERY'").select("scenario", "seed"))
