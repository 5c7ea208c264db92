"""Forecast data preparation, models and vector compression."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import scalars as S
from ..operators import boosting as B, compression as C, phases as PH, scoring as SC, series, training as TR
from ..sources import dims
from . import views as V
from .q_relational import scratch
from .q_reports import score_sql
from .registry import query

ID = ["link_id", "cell_id", "epoch"]
NAMES = TR.feature_columns(V.FAST)
ALL = NAMES + ["se_rel", "deadline_rel"] + [f"cell_{i}" for i in range(8)]


def r(name, n=6):
    return F.round(name, n).alias(name)


_TRAIN = (", ".join(f"{c} / 150.0 AS {c}" for c in NAMES) + ", 1.0::DOUBLE AS se_rel, deadline / 5.0::DOUBLE AS deadline_rel, "
          + ", ".join(f"(cell_id % 8 = {i})::INT::DOUBLE AS cell_{i}" for i in range(8)) + ", label / 150.0 AS y")
_TR = f", tr AS (SELECT link_id, cell_id, epoch, {_TRAIN} FROM feat5 WHERE obs_slot >= 35 AND epoch < (SELECT n FROM weeks) - 4)"


def train(spark, sf, sustain=False):
    return TR.training_table(V.epochs_features(spark, sf), V.FAST, F.lit(V.CELL_CAP), V.weeks(spark, sf), sustain)


@query("ml_1_training_table", _TR + "SELECT link_id, cell_id, epoch, " + ", ".join(f"round({c}, 6) AS {c}" for c in ALL + ["y"]) + " FROM tr", "feat5")
def ml1(spark, sf):
    """Written once as parquet, read back."""
    path = scratch(spark, "train")
    train(spark, sf).write.parquet(path)
    return spark.read.parquet(path).select(*ID, *[r(c) for c in ALL + ["y"]])


@query("ml_1_training_table_sustain", "SELECT link_id, cell_id, epoch, round(greatest(label, label_mean) / 150.0, 6) AS y FROM feat5 WHERE obs_slot >= 35 AND epoch < (SELECT n FROM weeks) - 4", "feat5")
def ml1b(spark, sf):
    return train(spark, sf, True).select(*ID, r("y"))


@query("ml_2_sequence_table", _TR + """, p AS (SELECT o.link_id, o.cell_id, o.epoch, sum(r.rate / 150.0 * (16 - k.k)) AS ps FROM epochs5 o CROSS JOIN range(16) k(k)
      JOIN roll5 r ON r.cell_id = o.cell_id AND r.e = o.obs_slot - k.k * 5 WHERE o.obs_slot >= 80 GROUP BY ALL)
    SELECT link_id, epoch, count(*)::BIGINT AS cells, round(sum(ps), 4) AS patch_sum, round(sum(lag_mean), 4) AS x_sum, round(sum(y), 4) AS y_sum FROM tr JOIN p USING (link_id, cell_id, epoch) GROUP BY ALL""", "feat5 epochs5 roll5")
def ml2(spark, sf):
    p = series.patches(V.packed(spark, sf), V.CELL_CAP, V.FAST).where(F.col("obs_slot") >= K.NUM_PATCHES * V.FAST.horizon)
    s = TR.sequence_table(p, train(spark, sf), ALL)

    def total(a):
        return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)

    per_cell = F.transform("patches", lambda ps: F.aggregate(F.transform(ps, lambda t: t["rate"] * (t["idx"] + 1)), F.lit(0.0), lambda a, x: a + x))
    return s.select("link_id", "epoch", F.size("cells").cast("bigint").alias("cells"), F.round(total(per_cell), 4).alias("patch_sum"),
                    F.round(total(F.transform("x", lambda v: v[6].cast("double"))), 4).alias("x_sum"), F.round(total(F.transform("y", lambda v: v.cast("double"))), 4).alias("y_sum"))


@query("ml_3_quantile_boosting")
def ml3(spark, sf):
    """Fit at full strength on the first 60 % of the epochs, score the rest."""
    t = train(spark, sf).select(*ID, *ALL, "y")
    path = scratch(spark, "boost")
    t.write.parquet(path)
    t = spark.read.parquet(path)
    cut = F.lit(0.6 * (t.agg(F.max("epoch")).first()[0] or 0))
    models = B.fit(t.where(F.col("epoch") < cut), ALL)
    s = B.score_arrow(t.where(F.col("epoch") >= cut), models, ALL)
    return SC.forecast_scores(s.withColumn("grp", F.col("cell_id") % 8 < 3), ["grp"], "y", "q")


# a small ensemble made by rule: level, tree and node numbers give features and thresholds
_FOREST = [{"level": a, "base": 0.02 + 0.05 * i, "trees": [[
    {"feature": (i + 3 * t) % 11, "threshold": 0.1 + 0.03 * t, "left": 1, "right": 2}, {"feature": (i + t + 5) % 11, "threshold": 0.05 + 0.02 * i, "left": 3, "right": 4},
    {"value": 0.03 * (t + 1)}, {"value": -0.01 * (i + 1)}, {"value": 0.015 * (t + i)}] for t in range(4)]} for i, a in enumerate(K.QUANTILE_LEVELS)]


def _tree_sql(tree, node=0):
    n = tree[node]
    if "value" in n:
        return f"{n['value']!r}::DOUBLE"
    return f"CASE WHEN {NAMES[n['feature']]} <= {n['threshold']!r}::DOUBLE THEN {_tree_sql(tree, n['left'])} ELSE {_tree_sql(tree, n['right'])} END"


_ENS = "list_sort([" + ", ".join("greatest(" + " + ".join([f"{m['base']!r}::DOUBLE"] + [_tree_sql(t) for t in m["trees"]]) + ", 0.0)" for m in _FOREST) + "])"
_ENS_SQL = _TR + f"SELECT link_id, cell_id, epoch, " + ", ".join(f"round(q[{i}], 6) AS q{i}" for i in range(1, 7)) + f" FROM (SELECT *, {_ENS} AS q FROM tr)"


@query("ml_4_ensemble_scoring", _ENS_SQL, "feat5")
def ml4(spark, sf):
    s = B.score_columns(train(spark, sf), _FOREST, NAMES)
    return s.select(*ID, *[F.round(F.get("q", F.lit(i)), 6).alias(f"q{i + 1}") for i in range(6)])


@query("ml_4_ensemble_scoring_arrow", _ENS_SQL, "feat5")
def ml4b(spark, sf):
    s = B.score_arrow(train(spark, sf), _FOREST, NAMES)
    return s.select(*ID, *[F.round(F.get("q", F.lit(i)), 6).alias(f"q{i + 1}") for i in range(6)])


@query("ml_5_window_forecast_scores", """, e AS (SELECT link_id, cell_id, slot AS o, slot + 2 AS epoch FROM slots WHERE slot >= 154 AND (slot - 154) % 20 = 0 AND slot + 2 < (SELECT n FROM weeks) - 20),
    f AS (SELECT e.link_id, e.cell_id, e.epoch, e.o, list_transform(quantile_cont(r.rate, [0.05, 0.25, 0.5, 0.75, 0.9, 0.95]), lambda v: v / 150.0) AS q FROM e JOIN roll22 r ON r.cell_id = e.cell_id AND r.e <= e.o AND r.e >= 22 AND (e.o - r.e) % 22 = 0 AND r.e > e.o - 660 GROUP BY ALL),
    fy AS (SELECT f.*, l.rate / 150.0 AS y FROM f JOIN roll22 l ON l.cell_id = f.cell_id AND l.e = f.o + 22) """ + score_sql("fy", "link_id"), "slots roll22")
def ml5(spark, sf):
    """The evaluation protocol: epochs every T slots from 7 H + tau on."""
    clock = series.Clock(20, 2, (7 * 22 + 2) % 20)
    rates = V.rates(spark, sf, clock)
    q = series.window_forecast(V.packed(spark, sf, clock), clock).where((F.col("obs_slot") >= 154) & (F.col("epoch") < V.weeks(spark, sf) - 20))
    y = rates.where(series.owned(clock.chunk)).select("link_id", "cell_id", (F.col("slot") + 1 - 20).alias("epoch"), (F.col("rate") / V.CELL_CAP).alias("y"))
    j = q.join(y, ID).withColumn("q", F.transform("q", lambda v: v / V.CELL_CAP))
    return SC.forecast_scores(j, ["link_id"], "y", "q")


@query("ml_6_phase_forecast", """, cut AS (SELECT n * 5 // 8 AS c FROM weeks), cuts AS (SELECT cell_id, quantile_cont(fh_bits, 0.45) AS c1, quantile_cont(fh_bits, 0.85) AS c2 FROM slots WHERE slot < (SELECT c FROM cut) - 5 GROUP BY cell_id),
    ph AS (SELECT s.cell_id, s.slot, (c1 <= fh_bits)::INT + (c2 <= fh_bits)::INT AS phase FROM slots s JOIN cuts USING (cell_id)),
    st AS (SELECT o.cell_id, o.epoch, ph.phase, r.rate FROM epochs5 o JOIN ph ON ph.cell_id = o.cell_id AND ph.slot = o.obs_slot - 1 JOIN roll5 r ON r.cell_id = o.cell_id AND r.e = o.obs_slot + 5),
    fit AS (SELECT cell_id, phase, quantile_cont(rate, [0.05, 0.25, 0.5, 0.75, 0.9, 0.95]) AS q, count(*) AS seen FROM st WHERE epoch + 4 <= (SELECT c FROM cut) GROUP BY ALL)
    SELECT st.cell_id, st.epoch, st.phase, fit.seen::BIGINT AS seen, """ + ", ".join(f"round(q[{i}] + 1e-9, 5) AS q{i}" for i in range(1, 7)) + " FROM st JOIN fit USING (cell_id, phase) WHERE st.epoch + 4 > (SELECT c FROM cut)", "epochs5 slots roll5")
def ml6(spark, sf):
    """Phases and rates of the first five eighths of the series, read at every later epoch. An epoch whose horizon crosses the cut counts as
    later; thresholds end one horizon before the cut, so none of them sees what comes after its observation."""
    n = V.weeks(spark, sf)
    cut = n * 5 // 8
    s = V.slots(spark, sf, n).select("cell_id", "slot", "fh_bits")
    cuts = s.where(F.col("slot") < cut - V.FAST.horizon).groupBy("cell_id").agg(F.percentile("fh_bits", F.array(F.lit(0.45), F.lit(0.85))).alias("c"))
    ph = s.join(cuts, "cell_id").select("cell_id", (F.col("slot") + 1).alias("obs_slot"), F.size(F.filter("c", lambda c: c <= F.col("fh_bits"))).alias("phase"))
    rates = V.rates(spark, sf).where(series.owned(V.FAST.chunk)).select("cell_id", (F.col("slot") + 1 - V.FAST.horizon).alias("obs_slot"), "rate")
    st = rates.where((F.col("obs_slot") + 1) % 4 == 0).join(ph, ["cell_id", "obs_slot"]).withColumn("epoch", F.col("obs_slot") + 1)
    f = TR.phase_forecast(st.where(F.col("epoch") + V.FAST.interval <= cut), st.where(F.col("epoch") + V.FAST.interval > cut).drop("rate"))
    return f.select("cell_id", "epoch", "phase", "seen", *[F.round(F.get("q", F.lit(i)) + 1e-9, 5).alias(f"q{i + 1}") for i in range(6)])


@query("ml_7_conditioning", "SELECT DISTINCT cell_id, round(deadline / 22.0, 6) AS deadline_rel, round(priority / (SELECT max(priority) FROM slots), 6) AS priority_rel FROM slots", "slots")
def ml7(spark, sf):
    cells = V.slots(spark, sf).select("cell_id", "deadline", "priority").distinct()
    return TR.conditioning(cells, 22).select("cell_id", r("deadline_rel"), r("priority_rel"))


@query("ml_8_context_table", _TR + "SELECT d.link_id, d.cell_id, d.epoch, round(d.backlog, 6) AS backlog, round(d.weight, 6) AS weight, round(d.label, 6) AS rate, round(tr.lag_mean, 6) AS lag_mean, round(tr.ewma_4, 6) AS ewma_4, round(tr.rstar_lag_1, 6) AS rstar_lag_1 FROM dec d JOIN tr USING (link_id, cell_id, epoch)", "dec feat5")
def ml8(spark, sf):
    c = TR.context_table(V.decisions(spark, sf), train(spark, sf))
    return c.select(*ID, r("backlog"), r("weight"), r("rate"), r("lag_mean"), r("ewma_4"), r("rstar_lag_1"))


# --- compression ---------------------------------------------------------------------------------------------
def _nmse(df, approx, *keys):
    g = df.groupBy(*keys) if keys else df.groupBy()
    return g.agg(C.nmse_db(F.sum(C.error_energy("vec", approx)), F.sum(C.energy("vec"))).alias("nmse_db"))


@query("cp_1_block_float", """, w AS (SELECT unnest([4, 6, 8, 12]) AS width), bl AS (SELECT id, pos, x, max(abs(x)) OVER (PARTITION BY id, pos // 16) AS peak FROM coords),
    q AS (SELECT width, x, pow(2.0, ceil(log2(peak))) AS sc, pow(2.0, width - 1) - 1 AS lv FROM bl CROSS JOIN w)
    SELECT width, round(10 * log10(sum(pow(x - round_even(x / sc * lv, 0) / lv * sc, 2)) / sum(x * x)), 5) AS nmse_db, round(16.0 * 16 / (width * 16.0 + 8), 6) AS ratio FROM q GROUP BY width""", "coords")
def cp1(spark, sf):
    d = V.vectors(spark, sf).crossJoin(F.broadcast(dims.grid(spark, "width", [4, 6, 8, 12], "int")))
    n = _nmse(d.withColumn("a", C.block_float("vec", "width")), "a", "width")
    return n.select("width", r("nmse_db", 5), F.round(C.block_ratio("width"), 6).alias("ratio"))


def stored(spark, sf):
    """The vector table as the encoders read it (several passes)."""
    return V.vectors(spark, sf)


@query("cp_2_low_rank")
def cp2(spark, sf):
    v = stored(spark, sf)
    _, basis = C.singular_values(v)
    e = C.factor_errors(v, {k: basis[:, :k] for k in (4, 8, 16)}, [0])
    return e.select("rank", F.round(C.nmse_db("err", "total"), 5).alias("nmse_db"))


@query("cp_3_sketch")
def cp3(spark, sf):
    """Sketch, orthonormal basis, coefficients; both factors quantised."""
    v = stored(spark, sf)
    e = C.factor_errors(v, {12: C.sketch_basis(v, 12)}, [8])
    return e.select("rank", F.round(C.nmse_db("err", "total"), 5).alias("nmse_db"))


_DCT = """, k AS (SELECT unnest(range(64)) AS k), dc AS (SELECT id, k.k, sum(x * cos(pi() * (2 * pos + 1) * k.k / 128.0)) * CASE WHEN k.k = 0 THEN sqrt(1.0 / 64) ELSE sqrt(2.0 / 64) END AS c FROM coords CROSS JOIN k GROUP BY id, k.k)"""


@query("cp_4_sparse_per_row", _DCT + """, rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(c) DESC, k) AS n FROM dc)
    SELECT 20::INT AS kept, round(10 * log10(sum(CASE WHEN n > 20 THEN c * c ELSE 0 END) / sum(c * c)), 4) AS nmse_db FROM rk""", "coords")
def cp4(spark, sf):
    """Transform, keep the 20 largest coefficients of each row, invert."""
    d = C.dct(V.vectors(spark, sf), "vec", "t").withColumn("s", C.keep_largest("t", 20))
    return _nmse(C.dct(d, "s", "rec", inverse=True), "rec").select(F.lit(20).alias("kept"), r("nmse_db", 4))


@query("cp_4_sparse_quantised", _DCT + """, g AS (SELECT kept, width FROM (VALUES (8), (20), (40)) a(kept) CROSS JOIN (VALUES (6), (10)) b(width)),
    rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY abs(c) DESC, k) AS n FROM dc), s AS (SELECT kept, width, id, k, c, CASE WHEN n <= kept THEN c ELSE 0.0 END AS x FROM rk CROSS JOIN g),
    p AS (SELECT *, max(abs(x)) OVER (PARTITION BY kept, width, id, k // 16) AS peak, pow(2.0, width - 1) - 1 AS lv FROM s), q AS (SELECT *, CASE WHEN peak > 0 THEN pow(2.0, ceil(log2(peak))) END AS sc FROM p)
    SELECT kept, width, round(10 * log10(sum(pow(c - coalesce(round_even(x / sc * lv, 0) / lv * sc, x), 2)) / sum(c * c)), 4) AS nmse_db,
      round(10 * log10(sum(CASE WHEN x = 0 THEN c * c ELSE pow(sc / lv / 2, 2) END) / sum(c * c)), 4) AS bound_db FROM q GROUP BY kept, width""", "coords")
def cp4q(spark, sf):
    """Kept coefficients quantised by block floating point, inverted, with the bound: energy left out plus half a step for each kept value."""
    grid = dims.grid(spark, "kept", [8, 20, 40], "int").crossJoin(dims.grid(spark, "width", [6, 10], "int"))
    d = C.dct(V.vectors(spark, sf), "vec", "t").crossJoin(F.broadcast(grid)).withColumn("s", C.keep_largest("t", F.col("kept")))
    d = C.dct(d.withColumn("sq", C.block_float("s", "width")), "sq", "rec", inverse=True)
    g = d.groupBy("kept", "width").agg(C.nmse_db(F.sum(C.error_energy("vec", "rec")), F.sum(C.energy("vec"))).alias("nmse_db"),
                                       C.nmse_db(F.sum(C.sparse_bound("t", "s", "width")), F.sum(C.energy("vec"))).alias("bound_db"))
    return g.select("kept", "width", r("nmse_db", 4), r("bound_db", 4))


@query("cp_4_sparse_per_table", _DCT + """, e AS (SELECT k FROM dc GROUP BY k ORDER BY sum(c * c) DESC, k LIMIT 20)
    SELECT 20::INT AS kept, round(10 * log10(sum(CASE WHEN e.k IS NULL THEN c * c ELSE 0 END) / sum(c * c)), 4) AS nmse_db FROM dc LEFT JOIN e ON e.k = dc.k""", "coords")
def cp4b(spark, sf):
    d = C.dct(V.vectors(spark, sf), "vec", "t")
    d = C.keep_top_positions(d, 20, "t", "s")
    return _nmse(C.dct(d, "s", "rec", inverse=True), "rec").select(F.lit(20).alias("kept"), r("nmse_db", 4))


@query("cp_5_effective_rank")
def cp5(spark, sf):
    sigma, _ = C.singular_values(stored(spark, sf))
    share = np.cumsum(sigma ** 2) / np.sum(sigma ** 2)
    rows = [(float(s), C.effective_rank(sigma, s)) for s in (0.5, 0.9, 0.99)]
    return spark.createDataFrame(rows, "share double, rank int")


@query("cp_6_shared_scale", """, pk AS (SELECT pos, max(abs(x)) AS m FROM coords GROUP BY pos), q AS (SELECT id, c.pos, x, round_even(x / m * 127, 0) / 127 * m AS xq FROM coords c JOIN pk USING (pos)),
    g AS (SELECT sqrt(sum(x * x) / sum(xq * xq)) AS gain FROM q) SELECT id, round(sum(xq * gain * xq * gain), 6) AS power, round(sum(pow(x - xq * gain, 2)), 9) AS err FROM q CROSS JOIN g GROUP BY id""", "coords")
def cp6(spark, sf):
    d = C.shared_scale(V.vectors(spark, sf), 8)
    return d.select("id", F.round(C.energy("quantised"), 6).alias("power"), F.round(C.error_energy("vec", "quantised"), 9).alias("err"))


@query("cp_7_rate_distortion")
def cp7(spark, sf):
    """NMSE and ratio of every encoder over its parameters, factors and coefficients quantised to ten bits: four passes over the table."""
    v = stored(spark, sf)
    rows, n = v.agg(F.count("*"), F.max(F.size("vec"))).first()

    def curve(name, df, param, nmse, ratio):
        return df.select(F.lit(name).alias("encoder"), F.col(param).cast("int").alias("param"), F.round(nmse, 5).alias("nmse_db"), F.round(ratio, 5).alias("ratio"))

    d = v.crossJoin(F.broadcast(dims.grid(spark, "param", [4, 6, 8, 10, 12, 16], "int")))
    out = curve("block_float", _nmse(d.withColumn("a", C.block_float("vec", "param")), "a", "param"), "param", F.col("nmse_db"), C.block_ratio("param"))
    _, basis = C.singular_values(v)
    for name, bases in (("low_rank", {k: basis[:, :k] for k in (2, 4, 8, 12, 16, 24, 32)}), ("sketch", {k: C.sketch_basis(v, k) for k in (2, 4, 8, 12, 16, 24)})):
        e = C.factor_errors(v, bases, [10])
        out = out.unionByName(curve(name, e, "rank", C.nmse_db("err", "total"), C.low_rank_ratio(rows, n, F.col("rank"), 10)))
    t = C.dct(v, "vec", "t").crossJoin(F.broadcast(dims.grid(spark, "param", [2, 4, 6, 8, 12, 20, 32, 48], "int")))
    s = C.dct(t.withColumn("s", C.block_float(C.keep_largest("t", F.col("param")), F.lit(10))), "s", "rec", inverse=True)
    return out.unionByName(curve("sparse", _nmse(s, "rec", "param"), "param", F.col("nmse_db"), C.sparse_ratio(n, F.col("param"), 10)))


@query("cp_8_precision_sweep", """, w AS (SELECT unnest([3, 5, 8, 11]) AS bits), q AS (SELECT bits, label, x, CASE WHEN x = 0 THEN 0.0 ELSE round_even(x * pow(2.0, bits - (floor(log2(abs(x))) + 1)), 0) * pow(2.0, (floor(log2(abs(x))) + 1) - bits) END AS y FROM coords CROSS JOIN w)
    SELECT bits, label, round(10 * log10(sum(pow(x - y, 2)) / sum(x * x)), 5) AS nmse_db FROM q GROUP BY ALL""", "coords")
def cp8(spark, sf):
    d = V.vectors(spark, sf).crossJoin(F.broadcast(dims.grid(spark, "bits", [3, 5, 8, 11], "int")))
    d = d.withColumn("a", F.transform("vec", lambda x: S.round_mantissa(x, F.col("bits"))))
    return _nmse(d, "a", "bits", "label").select("bits", "label", r("nmse_db", 5))


@query("cp_9_rank_under_budget")
def cp9(spark, sf):
    """Rank and width of the smallest error within a bit budget; every affordable pair is encoded, in one pass."""
    v = stored(spark, sf)
    rows, n = v.agg(F.count("*"), F.max(F.size("vec"))).first()
    _, basis = C.singular_values(v)
    pairs = [(share, k, w) for share in (0.1, 0.25, 0.5) for w, k in C.affordable(rows, n, share * rows * n * 32).items()]
    e = C.factor_errors(v, {k: basis[:, :k] for k in {k for _, k, _ in pairs}}, sorted({w for *_, w in pairs}))
    grid = spark.createDataFrame(pairs, "budget_share double, rank int, width int").join(e, ["rank", "width"])
    best = F.min(F.struct((F.col("err") / F.col("total")).alias("error"), "width", "rank")).alias("b")
    return grid.groupBy("budget_share").agg(best).select("budget_share", "b.rank", "b.width", F.round("b.error", 9).alias("error"))
