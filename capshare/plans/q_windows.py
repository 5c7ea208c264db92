"""Window queries: lag blocks, EWMA, deadline-feasible rates, forecasts, patches, runs."""
from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from .. import constants as K
from ..operators import series
from . import views as V
from .registry import query

ID = ["link_id", "cell_id", "epoch"]


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def feats(spark, sf, *names):
    f = V.epochs_features(spark, sf)
    return f.where(series.enough_history(V.FAST) & F.col("label").isNotNull()).select(*ID, *r6(*names))


def _fsql(*names):
    cols = ", ".join(f"round({n}, 6) AS {n}" for n in names)
    return f"SELECT link_id, cell_id, epoch, {cols} FROM feat5 WHERE obs_slot >= 35 AND label IS NOT NULL"


_LAGS = [f"lag_mean_{k}" for k in range(1, 7)]


@query("wn_1_lag_means", _fsql(*_LAGS), "feat5")
def wn1(spark, sf):
    return feats(spark, sf, *_LAGS)


@query("wn_1_lag_means_short_history",
       "SELECT link_id, cell_id, epoch, " + ", ".join(f"round({n}, 6) AS {n}" for n in _LAGS) + " FROM feat5 WHERE obs_slot < 35", "feat5")
def wn1b(spark, sf):
    return V.epochs_features(spark, sf).where(~series.enough_history(V.FAST)).select(*ID, *r6(*_LAGS))


@query("wn_2_lag_stats", _fsql("lag_mean", "lag_std", "lag_max"), "feat5")
def wn2(spark, sf):
    return feats(spark, sf, "lag_mean", "lag_std", "lag_max")


@query("wn_3_ewma", _fsql("ewma_4", "ewma_40"), "feat5")
def wn3(spark, sf):
    return feats(spark, sf, "ewma_4", "ewma_40")


@query("wn_4_last_slots", _fsql("last_slot_1", "last_slot_2", "last_slot_3", "last_slot_4"), "feat5")
def wn4(spark, sf):
    return feats(spark, sf, "last_slot_1", "last_slot_2", "last_slot_3", "last_slot_4")


@query("wn_5_required_rate", """SELECT o.link_id, o.cell_id, o.epoch, round(r.rate, 6) AS rstar FROM epochs22 o
    JOIN roll22 r ON r.cell_id = o.cell_id AND r.e = o.obs_slot + 22""", "epochs22 roll22")
def wn5(spark, sf):
    """Rate of the label horizon at the default timing."""
    r = V.rates(spark, sf, V.SLOW)
    w = series.chunk_window()
    return (r.withColumn("rstar", F.lead("rate", V.SLOW.horizon - 1).over(w)).where(series.epoch_anchor(V.SLOW))
            .where("rstar is not null")
            .select("link_id", "cell_id", (F.col("slot") + 2).alias("epoch"), *r6("rstar")))


@query("wn_6_rate_lags", _fsql("rstar_lag_1", "rstar_lag_2", "rstar_lag_3"), "feat5")
def wn6(spark, sf):
    return feats(spark, sf, "rstar_lag_1", "rstar_lag_2", "rstar_lag_3")


@query("wn_7_critical_window", "SELECT cell_id, e - 1 AS slot, crit FROM roll22 WHERE e >= 1", "roll22")
def wn7(spark, sf):
    return V.rates(spark, sf, V.SLOW).where(series.owned(V.SLOW.chunk)).select("cell_id", "slot", "crit")


@query("wn_8_sustainable_rate", """SELECT link_id, cell_id, epoch, round(greatest(label, label_mean), 6) AS sustain
    FROM feat5 WHERE label IS NOT NULL""", "feat5")
def wn8(spark, sf):
    f = V.epochs_features(spark, sf).where("label is not null")
    return f.select(*ID, F.round(F.greatest("label", "label_mean"), 6).alias("sustain"))


_Q = ", ".join(f"round(q[{i + 1}], 6) AS q{i + 1}" for i in range(6))


@query("wn_9_window_forecast", f"""SELECT link_id, cell_id, epoch, {_Q} FROM fc5
    UNION ALL SELECT o.link_id, o.cell_id, o.epoch, {", ".join(f"round(coalesce(r.rate, 0.0), 6) AS q{i + 1}" for i in range(6))}
    FROM epochs5 o LEFT JOIN roll5 r ON r.cell_id = o.cell_id AND r.e = o.obs_slot WHERE o.obs_slot < 5""", "fc5 epochs5 roll5")
def wn9(spark, sf):
    f = series.window_forecast(V.packed(spark, sf), V.FAST)
    return f.select(*ID, *[F.round(F.get("q", F.lit(i)), 6).alias(f"q{i + 1}") for i in range(6)])


@query("wn_10_persistence", """, s6 AS (SELECT a.cell_id, o.epoch, o.link_id,
      max((b.cs - a.cs) / (b.slot - a.slot + a.deadline)::DOUBLE) AS persist
      FROM epochs5 o JOIN pre a ON a.cell_id = o.cell_id AND a.slot >= greatest(o.obs_slot - 5 * greatest(least(3, o.obs_slot // 5), 1), 0)
      JOIN pre b ON b.cell_id = a.cell_id AND b.slot > a.slot AND b.slot <= o.obs_slot GROUP BY ALL)
    SELECT link_id, cell_id, epoch, round(persist, 6) AS persist FROM s6""", "epochs5 pre")
def wn10(spark, sf):
    s = V.slots(spark, sf)
    return series.persistence(V.rates(spark, sf), s, V.FAST, 3).where("obs_slot > 0").select(*ID, *r6("persist"))


@query("wn_11_patches", """SELECT o.link_id, o.cell_id, o.epoch, 15 - k.k AS idx,
      CASE WHEN o.obs_slot - (k.k + 1) * 5 >= 0 THEN round((SELECT sum(s.fh_bits * (s.slot - (o.obs_slot - (k.k + 1) * 5) + 1)) FROM slots s
        WHERE s.cell_id = o.cell_id AND s.slot >= o.obs_slot - (k.k + 1) * 5 AND s.slot < o.obs_slot - k.k * 5)::DOUBLE / 150.0, 6) ELSE 0.0 END AS checksum,
      CASE WHEN o.obs_slot - (k.k + 1) * 5 >= 0 THEN round((SELECT r.rate / 150.0 FROM roll5 r WHERE r.cell_id = o.cell_id AND r.e = o.obs_slot - k.k * 5), 6) ELSE 0.0 END AS rate,
      CASE WHEN o.obs_slot - (k.k + 1) * 5 >= 0 THEN round((SELECT avg(s.fh_bits) / 150.0 FROM slots s
        WHERE s.cell_id = o.cell_id AND s.slot >= o.obs_slot - (k.k + 1) * 5 AND s.slot < o.obs_slot - k.k * 5), 6) ELSE 0.0 END AS mean,
      CASE WHEN o.obs_slot - (k.k + 1) * 5 >= 0 THEN round((SELECT max(s.fh_bits) / 150.0 FROM slots s
        WHERE s.cell_id = o.cell_id AND s.slot >= o.obs_slot - (k.k + 1) * 5 AND s.slot < o.obs_slot - k.k * 5), 6) ELSE 0.0 END AS max
    FROM epochs5 o CROSS JOIN range(16) k(k)""", "epochs5 slots roll5")
def wn11(spark, sf):
    p = series.patches(V.packed(spark, sf), V.CELL_CAP, V.FAST)
    p = p.select(*ID, F.inline("patches"))
    weighted = F.aggregate(F.transform("vals", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return p.select(*ID, F.col("idx").cast("bigint").alias("idx"), F.round(weighted, 6).alias("checksum"), *r6("rate", "mean", "max"))


@query("wn_12_cumulative_violated", """SELECT link_id, cell_id, slot, sum(v) OVER (PARTITION BY cell_id ORDER BY slot)::BIGINT AS cum_violated FROM (
    SELECT link_id, cell_id, slot, sum(violated) AS v FROM run_slots WHERE slot BETWEEN 100 AND 250 GROUP BY ALL)""", "run_slots")
def wn12(spark, sf):
    per = (V.run_slots(spark, sf).where(F.col("slot").between(100, 250)).groupBy("link_id", "cell_id", "slot")
           .agg(F.sum("violated").alias("v")))
    return series.running_total(per, ["link_id", "cell_id"], "slot", "v", "cum_violated", 64).select(
        "link_id", "cell_id", "slot", "cum_violated")


@query("wn_13_hold_last", """SELECT cell_id, slot, last_value(CASE WHEN slot % 8 = 0 THEN fh_bits END IGNORE NULLS)
    OVER (PARTITION BY cell_id ORDER BY slot) AS held FROM slots""", "slots")
def wn13(spark, sf):
    s = V.slots(spark, sf).select("cell_id", "slot", "fh_bits")
    return series.hold_last(s, ["cell_id"], "slot", "fh_bits", 8, "held").select("cell_id", "slot", "held")


@query("wn_14_sojourns", """, m AS (SELECT cell_id, slot, bits > 0 AS busy FROM event_slots),
    g AS (SELECT *, slot - row_number() OVER (PARTITION BY cell_id, busy ORDER BY slot) AS isl FROM m)
    SELECT cell_id, busy, min(slot) AS start, count(*)::BIGINT AS length FROM g GROUP BY cell_id, busy, isl""", "event_slots")
def wn14(spark, sf):
    return series.sojourns(V.event_runs(spark, sf), ["cell_id"], "start", "busy", 256, until="stop")


@query("wn_14_longest_run", """, m AS (SELECT cell_id, slot, bits > 0 AS busy FROM event_slots),
    g AS (SELECT *, slot - row_number() OVER (PARTITION BY cell_id, busy ORDER BY slot) AS isl FROM m),
    r AS (SELECT cell_id, busy, count(*) AS length FROM g GROUP BY cell_id, busy, isl)
    SELECT cell_id, busy, count(*)::BIGINT AS runs, max(length)::BIGINT AS longest, round(avg(length), 6) AS mean_length FROM r GROUP BY ALL""", "event_slots")
def wn14b(spark, sf):
    return wn14(spark, sf).groupBy("cell_id", "busy").agg(
        F.count("*").alias("runs"), F.max("length").alias("longest"), F.round(F.avg("length"), 6).alias("mean_length"))


@query("wn_15_volume_factor", """SELECT link_id, cell_id, epoch, round(volume, 6) AS volume FROM vol5
    UNION ALL SELECT link_id, cell_id, epoch, least(deadline + 1.0, 4.0)::DOUBLE FROM epochs5 WHERE obs_slot < 5""", "vol5 epochs5")
def wn15(spark, sf):
    return series.volume_factor(V.packed(spark, sf), V.FAST).select(*ID, *r6("volume"))
