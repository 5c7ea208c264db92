"""Streaming queries, drained over the driver's tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calibration as CAL
from ..streaming import run, stateful, telemetry as TE
from . import views as V
from .q_stats import _CAL, _FIFO, calibrated, replay_input, signed
from .registry import query


def r(name, n=6):
    return F.round(name, n).alias(name)


def events(spark, sf):
    e = run.table_stream(spark, sf, "events", ["event_id", "user_id", "ts", "value", "event_type"])
    return e.select("event_id", F.col("user_id").alias("cell_id"), F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("bigint").alias("bits"), "event_type")


def hours(c):
    return F.floor((F.unix_micros(c) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / F.lit(3_600_000_000)).cast("bigint")


def at_hour(c):
    return F.timestamp_micros(F.unix_micros(F.lit("2024-01-01").cast("timestamp")) + (F.col(c) if isinstance(c, str) else c) * F.lit(3_600_000_000))


@query("str_1_tumbling_slots", """SELECT user_id AS cell_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 3600000000 AS slot, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS bits FROM events
    GROUP BY ALL HAVING time_bucket(INTERVAL 1 HOUR, any_value(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def str1(spark, sf):
    """Windows that the watermark has closed."""
    w = TE.tumbling(events(spark, sf), ["cell_id"], "ts", "bits", "1 hour", "10 minutes")
    return run.run_append(w.select("cell_id", hours(F.col("window.start")).alias("slot"), "bits"), "tumbling")


@query("str_2_sliding_horizons", """, b AS (SELECT cell_id, slot, sum(bits)::BIGINT AS bits, 4 + cell_id % 2 * 16 AS deadline FROM event_hits GROUP BY ALL),
    s AS (SELECT DISTINCT cell_id, deadline, h.h * 4 - 2 AS st FROM b JOIN range(-1, (SELECT CAST(max(slot) // 4 + 2 AS BIGINT) FROM b)) h(h) ON b.slot >= h.h * 4 - 2 AND b.slot < h.h * 4 - 2 + 6),
    p AS (SELECT s.cell_id, s.st, s.deadline, i.i, coalesce(sum(b.bits), 0) AS cs FROM s CROSS JOIN range(7) i(i) LEFT JOIN b ON b.cell_id = s.cell_id AND b.slot >= s.st AND b.slot < s.st + i.i GROUP BY ALL)
    SELECT a.cell_id, a.st AS start, round(max((c.cs - a.cs) / (c.i - a.i + a.deadline)::DOUBLE), 5) AS rate FROM p a JOIN p c ON a.cell_id = c.cell_id AND a.st = c.st AND c.i > a.i
    WHERE TIMESTAMP '2024-01-01' + to_hours(CAST(a.st + 6 AS BIGINT)) <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL""", "event_hits")
def str2(spark, sf):
    """Horizons of six hours every four, shifted by the telemetry delay of two; all that the watermark has closed."""
    e = events(spark, sf).withColumn("deadline", 4 + F.col("cell_id") % 2 * 16)
    h = TE.sliding_horizons(e, ["cell_id"], "ts", "bits", 60, 6, 4, "10 minutes", "deadline", offset_slots=2)
    return run.run_append(h.select("cell_id", hours(F.col("start")).alias("start"), F.round("rate", 5).alias("rate")), "sliding")


@query("str_3_delayed_telemetry", """WITH d AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'), t AS (SELECT user_id, ts, CAST(round(value * 100) AS BIGINT) AS bits FROM events WHERE event_type != 'error')
    SELECT d.event_id, count(*)::BIGINT AS seen, sum(bits)::BIGINT AS bits FROM d JOIN t ON t.user_id = d.user_id AND t.ts <= d.ts - INTERVAL 2 HOUR AND t.ts > d.ts - INTERVAL 12 HOUR GROUP BY ALL""")
def str3(spark, sf):
    """Decisions that see nothing are left out, as by a join."""
    e = events(spark, sf).select("cell_id", F.when(F.col("event_type") == "error", F.lit("decision")).otherwise(F.lit("telemetry")).alias("kind"), F.col("event_id").alias("id"), "bits", "ts")
    out = run.run_append(stateful.delayed_sums(e, 2 * 3600, 12 * 3600, "1 hour"), "delayed", stateful=True)
    return out.where("seen > 0").select(F.col("id").alias("event_id"), "seen", F.col("total").alias("bits"))


@query("str_3_delayed_join", """WITH d AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'), t AS (SELECT event_id, user_id, ts FROM events WHERE event_type != 'error')
    SELECT d.event_id, t.event_id AS seen_id FROM d JOIN t ON t.user_id = d.user_id AND t.ts <= d.ts - INTERVAL 2 HOUR AND t.ts > d.ts - INTERVAL 12 HOUR""")
def str3j(spark, sf):
    """Where the rows themselves are wanted, not their sums: one row for each pair."""
    d = events(spark, sf).where("event_type = 'error'").select("event_id", "cell_id", F.col("ts").alias("dts"))
    t = events(spark, sf).where("event_type != 'error'").select("cell_id", F.col("ts").alias("tts"), F.col("event_id").alias("seen_id"))
    return run.run_append(TE.delayed_join(d, t, "cell_id", "2 HOURS", "12 HOURS", "1 hour").select("event_id", "seen_id"), "delayed")


@query("str_4_fifo_stream", _FIFO + " SELECT cell_id, slot, round(served, 6) AS served, round(violated, 6) AS violated, round(queue, 6) AS queue, hol FROM ff WHERE slot >= 0", "slots", recursive=True)
def str4(spark, sf):
    """The replay as keyed state, three batches of slots one after the other."""
    feed = fifo_feed(spark, sf)
    return run.run_append(stateful.fifo(feed.stream()), "fifo", stateful=True, feed=feed).select("cell_id", "slot", r("served"), r("violated"), r("queue"), "hol")


def fifo_feed(spark, sf):
    rows = replay_input(spark, sf).select("cell_id", "slot", "deadline", F.col("arrived").cast("double").alias("arrived"), "allowed")
    return run.Replay(rows, "fifo-in", "slot", 3)


@query("str_4_delay_histogram_stream", _FIFO + """, ex AS (SELECT cell_id, unnest(range(len(taken))) AS age, unnest(taken) AS b FROM ff WHERE slot >= 0)
    SELECT cell_id, age, round(sum(b), 5) AS bits FROM ex GROUP BY ALL""", "slots", recursive=True)
def str4h(spark, sf):
    """Bits served by age, summed over what the stream emits."""
    feed = fifo_feed(spark, sf)
    h = stateful.delay_histogram(run.run_append(stateful.fifo(feed.stream()), "fifo", stateful=True, feed=feed))
    return h.select("cell_id", F.col("age").cast("bigint").alias("age"), r("bits", 5))


@query("str_5_calibration_stream", _CAL + " SELECT cell_id, k, round(delta, 6) AS delta, 0::BIGINT AS late FROM cal", "dec", recursive=True)
def str5(spark, sf):
    """Epochs open and outcomes arrive as rows of one stream; an outcome comes when its horizon has been observed, just before epoch k + lag opens."""
    d, _ = calibrated(spark, sf)
    lag = CAL.maturity(V.FAST.interval, V.FAST.delay)
    minute = F.make_dt_interval(mins=F.lit(1))
    kinds = F.array(F.struct(F.lit("open").alias("kind"), at_hour("k").alias("ts")), F.struct(F.lit("outcome").alias("kind"), (at_hour(F.col("k") + lag) - minute).alias("ts")))
    rows = d.select("cell_id", "k", "miss", F.explode(kinds).alias("e")).select("cell_id", "k", F.when(F.col("e.kind") == "outcome", F.col("miss")).alias("miss"), "e.*")
    feed = run.Replay(rows, "cal-in", "ts", 3)
    return run.run_append(stateful.calibrate(feed.stream(), lag, lo=-0.05, hi=0.1), "cal", stateful=True, feed=feed).select("cell_id", "k", signed("delta"), "late")


@query("str_6_late_labels", "SELECT link_id, cell_id, epoch, round(q[5], 6) AS target, round(label, 6) AS label, (label > q[5])::INT AS miss FROM dec", "dec")
def str6(spark, sf):
    """Forecasts and outcomes as two streams; an outcome comes a horizon after its forecast."""
    d = V.decisions(spark, sf).select("link_id", "cell_id", "epoch", at_hour("epoch").alias("fts"), at_hour(F.col("epoch") + 4).alias("ots"), F.get("q", F.lit(4)).alias("target"), "label")
    feed = run.Replay(d, "labels-in", "epoch", 2)
    f = feed.stream().select("link_id", "cell_id", "epoch", "fts", "target")
    o = feed.stream().select("link_id", "cell_id", "epoch", "ots", "label")
    m = TE.match_labels(f, o, ["link_id", "cell_id", "epoch"], "12 hours")
    out = run.run_append(m.select("link_id", "cell_id", "epoch", "target", "label"), "labels", feed=feed)
    return out.select("link_id", "cell_id", "epoch", r("target"), r("label"), (F.col("label") > F.col("target")).cast("int").alias("miss"))


@query("str_7_running_kpis", """SELECT link_id, slot // 8 AS win, round(sum(priority * violated) / greatest(sum(priority * arrived), 1e-9), 6) AS weighted_violation_ratio, sum(served)::BIGINT AS used, count(*)::BIGINT AS rows
    FROM run_slots GROUP BY ALL""", "run_slots")
def str7(spark, sf):
    rows = V.run_slots(spark, sf).select("link_id", "slot", at_hour("slot").alias("ts"), "priority", "arrived", "violated", "served")
    feed = run.Replay(rows, "kpi-in", "slot", 3)
    k = TE.running_kpis(feed.stream(), "ts", "8 hours", "1 hour").select("link_id", (hours(F.col("window.start")) / 8).cast("bigint").alias("win"), "weighted_violation_ratio", "used", "rows")
    return run.run_update(k, "kpi", ["link_id", "win"], feed).select("link_id", "win", r("weighted_violation_ratio"), "used", "rows")
