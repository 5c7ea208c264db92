"""Streaming forms of the telemetry operators: slotting, sliding horizons, delayed joins, late labels, running key figures.

All use event-time watermarks, so state is dropped once a window or join interval is closed.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.demand import required_rate


def tumbling(events: DataFrame, keys: Sequence[str], ts: str, bits: str, width: str, late: str) -> DataFrame:
    """Bits per (key, slot window); partial sums per task before the shuffle."""
    return (events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("window"), *keys).agg(F.sum(bits).alias(bits)))


def sliding_horizons(events: DataFrame, keys: Sequence[str], ts: str, bits: str, slot_minutes: int, horizon: int, step: int, late: str,
                     deadline: str, offset_slots: int = 0) -> DataFrame:
    """Rate of every horizon of ``horizon`` slots that starts each ``step`` slots (shifted by ``offset_slots``).

    Slots are summed first (one row per key and slot), so a horizon gathers at most ``horizon`` rows however hot its key is.
    """
    w = f"{slot_minutes} minutes"
    slots = (events.withWatermark(ts, late).groupBy(F.window(ts, w).alias("s"), *keys, deadline).agg(F.sum(bits).alias(bits)))
    at = F.window_time("s")
    spans = F.window(at, f"{slot_minutes * horizon} minutes", f"{slot_minutes * step} minutes", f"{slot_minutes * offset_slots} minutes")
    h = slots.groupBy(spans.alias("h"), *keys, deadline).agg(F.collect_list(F.struct(F.col("s.start").alias("t"), F.col(bits).alias("b"))).alias("_r"))

    def value(i):
        start = F.timestamp_micros(F.unix_micros("h.start") + i * (slot_minutes * 60_000_000))
        return F.aggregate(F.filter("_r", lambda x: x["t"] == start), F.lit(0.0), lambda a, x: a + x["b"])

    dense = F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), value)
    return h.withColumn("_a", dense).select(*keys, F.col("h.start").alias("start"), required_rate("_a", deadline).alias("rate"))


def delayed_join(decisions: DataFrame, telemetry: DataFrame, key: str, delay: str, span: str, late: str) -> DataFrame:
    """Decisions (key, dts, ..) meet telemetry (key, tts, ..) that is at least ``delay`` and at most ``span`` old."""
    d = decisions.withWatermark("dts", late)
    t = telemetry.withWatermark("tts", late).withColumnRenamed(key, "_k")
    cond = ((F.col(key) == F.col("_k")) & (F.col("tts") <= F.col("dts") - F.expr(f"INTERVAL {delay}"))
            & (F.col("tts") > F.col("dts") - F.expr(f"INTERVAL {span}")))
    return d.join(t, cond).drop("_k")


def match_labels(forecasts: DataFrame, outcomes: DataFrame, keys: Sequence[str], late: str) -> DataFrame:
    """A forecast waits until the outcome of its epoch arrives; the time bound lets both sides drop old state."""
    f = forecasts.withWatermark("fts", late)
    o = outcomes.withWatermark("ots", late).withColumnsRenamed({k: f"_{k}" for k in keys})
    cond = (F.col("ots") >= F.col("fts")) & (F.col("ots") <= F.col("fts") + F.expr(f"INTERVAL {late}"))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_{k}"))
    return f.join(o, cond).drop(*[f"_{k}" for k in keys])


def running_kpis(rows: DataFrame, ts: str, width: str, late: str) -> DataFrame:
    """Weighted violation ratio and used bits per (link, window), refreshed as rows arrive."""
    g = rows.withWatermark(ts, late).groupBy(F.window(ts, width).alias("window"), "link_id")
    return g.agg((F.sum(F.col("priority") * F.col("violated")) / F.greatest(F.sum(F.col("priority") * F.col("arrived")), F.lit(1e-9))).alias("weighted_violation_ratio"),
                 F.sum("served").alias("used"), F.count("*").alias("rows"))
