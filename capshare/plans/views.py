"""Bindings to the driver's tables (Spark side). ``ctes.py`` holds the same views for DuckDB."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import constants as K
from ..functions import scalars as S
from ..functions.quantiles import sorted_quantiles
from ..operators import series
from ..operators.series import Clock
from ..sources import dims

CELLS_PER_LINK = 8
CAPACITY = 360.0
CELL_CAP = 150.0
UNIT = 2.0
BITS_PER_UNIT = 100
FAST = Clock(interval=4, delay=1)       # many epochs on a short series
SLOW = Clock(interval=20, delay=2)      # the default timing


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def hits(spark, sf) -> DataFrame:
    """Weekly supplier shipments as sized events."""
    week = F.floor(F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")) / 7)
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("cell_id"), week.cast("bigint").alias("slot"),
        F.round("l_quantity").cast("bigint").alias("fh_bits"))


def weeks(spark, sf) -> int:
    """Slots of the shipments: one aggregate over one column."""
    return series.span(hits(spark, sf).select("slot"))


def slots(spark, sf, n: int | None = None) -> DataFrame:
    """Dense (link, cell, slot) series with the class attributes of the cell; ``n`` where ``weeks`` is known already."""
    dense = series.densify(hits(spark, sf), ["cell_id"], "fh_bits", n)
    dense = dense.withColumn("link_id", F.floor(F.col("cell_id") / CELLS_PER_LINK).cast("bigint"))
    return dims.with_cells(dense, dims.cell_classes(spark)).withColumn(
        "arrivals_bits", F.col("fh_bits") * BITS_PER_UNIT)


def event_hits(spark, sf) -> DataFrame:
    hour = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / F.lit(3_600_000_000))
    return table(spark, sf, "events").select(
        F.col("user_id").alias("cell_id"), hour.cast("bigint").alias("slot"),
        F.round(F.col("value") * 100).cast("bigint").alias("bits"), "event_type", "event_id")


def event_slots(spark, sf) -> DataFrame:
    return series.densify(event_hits(spark, sf), ["cell_id"], "bits")


def event_runs(spark, sf) -> DataFrame:
    """(cell, busy, start, stop): the slots of ``event_slots`` in stretches of 256 at most, idle ones not written out."""
    slot = F.struct(F.col("_from").alias("start"), F.col("_from").alias("stop"), (F.col("_v") > 0).alias("busy"))
    rest = F.struct((F.col("_from") + 1).alias("start"), F.col("_to").alias("stop"), F.lit(False).alias("busy"))
    parts = F.when(F.col("_v") > 0, F.filter(F.array(slot, rest), lambda x: x["start"] <= x["stop"])).otherwise(
        F.array(F.struct(F.col("_from").alias("start"), F.col("_to").alias("stop"), F.lit(False).alias("busy"))))
    return series.filled(event_hits(spark, sf), ["cell_id"], "bits").select("cell_id", F.inline(parts))


def rates(spark, sf, clock: Clock = FAST) -> DataFrame:
    return series.rate_series(slots(spark, sf), clock)


def packed(spark, sf, clock: Clock = FAST, n: int | None = None) -> DataFrame:
    return series.packed_rates(slots(spark, sf, n), clock)


def epochs_features(spark, sf, clock: Clock = FAST) -> DataFrame:
    return series.features(rates(spark, sf, clock), clock)


def observations(spark, sf, clock: Clock = FAST) -> DataFrame:
    return series.state_ages(slots(spark, sf), clock)


def full_epochs(n: int, clock: Clock = FAST, blocks: int = K.LAG_BLOCKS + 1):
    """Epochs with enough history and a full horizon ahead in ``n`` slots."""
    return series.enough_history(clock, blocks) & (F.col("epoch") <= n - clock.interval - 1)


def decisions(spark, sf, clock: Clock = FAST, with_label: bool = False) -> DataFrame:
    """One row per (link, epoch, cell) with everything an allocation rule may use, read from the packed chunks in one pass."""
    h, n = clock.horizon, weeks(spark, sf)
    alpha = 2.0 / (clock.interval + 1.0)

    def fields(slot, pos):
        recent = series.before("vals", pos, 0, 6 * clock.interval)
        # newest value has weight 1, each older one (1 - alpha) times the next
        ewma = F.aggregate(recent, F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("w")), lambda a, x: F.struct(
            (a["v"] * (1 - alpha) + x).alias("v"), (a["w"] * (1 - alpha) + 1.0).alias("w")))
        idle = F.array_position(F.transform(F.reverse(series.before("vals", pos, 0, K.CELL_CLASSES[-1][2])), lambda x: x == 0), F.lit(True))
        ahead = F.slice("vals", pos + 1, F.lit(h))
        return {"recent": F.sort_array(series.block_ends("rate", slot, pos, clock, K.FORECAST_WINDOW)),
                "lengths": series.block_ends("crit", slot, pos, clock, K.FORECAST_WINDOW),
                "persist": F.coalesce(F.get("rate", pos - 1), F.lit(0.0)), "label": F.get("rate", pos + h - 1),
                "label_mean": series.total(ahead) / F.size(ahead), "queue_fh": series.total(series.before("vals", pos, 0, 3)),
                "_e": ewma, "_idle": idle}

    d = series.at_epochs(packed(spark, sf, clock, n), clock, fields)
    hol = F.least(F.when(F.col("_idle") > 0, F.col("_idle") - 1).otherwise(F.col("obs_slot")), F.col("deadline")).cast("bigint")
    out = d.select("link_id", "cell_id", "epoch", "obs_slot", "deadline", "queue_fh", hol.alias("hol_age"), (F.col("_e.v") / F.col("_e.w")).alias("ewma"),
                   "persist", "label", "label_mean", sorted_quantiles("recent").alias("q"),
                   series.volume_of(F.col("lengths"), F.col("deadline"), clock.interval).alias("volume"))
    out = out.where(full_epochs(n, clock))
    pr = dims.cell_classes(spark).select("class", "priority")
    out = dims.with_cells(out, pr)
    return out.withColumns({
        "cap": F.lit(CELL_CAP), "capacity": F.lit(CAPACITY),
        "backlog": S.backlog_rate("queue_fh", "deadline", "hol_age", clock.interval, clock.delay),
        "weight": S.deadline_weight("priority", "deadline", clock.horizon),
    })


# --- run tables ---------------------------------------------------------------------------------------
def runs(spark, sf) -> DataFrame:
    """One row per (scenario, method, seed): averages scaled to ratios and milliseconds."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    j = o.join(c, o.o_custkey == c.c_custkey)
    g = j.groupBy(F.col("o_orderpriority").alias("scenario"), F.col("c_mktsegment").alias("method"),
                  (F.col("o_orderkey") % 20).alias("seed"))
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    bal = F.round(F.col("c_acctbal") * 100).cast("bigint")
    return g.agg((F.sum(cents) / F.count("*") / F.lit(5e8)).alias("wvr"),
                 (F.sum(bal) / F.count("*") / F.lit(1e7)).alias("vr"),
                 (F.max(cents) / F.lit(1e8)).alias("ll"), (F.min(cents) / F.lit(1e8)).alias("embb"),
                 F.count("*").cast("bigint").alias("n"))


def run_slots(spark, sf) -> DataFrame:
    """Per (cell, slot): arrived, violated, served, used link bits and delay bucket volumes."""
    week = F.floor(F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")) / 7)
    li = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("cell_id"), week.cast("bigint").alias("slot"),
        F.round("l_quantity").cast("bigint").alias("bits"), "l_returnflag", F.col("l_linenumber").alias("age"))
    bad = F.col("l_returnflag") == "R"
    return dims.with_cells(li.where(F.col("slot") >= 0), dims.cell_classes(spark)).select(
        F.floor(F.col("cell_id") / CELLS_PER_LINK).cast("bigint").alias("link_id"), "cell_id", "slot", "age", "deadline",
        "priority", "name", F.col("bits").alias("arrived"), F.when(bad, F.col("bits")).otherwise(0).alias("violated"),
        F.when(bad, F.lit(0)).otherwise(F.col("bits")).alias("served"))


def bench_rows(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_linenumber").cast("bigint").alias("dim"), F.col("l_returnflag").alias("method"),
        F.col("l_extendedprice").alias("ms"), F.col("l_discount").alias("residual"), F.col("l_tax").alias("rel_err"))


def vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"),
                                                 "label")
