"""User-supplied rules and forecasters."""
from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..operators import registry as RG, series
from . import views as V
from .q_allocation import ID, _KNOTS, sql_interp, wf_sql, out_sql
from .registry import query


@query("udf_allocator_frame", """, b AS (SELECT *, least(greatest(queue_fh, 0.0), 150.0) AS x FROM dec)
    SELECT link_id, epoch, cell_id, round(CASE WHEN sum(x) OVER g > 360 THEN x * 360 / sum(x) OVER g ELSE x END + 1e-9, 5) AS budget FROM b WINDOW g AS (PARTITION BY link_id, epoch)""", "dec")
def frame_rule(spark, sf):
    RG.register_allocator("by_queue", lambda decisions: decisions.withColumn("budget", F.col("queue_fh")))
    return RG.allocate("by_queue", V.decisions(spark, sf), V.FAST).select(*ID, F.round(F.col("budget") + 1e-9, 5).alias("budget"))


@query("udf_allocator_pandas", """, b AS (SELECT *, least(greatest(label * priority, 0.0), 150.0) AS x FROM dec)
    SELECT link_id, epoch, cell_id, round(CASE WHEN sum(x) OVER g > 360 THEN x * 360 / sum(x) OVER g ELSE x END + 1e-9, 5) AS budget FROM b WINDOW g AS (PARTITION BY link_id, epoch)""", "dec")
def pandas_rule(spark, sf):
    """A per-decision pandas function; every (link, epoch) is one small group."""
    def by_label(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.assign(budget=pdf["label"] * pdf["priority"])[["link_id", "epoch", "cell_id", "cap", "capacity", "budget"]]

    RG.register_allocator("by_label", by_label, "link_id bigint, epoch bigint, cell_id bigint, cap double, capacity double, budget double")
    d = V.decisions(spark, sf).select("link_id", "epoch", "cell_id", "cap", "capacity", "label", "priority")
    return RG.allocate("by_label", d, V.FAST).select(*ID, F.round(F.col("budget") + 1e-9, 5).alias("budget"))


@query("udf_method_registry", wf_sql("dec", "backlog + persist", "weight") + "SELECT 'queue_aware' AS method, link_id, epoch, cell_id, round(budget + 1e-9, 5) AS budget FROM wf", "dec")
def by_name(spark, sf):
    return RG.allocate("queue_aware", V.decisions(spark, sf), V.FAST, margin=0.0).select("method", *ID, F.round(F.col("budget") + 1e-9, 5).alias("budget"))


@query("udf_forecaster_wrapper", "SELECT link_id, cell_id, epoch, " + ", ".join(
    f"round({sql_interp('q', f'least(greatest({a}::DOUBLE + 0.1::DOUBLE, 0.05), 0.95)', False)} + 1e-9, 5) AS q{i + 1}" for i, a in enumerate(_KNOTS)) + " FROM fc5 WHERE obs_slot >= 35", "fc5")
def wrapped(spark, sf):
    RG.register_forecaster("window_shifted", RG.shifted(series.window_forecast, 0.1))
    f = RG.forecast("window_shifted", V.packed(spark, sf), V.FAST).where(series.enough_history(V.FAST))
    return f.select("link_id", "cell_id", "epoch", *[F.round(F.get("q", F.lit(i)) + 1e-9, 5).alias(f"q{i + 1}") for i in range(6)])
