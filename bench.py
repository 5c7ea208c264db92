"""Wall time of the headline queries; prints one JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8).
Every query runs once to warm code generation and Python workers, then once measured; all result rows are produced and
dropped by the ``noop`` sink.
"""
from __future__ import annotations

import json
import os
import time

from capshare.plans import catalog
from capshare.session import build_session

HEADLINE = [
    "src_5_event_slots", "wn_5_required_rate", "wn_9_window_forecast", "ml_1_training_table", "ml_4_ensemble_scoring_arrow",
    "al_1_water_fill", "al_4_deadline_aware", "al_10_equal_risk", "al_12_two_stage_greedy", "str_4_fifo_replay", "str_5_calibration",
    "ag_1_violation_ratios", "ag_10_summary", "ag_15_forecast_scores", "st_2_bootstrap_reduction", "st_4_holm", "jn_2_as_of_events",
    "cp_1_block_float", "cp_4_sparse_per_row", "st_8_grid_tuning", "wn_10_persistence", "str_1_tumbling_slots", "str_2_sliding_horizons"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(cpus, "bench", shuffle_partitions=2 * int(cpus))
    queries = catalog.queries()
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    times = {}
    for name in only or HEADLINE:
        for _ in range(2):
            t = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t, 3)
    spark.stop()
    print(json.dumps({"metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(os.path.normpath(sf)).removeprefix("sf")}))


if __name__ == "__main__":
    main()
