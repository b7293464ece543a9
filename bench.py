"""Headline benchmark: one JSON line with seconds per query.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list).
Each query runs once after a short warm-up and is fully evaluated into a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "backtest_minimum_slice", "a3_curve_subset", "b1_cycle_contract", "b12_fingerprint_table", "c1_stable_group_split", "d1_early_cycle_features", "d4_delta_q_features",
    "d6_curve_totals", "d11_capacity_signature", "e1_e4_base_forecasts", "e8_power_law", "e10_activation_power_law", "e11_structure_library", "e17_map_update", "e22_nearest_std_loo",
    "g1_trajectory_scores", "g8_comparison_summary", "h1_conformal_radius", "k1_censoring_curve", "k3_ipcw_brier", "q1_envelope_decisions", "q2_rank_for_issuance", "q6_risk_coverage_curve",
    "t2_group_bootstrap", "t11_permutation_control", "u1_future_label_firewall",
]


def main() -> None:
    from trajlytics.queries import catalog
    from trajlytics.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    runs = catalog.callables()
    spark = local_session(cpus, shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    runs["a1_scan_by_suffix"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        runs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()
