"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query writes to the no-op sink, so the whole result is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "e1_confusion", "e3_average_precision", "e3_average_precision_global", "e4_calibration_error", "e9_threshold_sweep", "e10_operating_point",
    "e12_threshold_risk", "e13_evaluate_runs", "g6_loo_summary", "g11_recomputed_rows", "h2_paired_comparison", "b1_patch_validation", "b17_search_signature",
    "c6_stitched_map", "c10_pixel_features", "c12_augmented", "d2_hard_mining_sample", "f1_map_stats", "f2_components", "i14_blockers", "i20_champions", "i31_weight_backtest",
    "j1_mined_tiles",
]


def main() -> None:
    from evalgate.plans.catalog import QUERIES
    from evalgate.plans.registry import ROUNDING
    from evalgate.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    ROUNDING["on"] = False
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
