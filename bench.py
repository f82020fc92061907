"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

A query is timed until its whole result has been produced (a noop write). With
BENCH_RUNS=2 or more the best run counts, which leaves warm-up out.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from sylva.session import local_session  # noqa: E402
from sylva.workload import QUERIES  # noqa: E402

HEADLINE = [
    "a1_species_summary", "p15_biomass", "a3_biomass_total", "a5_slivers",
    "j1_compare_detections", "j2_erase_points", "j5_sample_pixels", "j6_nms", "j10_dedup", "j11_drop_short_bridges", "j13_clip_grid",
    "j16_apply_verdicts", "p6_cleared_mask", "r2_box_mean", "r3_box_max", "r6_core_mask", "r10_closing", "r13_slope", "a11_label_regions", "a12_fill_holes",
    "c1_detect_trees", "c2_detect_clearing", "c3_extract_roads",
    "f3_parse_latlon", "m3_coverage_runs", "m4_order_runs", "m6_suggest_direction", "w6_split_by_budget", "e1_threshold_sweep", "e4_point_score",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "sylva-bench")
    spark.read.parquet(f"{sf}/orders.parquet").count()
    times: dict[str, float] = {}
    for name in wanted:
        best = float("inf")
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        times[name] = round(best, 3)
        print(f"{name} {best:.2f}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
