"""Warm wall time of the headline queries; prints one JSON line.

BENCH_SF_DIR   tables to read   (default /root/testdata/sf0.1)
BENCH_CPUS     local cores      (default 8)
BENCH_ONLY     comma list of query names, or ``all`` for every registered query
BENCH_REPEAT   timed runs after one warm-up run; the median counts (default 2)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sievecrest.catalog import load  # noqa: E402
from sievecrest.session import build_session  # noqa: E402

HEADLINE = (
    "class_priors prior_corrected_probs best_threshold_by_group calibrate_to_positive_count eval_summary "
    "probability_distribution average_percent_rank unique_rank_descending stratified_split stratified_kfold "
    "stratified_group_split rebalance_to_ratio stratified_take keep_first_per_key duplicate_id_check "
    "model_label_votes baseline_diff_by_model asset_resolution mask_fanout vector_pooling ensemble_search "
    "exact_cosine_knn neighbour_evidence label_conflict_audit risk_table consensus_tiers test_time_views "
    "image_hashes first_wins_dedup normalize_text keyword_detection page_links epoch_selection"
).split()


def run(fn, spark, folder) -> float:
    started = time.perf_counter()
    fn(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_ONLY", "")
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    queries, _ = load()
    names = list(queries) if only == "all" else [n for n in only.split(",") if n] or HEADLINE
    spark = build_session("bench", cpus, **{"spark.ui.showConsoleProgress": "false"})
    times = {}
    for name in names:
        try:
            run(queries[name], spark, folder)
            times[name] = round(statistics.median(run(queries[name], spark, folder) for _ in range(repeat)), 3)
        except Exception as e:  # noqa: BLE001
            times[name] = None
            print(f"{name}: {type(e).__name__}: {str(e)[:300]}", file=sys.stderr)
    total = round(sum(t for t in times.values() if t is not None), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": folder, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
