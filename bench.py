"""Times the headline queries: one JSON line for ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Every query runs twice, planning included; ``queries`` holds the second (warm) run, ``cold`` the first.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from evidencelens import catalog  # noqa: E402
from evidencelens.session import local_session  # noqa: E402

HEADLINE = (
    "history_features", "history_feature_rows", "previous_episode", "time_since_action", "rolling_counts", "keypoint_coverage", "dropout_runs", "motion_curvature",
    "latency_summary", "bone_length_stability", "sign_flips", "sequence_scorecard", "metric_bundle", "binary_bundle", "class_group_features", "fold_feasibility", "bootstrap_ci",
    "validate_episodes", "validate_score_packets", "cohort_support", "id_set_digest", "lock_integrity", "tolerance_diff", "instance_sequence_stats", "overlapping_instances",
    "mask_stats", "mask_iou", "resample_curve", "curve_error", "contingency_ami", "outcome_dependence", "instrumentation_audit",
    "validate_documents", "sequence_scorecard_full", "variance_ratios", "unit_equal_deltas", "fold_medians", "grouped_evaluation", "assemble_episodes_stream",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "bench", shuffle=int(cores) if cores.isdigit() else 8)
    catalog.load()
    names = sys.argv[1:] or HEADLINE
    times, cold = {}, {}
    catalog.QUERIES["keypoint_coverage"](spark, folder).write.format("noop").mode("overwrite").save()  # JVM warm-up
    for name in names:
        for record in (cold, times):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            record[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "cold": cold, "sf": os.path.basename(folder.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()
