"""Time the headline queries and print one JSON line.

Reads BENCH_SF_DIR (default /root/testdata/sf0.1) on local[BENCH_CPUS]. Each query starts without the
tables that earlier ones staged, so every time includes the whole work from the raw tables.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "session_gate_metrics", "w3_structural_features", "w4_payload_features", "w5_timing_features", "j2_multiscale_parents",
    "e22_graded_policy", "t3_hysteresis", "t5_memory_rules", "t6_trust_memory", "e24_perturbed_evaluation", "e26_sensitivity_grid",
    "m4_roc_auc", "m9_threshold_grid", "a15_domain_shift", "p2_hash_split", "p4_greedy_split", "p17_contaminated_baselines",
    "i1_bootstrap_interval", "e11_row_scores", "s2_variable_csv",
)


def main() -> None:
    from busward.catalog import QUERIES
    from busward.session import forget_staged, local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), memory=os.environ.get("BENCH_MEMORY", "12g"))
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        forget_staged()
        start = time.time()
        QUERIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
