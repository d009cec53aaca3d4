"""Timed run of the headline queries. Prints one JSON line.

Stage tables are built first and timed on their own (``stages``); queries then read them, as a pipeline
does. Every query writes its full result to the no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

STAGES = ("linked_visits", "slices", "conditions", "links", "tagged_stems", "cohort")
HEADLINE = ("condition_metrics", "percentile_gap_flags", "composition_topn", "cohort_flow", "join_audit", "concordance", "link_pairs", "mapping_audit",
            "longitudinal_analysis", "longitudinal_flow", "recruitment_dataset", "frame_continuity", "fates", "fate_growth", "coverage_reconstruction", "class_pivot",
            "unit_reconciliation", "group_constancy", "code_set_changes", "rank_metrics", "fold_metrics", "paired_differences", "risk_quartiles", "capacity_selection",
            "policy_sweep", "bootstrap_group_ci", "bootstrap_paired_brier", "bootstrap_paired_auc", "train_only_scaling", "greedy_folds", "ridge_crossfit", "glm_odds_ratios",
            "temporal_check")
# 300 refits each: minutes at this scale, so they run only when named
LONG = ("refit_bootstrap", "policy_bootstrap")


def main() -> None:
    from tallyspark.plans import registry, tables
    from tallyspark.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus)
    queries = registry.queries()
    wanted = sys.argv[1:] or HEADLINE
    # start the JVM, the code generator and the Python workers outside the clock
    spark.range(1000).selectExpr("id % 7 AS k", "id").groupBy("k").sum("id").collect()
    spark.range(8).mapInArrow(lambda it: it, "id long").count()
    stages, times = {}, {}
    start = time.time()
    for name in STAGES:
        t = time.time()
        getattr(tables, name)(spark, sf)
        stages[name] = round(time.time() - t, 3)
    for name in wanted:
        t = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(time.time() - start, 3), "unit": "sec", "queries": times, "stages": stages,
                      "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
