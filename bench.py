"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  folder with the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 4)
BENCH_RUNS    timed runs per query after one warm-up run; the median counts (default 3)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tools")]

HEADLINE = [
    # table steps
    "filter_gt", "filter_and_or", "filter_scalar_subquery", "agg_sum_coerced", "group_avg", "group_collect",
    "group_all_cmp", "having_and", "select_distinct", "order_desc", "topk", "limit_exploded", "intersect_keep_dups",
    "union_distinct", "split_id_algebra", "arith_columns", "fn_julianday",
    # derived columns
    "derive_list", "derive_max_years", "derive_first_number",
    # records
    "spec_matching_rows", "spec_aggregate", "spec_answers",
    # scoring
    "normalize_answer", "typed_value", "score_flexible", "score_fuzzy", "score_by_checkpoint", "accuracy_by_operator",
    # corpus building
    "attach_targets", "keep_all_forms_ok", "pivot_forms", "prefix_budget", "serialize_table", "permute_table",
    # plan corpus
    "plan_descendants", "plan_exec_status", "plan_tokens", "plan_edges_from_text", "plan_text_preorder",
]


def main() -> None:
    from check import spark_session

    from tablesteps.catalog import QUERIES

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "4")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = spark_session(cores)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
        "cores": int(cores),
        "runs": runs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
