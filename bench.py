"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

import json
import os
import statistics
import time

from rowledger.plans import bindings as B
from rowledger.plans.queries import REGISTRY
from rowledger.session import local_session

HEADLINE = [
    "diff_value_update", "diff_lineitem", "diff_crowded_keys", "conflict_cell_overlap",
    "summary_by_cr", "validate_keys", "apply_update", "apply_sequence", "apply_all_tables", "review_grid",
    "render_lines", "scan_marker_block", "normalize_key",
]

# a query is not repeated once it has used this many seconds
SLOW_ENOUGH = 8.0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=cpus, app="rowledger-bench")
    spark.sparkContext.setLogLevel("ERROR")
    # the log and its conflicts are written once and shared, as in a run
    started = time.perf_counter()
    B.change_log(spark, sf_dir)
    seconds, runs_of = {"write_change_log": round(time.perf_counter() - started, 3)}, {"write_change_log": 1}
    REGISTRY["conflicts_flat"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in only:
        taken = []
        while len(taken) < runs and sum(taken) < SLOW_ENOUGH:
            started = time.perf_counter()
            REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - started)
        seconds[name], runs_of[name] = round(statistics.median(taken), 3), len(taken)
    print(json.dumps({
        "metric": "sum of median query seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus, "runs": runs_of,
        "spark": spark.version,
    }))


if __name__ == "__main__":
    main()
