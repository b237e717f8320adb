"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default: all cores).
Each query is built and fully materialised (noop sink) in a warm session; best of BENCH_REPEAT runs.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "cohort_outcome", "cohort_flagged_outcome", "cohort_observation", "wide_temporal", "wide_waves", "seq_long",
    "split_stratified", "split_chronological", "fit_numeric", "transform_wide", "auroc", "metric_row",
    "spearman", "profile_numeric", "findings", "remove_measurements", "remove_visits", "jitter_timing",
    "apply_visit_changes", "score_batch",
)


def main() -> None:
    from checks.queries import QUERIES

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["cohort_outcome"](spark, sf).write.format("noop").mode("overwrite").save()   # warm up
    took = {}
    for name in names:
        best = float("inf")
        for _ in range(repeat):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        took[name] = round(best, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": Path(sf).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
