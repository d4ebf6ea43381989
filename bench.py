"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Every query runs once as warm-up and twice more; the median counts. Results are read to the
last row, so no part of a query can be skipped.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from checks.registry import QUERIES
from moralens.session import local_session
from moralens.sources.panel import staged_panel

HEADLINE = [
    "q_avg_payers", "q_top_clients", "quality_global", "quality_columns", "profile_numeric", "quality_rules",
    "dedupe", "target_distribution", "histogram", "kde", "month_crosstab", "crosstab_topk",
    "corr_pearson", "corr_spearman", "outliers_iqr", "box_stats_by_class", "num_vs_binary", "chi2", "mutual_info",
    "impute_median", "prep_full", "split_stratified", "undersample", "oversample", "smote", "metrics", "roc_points",
    "fit_lr", "fit_gbt",
]
REPEATS = 2


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench")
    start = time.perf_counter()
    staged_panel(spark, sf_dir)
    seconds = {"panel": round(time.perf_counter() - start, 3)}
    for name in HEADLINE:
        times = []
        for _ in range(REPEATS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": float(sf)}))


if __name__ == "__main__":
    main()
