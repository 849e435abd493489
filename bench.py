"""Time the headline queries: one JSON line with seconds per query.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores, ``BENCH_QUERIES`` an
optional comma list of query names (``all`` for every query).
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "value_counts", "stride_splits", "node_histogram", "node_histogram_arrow", "best_split", "best_split_per_group",
    "categorical_subset_split", "tree_nodes", "tree_predict", "forest_average", "partial_ensembles", "boost_curve",
    "stencil_gather", "stencil_wide", "affinity_targets", "gaussian_derivative", "gaussian_bank", "augment_8",
    "truth_components", "image_spanning_forest", "watershed", "rand_stats", "malis_loss", "malis_sampled_loss",
    "pixel_confusion", "pooled_fscore", "roc_monotone", "rand_index", "rand_contingency", "adaptive_pixel_threshold",
]


def main() -> None:
    from silvagrid.catalog import QUERIES
    from silvagrid.session import session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = session("bench", f"local[{cpus}]", **{
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the engine before the clock
    seconds = {}
    for name in names:
        started = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
        print(name, seconds[name], file=sys.stderr)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
