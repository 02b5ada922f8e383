"""Time the headline queries and print one JSON line.

BENCH_SF_DIR picks the data (default sf0.1), BENCH_CPUS the local cores (default 8).
"""

from __future__ import annotations

import json
import os
import re
import time

from shoalmap.plans import QUERIES
from shoalmap.session import local_session

HEADLINE = (
    "c04_presence_absence",
    "c06_predict_universe",
    "d06_collapse_years",
    "d08_species_meta",
    "d11_richness_huc8",
    "d12_confusion_by_huc",
    "d15_mean_over_estimators",
    "d19_merge_species",
    "d25_stack_predictions",
    "d33_feature_importance",
    "d33_feature_importance_equal",
    "d34_location_weights",
    "d36_threshold_loss",
    "d37_losses",
    "e05_roc_auc",
    "e09_id_blocks",
    "g01_repeated_kfold",
    "h02_impute_knn",
    "h07_lpm_all_species",
    "h14_predict_oof",
    "h21_nw_predict",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "shoalmap-bench")
    spark.sparkContext.setLogLevel("ERROR")
    # One small query first, so that no measured query pays for starting the engine.
    QUERIES["d11_richness_huc8"](spark, sf_dir).collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)$", sf_dir.rstrip("/"))
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else sf_dir,
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
