"""Time the headline queries: one warm-up run, then one timed run each. Whole grid searches are left out.
A first run of over `LONG` seconds counts as it is.

Reads ``BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[BENCH_CPUS]`` and prints one JSON
line at the end, and each time as it is known to stderr. A run covers building the plan and computing every result row.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from ebbline.plans import catalog, fixtures  # noqa: E402
from ebbline.plans.catalog import modelling  # noqa: E402
from ebbline.session import local_session  # noqa: E402

HEADLINE = [
    "p07_clean_table",
    "p14_engineered_features",
    "c04_effect_by_level",
    "c09_describe",
    "c11_column_profile",
    "c16_categorical_summary",
    "c19_correlation_matrix",
    "c22_histogram",
    "c23_box_statistics",
    "c40_top_levels",
    "t01_chi_square",
    "t05_anova",
    "t08_effect_summary",
    "e03_nearest_controls",
    "e04_stratified_effect",
    "e05b_adjusted_level_contrasts",
    "e08_confounder_sensitivity",
    "f06_stratified_split",
    "m04_one_hot_levels",
    "m08_forest_importance",
    "v02_roc_auc",
    "v10_threshold_sweep",
    "v11_comprehensive_report",
    "x02_attribution_importance",
    "s01_batch_scoring",
    "s03_explained_scores",
]


#: Seconds of a first run after which no second run is made.
LONG = 30


def compute(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    compute(fixtures.churn_base(spark, folder))
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            # Fits are shared inside a run, not between runs.
            modelling.forget_fits()
            started = time.time()
            compute(catalog.QUERIES[name](spark, folder))
            seconds[name] = round(time.time() - started, 3)
            if seconds[name] > LONG:
                break
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
