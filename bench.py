"""Headline queries on local cores; prints one JSON line with the seconds of each."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelcast.session import build_session
from panelcast.workload import QUERIES

HEADLINE = (
    "resample_sum", "fill_gaps", "winsorize", "series_summary_global", "feature_matrix",
    "rolling_stats", "ewm_mean_daily", "acf", "correlation_matrix", "detect_date_scored",
    "detect_target", "infer_frequency", "seasonal_decompose_daily", "model_holt_winters", "model_ar",
    "backtest", "leaderboard_rmse", "time_series_folds", "walk_forward_accuracy", "ensemble_weights",
    "stacking", "model_knn", "model_ridge", "model_gbt", "insight_rules", "run_all_datasets",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cores}]", **{
        "spark.sql.shuffle.partitions": cores, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g",
    })
    spark.sparkContext.setLogLevel("OFF")
    QUERIES["read_sales_table"](spark, folder).count()  # warm-up, not timed
    times = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
