"""Time the headline queries: one JSON line on standard output.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores; BENCH_QUERIES names other queries
("all" for every one). Each query is executed in full into Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from fieldcal.catalog import QUERIES

HEADLINE = [
    "integrate_station_mobile", "mobile_feed_hours", "station_feed_clean", "pivot_readings_mean", "hourly_rollup_stats",
    "calendar_features", "radius_filter", "two_regime_scoring", "prediction_writeback", "threshold_sweep_scores",
    "formula_ranking", "regression_metric_table", "linear_rescale", "baseline_median_delta", "unseen_group_fallback",
    "score_summary_by_group", "describe_table", "correlation_table", "histogram_30", "kde_by_category",
    "ensemble_quantile_rows", "seed_quantile_table", "best_models", "boxplot_data", "exact_train_test_split",
    "contiguous_fold_numbers", "zip_positions", "scale_standard", "scale_robust", "rare_target_augment", "kruskal_h",
    "mannwhitney_u", "holm_matrix", "wilcoxon_signed", "chi2_2x2", "convex_hull", "lines_anti_join", "csv_roundtrip",
    "results_json_flatten", "fit_linear", "fit_elasticnet", "fit_forest", "fit_gbt", "fit_knn",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("fieldcal-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start the engine
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
