"""Time the headline queries and print one JSON line.

Each query runs once to warm up, then three times, and the median counts; results go to the ``noop`` sink so that
no column is pruned away. ``BENCH_ALL=1`` times every registered query.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewatt import get_session  # noqa: E402
from tidewatt.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "bucket_mean", "resample_mean", "missing_fraction", "infer_step_median", "infer_step_mode", "hourly_profile", "day_hour_heatmap",
    "find_gaps", "lag_features", "rolling_full", "rolling_corr", "interpolate_linear", "fill_backward_forward", "time_split",
    "combined_flags", "clean_extremes_interpolate", "clean_sentinels_interpolate", "clean_table", "cleaning_report",
    "zscore_outlier_counts", "describe", "duplicate_rows", "sample_rows", "extremes_with_time", "histogram", "box_stats",
    "correlation_matrix", "acf", "pacf", "ccf", "seasonal_decompose", "seasonal_amplitude", "dominant_periods",
    "suggest_difference", "boxcox_hint", "forecast_metadata", "vif", "pca_variance", "discriminant_variance", "forecast_feature_table",
    "soc_feature_table", "forecast", "forecast_backtest", "lag_features_chunked", "acf_chunked", "interpolate_chunked", "describe_ranked", "ridge_fit", "daily_energy_summary", "clamped_running_balance", "fit_parameters",
    "capacity_sweep", "recommend_capacity",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = get_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = list(QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    if len(sys.argv) > 1:
        names = sys.argv[1:]
    seconds = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)
        print(f"{seconds[name]:8.3f} {name}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline query seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
