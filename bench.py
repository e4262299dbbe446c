"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

# One or more queries per operator family.
HEADLINE = (
    "group_auto", "group_by_functions", "merge_left", "merge_outer", "drop_duplicates", "contingency",
    "correlation_pairs", "quantiles", "group_quantiles", "average_ranks", "row_number", "evenly_downsample_sorted",
    "impute_static", "impute_by_block", "null_runs", "interpolate", "clean_static", "clean_frequency",
    "quality_report", "numeric_profile", "categorical_profile", "extended_summary",
    "two_sample_ttest", "one_way_anova", "chi_square_independence", "mann_whitney_u", "kruskal_wallis", "iqr_report",
    "smart_encode", "label_encode", "target_encoder_apply", "scale_features", "prepare_features", "linear_regression",
    "histogram", "box_data", "line_data", "flagship",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from queries import QUERIES

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tabprep-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM paths and the Python workers outside the timings.
    QUERIES["group_auto"](spark, folder).write.format("noop").mode("overwrite").save()
    rows = {
        name: spark.read.parquet(f"{folder}/{name}.parquet").count()
        for name in ("lineitem", "orders", "events", "part", "customer")
    }
    names = sys.argv[1:] or HEADLINE
    seconds: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}s", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "rows": rows,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
