"""Time the headline queries: BENCH_SF_DIR (default sf0.1) on local[BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog.queries import QUERIES, table  # noqa: E402
from brightloom.operators import correlation, duplicates, profile  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

NAMES = (
    "inspect_columns", "quality_score", "dup_detect_wide", "dup_remove_first", "missing_scan",
    "impute_median", "impute_mode", "forward_fill", "outliers_iqr", "outliers_zscore", "outliers_iforest",
    "outlier_cap", "encode_label", "encode_label_many_values", "encode_onehot", "scale_standard",
    "scale_robust", "corr_long", "histogram", "boxplot", "missing_heatmap", "recipe_replay",
    "profile_row", "kb_recommendations", "cosine_topk", "assignments_validate", "audit_undo_last",
    "train_regressor",
)


def measures(spark):
    """The measurements of the baseline table, on whole lineitem."""
    lineitem = table(spark, FOLDER, "lineitem")
    fresh = lambda **k: profile.TableStats(lineitem, **k)

    def quartiles(exact):
        stats = fresh(exact=exact)
        return stats.quartiles()

    return {
        "base_distinct_exact": lambda: fresh().distinct,
        "base_distinct_approx": lambda: fresh(exact=False).distinct,
        "base_quartiles_exact": lambda: quartiles(True),
        "base_quartiles_approx": lambda: quartiles(False),
        "base_duplicate_rows": lambda: duplicates.detect(lineitem).collect(),
        "base_correlation": lambda: correlation.matrix(lineitem),
    }


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    table(spark, FOLDER, "lineitem").count()
    times = {}
    for name, run in measures(spark).items():
        started = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - started, 3)
    for name in NAMES:
        started = time.perf_counter()
        QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": FOLDER.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
