"""Quality score with its penalties, class imbalance, and the quality report."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.errors import ColumnNotFound
from brightloom.functions.columns import dtype_of, text_of
from brightloom.functions.values import value_counts
from brightloom.operators import duplicates
from brightloom.operators.profile import as_stats

# What each finding costs, and from which percentage on.
DUPLICATE_PENALTY = 10
MISSING_PENALTY, MISSING_PERCENT = 20, 20
OUTLIER_PENALTY, OUTLIER_PERCENT = 15, 5
CARDINALITY_PENALTY = 10
IMBALANCED_PERCENT = 75.0


def _findings(stats) -> list[tuple[str, str | None, float, int, str]]:
    if not stats.rows:
        return []
    found = []
    copies = duplicates.detect(stats.df).first()["duplicate_rows"]
    if copies:
        found.append(("duplicates", None, float(copies), DUPLICATE_PENALTY,
                      f"{copies} rows repeat others: -{DUPLICATE_PENALTY}"))
    for c in stats.columns:
        percent = stats.missing_percent(c)
        if percent > MISSING_PERCENT:
            found.append(("missing", c, percent, MISSING_PENALTY,
                          f"{percent:.1f}% of '{c}' is missing: -{MISSING_PENALTY}"))
    for c, outliers in stats.iqr_outliers.items():
        percent = outliers / stats.rows * 100
        if percent > OUTLIER_PERCENT:
            found.append(("outliers", c, percent, OUTLIER_PENALTY,
                          f"{percent:.1f}% of '{c}' lies outside: -{OUTLIER_PENALTY}"))
    for c in stats.high_cardinality:
        found.append(("cardinality", c, float(stats.distinct[c]), CARDINALITY_PENALTY,
                      f"'{c}' has very many values: -{CARDINALITY_PENALTY}"))
    return found


def penalties(table) -> DataFrame:
    """check, column, measured, penalty, warning - one row per finding."""
    stats = as_stats(table)
    return stats.df.sparkSession.createDataFrame(
        _findings(stats),
        "check string, column string, measured double, penalty int, warning string",
    )


def _score(stats) -> tuple[int, list[str]]:
    if not stats.rows:
        return 0, ["no rows: score 0"]
    found = _findings(stats)
    return max(0, 100 - sum(f[3] for f in found)), [f[4] for f in found]


def quality_score(table) -> DataFrame:
    """score (0 to 100) and the list of warnings."""
    stats = as_stats(table)
    return stats.df.sparkSession.createDataFrame(
        [_score(stats)], "score int, warnings array<string>"
    )


def class_counts(df: DataFrame, target: str) -> DataFrame:
    """class (as text), count; largest first, ties by class."""
    if target not in df.columns:
        raise ColumnNotFound(target)
    counted = value_counts(df, target)
    return counted.select(
        text_of(F.col("value"), dtype_of(df, target)).alias("class"), "count"
    ).orderBy(F.col("count").desc(), "class")


def class_imbalance(df: DataFrame, target: str) -> DataFrame:
    """ratio 'majority:rest' in percent, imbalanced (majority at least 75 %), classes, total."""
    if target not in df.columns:
        raise ColumnNotFound(target)
    sizes = value_counts(df, target).agg(
        F.max("count").alias("largest"), F.sum("count").alias("total"),
        F.count(F.lit(1)).alias("classes"),
    )
    share = F.col("largest") / F.col("total") * 100
    return sizes.select(
        F.when(F.col("total").isNull(), "0:0").otherwise(F.concat(
            F.bround(share).cast("long").cast("string"), F.lit(":"),
            F.bround(100 - share).cast("long").cast("string"),
        )).alias("ratio"),
        F.coalesce(share >= IMBALANCED_PERCENT, F.lit(False)).alias("imbalanced"),
        "classes", F.coalesce("total", F.lit(0)).alias("total"),
    )


REPORT_SCHEMA = (
    "summary struct<name: string, created_at: string, total_rows: bigint, total_columns: bigint, "
    "operations_count: bigint>, "
    "duplicates struct<duplicate_rows: bigint, duplicate_percent: double>, "
    "missing struct<columns_with_missing: bigint, details: array<struct<column: string, "
    "missing_count: bigint, percentage: double, recommended_strategy: string>>>, "
    "outliers struct<columns_with_outliers: bigint, details: array<struct<column: string, "
    "outliers_count: bigint, percentage: double, lower_bound: double, upper_bound: double>>>, "
    "quality_score struct<score: bigint, warnings: array<string>>"
)


def quality_report(table, name: str = "table", operations: int = 0,
                   created_at: str | None = None) -> DataFrame:
    """One nested row: summary, duplicates, missing, outliers, quality score."""
    from brightloom.operators import missing, outliers

    stats = as_stats(table)
    copies = duplicates.detect(stats.df).first()
    gaps = [tuple(r) for r in missing.recommend(stats).collect()]
    strange = [tuple(r) for r in outliers.detect(stats).where("outliers > 0").collect()]
    created = created_at or datetime.now(timezone.utc).isoformat()
    row = (
        (name, created, stats.rows, len(stats.columns), operations),
        (copies["duplicate_rows"], copies["duplicate_percent"]),
        (len(gaps), gaps), (len(strange), strange), _score(stats),
    )
    return stats.df.sparkSession.createDataFrame([row], REPORT_SCHEMA)


def write_report(table, path: str, name: str = "table", operations: int = 0) -> str:
    """Write the report as one JSON line into the folder ``path``."""
    report = quality_report(table, name, operations)
    report.coalesce(1).write.mode("overwrite").json(path)   # a single row
    return path


