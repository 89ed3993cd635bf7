"""Small tables behind charts: histogram, boxplot, heatmap, class bars, scatter."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.functions.columns import col, dtype_of, head, is_numeric, ordering, require, rounded
from brightloom.functions.values import rows_at
from brightloom.operators.profile import TableStats
from brightloom.operators.quality import class_counts

# Sizes of the chart samples.
HEATMAP_ROWS = 150
BOXPLOT_POINTS = 100
SCATTER_POINTS = 100

HISTOGRAM_SCHEMA = "bin_start double, bin_end double, bin_label string, count long"


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins, the last one closed; empty bins are kept."""
    require(df, [column])
    if not 2 <= bins <= 100:
        raise ValueError("bins must be between 2 and 100")
    spark = df.sparkSession
    if not is_numeric(dtype_of(df, column)):
        return spark.createDataFrame([], HISTOGRAM_SCHEMA)
    value = col(column).cast("double")
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None:
        return spark.createDataFrame([], HISTOGRAM_SCHEMA)
    if low == high:
        low, high = low - 0.5, high + 0.5
    edges = [float(e) for e in np.linspace(low, high, bins + 1)]
    # The first guess may be one off at an edge; the edges themselves decide.
    guess = F.least(F.floor((value - low) * F.lit(bins / (high - low))).cast("int"), F.lit(bins - 1))
    ladder = F.array(*[F.lit(e) for e in edges])
    slot = (
        F.when(value < ladder[guess], guess - 1)
        .when((guess < bins - 1) & (value >= ladder[guess + 1]), guess + 1)
        .otherwise(guess)
    )
    counted = (
        df.where(col(column).isNotNull()).select(slot.alias("bin"))
        .groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    )
    shown = spark.createDataFrame(
        [(i, round(a, 3), round(b, 3), f"{round(a, 1)}-{round(b, 1)}")
         for i, (a, b) in enumerate(zip(edges, edges[1:]))],
        "bin int, bin_start double, bin_end double, bin_label string",
    )
    return shown.join(counted, "bin", "left").orderBy("bin").select(
        "bin_start", "bin_end", "bin_label", F.coalesce("count", F.lit(0)).alias("count")
    )


def boxplot(df: DataFrame, column: str, order_by: Sequence[str] | None = None) -> DataFrame:
    """Five-number summary with whisker fences and up to 100 outliers, first by ``order_by``."""
    require(df, [column])
    spark = df.sparkSession
    schema = (
        "column string, min double, q1 double, median double, q3 double, max double, "
        "lower_whisker double, upper_whisker double, outliers_count long, "
        "outliers_sample array<double>"
    )
    if not is_numeric(dtype_of(df, column)):
        return spark.createDataFrame([], schema)
    kept = list(dict.fromkeys([*(order_by or []), column]))
    narrow = df.select(*[col(c) for c in kept])
    q1, median, q3 = TableStats(narrow).quartiles([column])[column]
    if q1 is None:
        return spark.createDataFrame([], schema)
    lower, upper = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    value = col(column).cast("double")
    outside = (value < lower) | (value > upper)
    found = narrow.agg(
        F.min(F.when(value >= lower, value)).alias("low"),
        F.max(F.when(value <= upper, value)).alias("high"),
        F.count_if(outside).alias("n"),
    ).first()
    sample = [
        rounded(r["v"], 3)
        for r in head(narrow.where(outside), BOXPLOT_POINTS, order_by).select(value.alias("v")).collect()
    ]
    row = (
        column, rounded(found["low"], 3), rounded(q1, 3), rounded(median, 3), rounded(q3, 3),
        rounded(found["high"], 3), rounded(lower, 3), rounded(upper, 3), found["n"], sample,
    )
    return spark.createDataFrame([row], schema)


def missing_heatmap(df: DataFrame, order_by: Sequence[str] | None = None,
                    max_rows: int = HEATMAP_ROWS) -> DataFrame:
    """Evenly spaced rows (at most ``max_rows``), each column 1 where missing, else 0.

    The rows are numbered by a distributed sort of the order columns and the flags;
    no task sees the whole table.
    """
    flags = [col(c).isNull().cast("int").alias(c) for c in df.columns]
    keys = [col(c).alias(f"_k{i}") for i, c in enumerate(order_by or [])]
    require(df, order_by or [])
    total = df.count()
    if total > max_rows:
        positions = [int(p) for p in np.linspace(0, total - 1, max_rows).astype(np.int64)]
    else:
        positions = list(range(total))
    narrow = df.select(*keys, F.struct(*flags).alias("_flags"))
    order = ordering(narrow, [f"_k{i}" for i in range(len(keys))])
    picked = rows_at(narrow, order, positions, "_row_index")
    return picked.select(
        F.col("_row_index").alias("row_index"), *[F.col("_flags")[c].alias(c) for c in df.columns]
    )


def class_bars(df: DataFrame, target: str) -> DataFrame:
    """name, count per class, largest first."""
    return class_counts(df, target).select(F.col("class").alias("name"), "count")


def scatter(df: DataFrame, x: str, y: str, order_by: Sequence[str] | None = None,
            n: int = SCATTER_POINTS) -> DataFrame:
    """x, y of the first ``n`` rows, a missing value drawn as 0."""
    require(df, [x, y])
    points = head(df, n, order_by)
    return points.select(
        F.coalesce(col(x).cast("double"), F.lit(0.0)).alias("x"),
        F.coalesce(col(y).cast("double"), F.lit(0.0)).alias("y"),
    )


