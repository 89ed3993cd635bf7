"""Outliers: bounds by quartiles, z-score or isolation forest; detection and treatment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.errors import StepError
from brightloom.functions.columns import (
    col, dtype_of, head, is_numeric, replace_columns, require, rounded, sample_of, side_by_side,
)
from brightloom.operators import forest
from brightloom.operators.profile import TableStats, as_stats, count_outside

METHODS = ("iqr", "zscore", "iforest")
ACTIONS = ("remove", "cap", "keep")
FEWEST = 5      # columns with fewer values are left alone

Bounds = tuple[float | None, float | None]


def bounds_of(table, columns: Sequence[str] | None = None, method: str = "iqr",
              threshold: float = 3.0, contamination: float = 0.05, k: float = 1.5) -> dict[str, Bounds]:
    """(lower, upper) per numeric column with at least five values.

    Bounds are None where nothing can be an outlier (no spread under z-score).
    """
    stats = as_stats(table)
    if method not in METHODS:
        raise StepError("outliers", f"unknown method '{method}'")
    columns = stats.numeric if columns is None else list(columns)
    columns = [c for c in columns if stats.present(c) >= FEWEST]
    if method == "iqr":
        return stats.iqr_bounds(columns, k)
    if method == "zscore":
        bounds: dict[str, Bounds] = {}
        for c, m in stats.moments(columns).items():
            spread = m["variance"] ** 0.5
            bounds[c] = (
                (m["mean"] - threshold * spread, m["mean"] + threshold * spread)
                if spread > 0 else (None, None)
            )
        return bounds
    present = {c: stats.present(c) for c in columns}
    return {c: f.bounds for c, f in forest.fit_all(stats.df, columns, contamination, present).items()}


def _counts(stats, columns, method, threshold, contamination, k):
    """(bounds, outlier count) per column."""
    if method == "iforest":
        present = {c: stats.present(c) for c in columns if stats.present(c) >= FEWEST}
        fitted = forest.fit_all(stats.df, list(present), contamination, present)
        return {c: (f.bounds, f.outliers) for c, f in fitted.items()}
    bounds = bounds_of(stats, columns, method, threshold, contamination, k)
    known = {c: b for c, b in bounds.items() if b[0] is not None}
    if method == "iqr" and k == 1.5 and set(columns) == set(stats.numeric):
        counts = stats.iqr_outliers
    else:
        counts = count_outside(stats.df, known)
    return {c: (b, counts.get(c, 0)) for c, b in bounds.items()}


def detect(table, method: str = "iqr", threshold: float = 3.0, contamination: float = 0.05,
           columns: Sequence[str] | None = None, k: float = 1.5) -> DataFrame:
    """column, outliers, percentage of all rows, lower_bound, upper_bound."""
    stats = as_stats(table)
    if method not in METHODS:
        raise StepError("outliers", f"unknown method '{method}'")
    columns = stats.numeric if columns is None else list(columns)
    rows = [
        (c, n, round(n / stats.rows * 100, 2), rounded(lower, 3), rounded(upper, 3))
        for c, ((lower, upper), n) in
        _counts(stats, columns, method, threshold, contamination, k).items()
    ]
    return stats.df.sparkSession.createDataFrame(
        rows, "column string, outliers long, percentage double, lower_bound double, upper_bound double"
    )


def recommend(table) -> DataFrame:
    """Advice per column with quartile outliers: remove below 5 %, cap up to 15 %, else keep."""
    stats = as_stats(table)
    rows = []
    for c in stats.numeric:
        outliers = stats.iqr_outliers.get(c, 0)
        if stats.present(c) < FEWEST or not outliers:
            continue
        share = outliers / stats.rows * 100
        if share < 5.0:
            action = "remove"
            reason = f"Only {share:.2f}% of the rows lie outside: removing them costs little."
        elif share <= 15.0:
            action = "cap"
            reason = (f"{share:.2f}% of the rows lie outside: moving their values to the "
                      "bounds keeps the rows.")
        else:
            action = "keep"
            reason = (f"{share:.2f}% of the rows lie outside: so many belong to the "
                      "shape of the column.")
        rows.append((c, outliers, round(share, 2), "iqr", action, reason))
    return stats.df.sparkSession.createDataFrame(
        rows,
        "column string, outliers long, percentage double, recommended_method string, "
        "recommended_action string, reason string",
    )


def fit(df: DataFrame, column: str, method: str = "iqr", action: str = "remove",
        threshold: float = 3.0, contamination: float = 0.05, k: float = 1.5) -> dict:
    """What a treatment needs to know: bounds, and the inlier ranges of a forest."""
    require(df, [column])
    if method not in METHODS or action not in ACTIONS:
        raise StepError("outliers", f"unknown method '{method}' or action '{action}'")
    if not is_numeric(dtype_of(df, column)):
        raise StepError("outliers", f"column '{column}' is not numeric")
    state = {"column": column, "action": action, "lower": None, "upper": None, "inliers": None}
    stats = TableStats(df.select(col(column)))
    if action == "keep" or stats.present(column) < FEWEST:
        return state
    if method == "iforest":
        fitted = forest.fit(stats.df, column, contamination, stats.present(column))
        state["lower"], state["upper"] = fitted.bounds
        state["inliers"] = fitted.inlier_ranges
    else:
        state["lower"], state["upper"] = bounds_of(stats, [column], method, threshold, k=k)[column]
    return state


def outlier_mask(state: dict) -> Column:
    """True for an outlier, False for an inlier or a NULL."""
    value = col(state["column"])
    if state["inliers"] is not None:
        if not state["inliers"]:
            return value.isNotNull()
        # Inside when more of the (disjoint, ascending) ranges have begun than ended.
        lows, highs = (F.array(*[F.lit(float(x)) for x in side]) for side in zip(*state["inliers"]))
        begun = F.size(F.filter(lows, lambda x: x <= value))
        ended = F.size(F.filter(highs, lambda x: x < value))
        return F.coalesce(value.isNotNull() & (begun == ended), F.lit(False))
    if state["lower"] is None:
        return F.lit(False)
    return F.coalesce((value < state["lower"]) | (value > state["upper"]), F.lit(False))


def clip(value: Column, lower: float, upper: float) -> Column:
    """Clip to bounds; NULL stays NULL (least/greatest would skip it)."""
    return F.when(value < lower, F.lit(lower)).when(value > upper, F.lit(upper)).otherwise(
        value.cast("double")
    )


def transform(df: DataFrame, state: dict) -> DataFrame:
    if state["action"] == "keep" or state["lower"] is None:
        return df
    if state["action"] == "remove":
        return df.where(~outlier_mask(state))
    c = state["column"]
    return replace_columns(df, {c: clip(col(c), state["lower"], state["upper"])})


def treat(df: DataFrame, column: str, method: str = "iqr", action: str = "remove",
          threshold: float = 3.0, contamination: float = 0.05, k: float = 1.5) -> DataFrame:
    return transform(df, fit(df, column, method, action, threshold, contamination, k))


def keep_between(df: DataFrame, column: str, lower: float, upper: float) -> DataFrame:
    """Rows whose value lies in the bounds or is missing."""
    require(df, [column])
    return df.where(col(column).between(lower, upper) | col(column).isNull())


def preview(df: DataFrame, column: str, method: str = "iqr", action: str = "remove",
            threshold: float = 3.0, contamination: float = 0.05,
            order_by: Sequence[str] | None = None, n: int = 10) -> DataFrame:
    """affected_rows, up to ten outlier rows, the same rows after the treatment."""
    # the bounds do not depend on the action; a kept outlier is still shown
    state = fit(df, column, method, "cap", threshold, contamination)
    outliers = df.where(outlier_mask(state))
    few = head(outliers, n, order_by)
    after = {"remove": few.limit(0), "keep": few}.get(action)
    if after is None:
        after = transform(few, state)
    return side_by_side(
        df.sparkSession,
        affected_rows=outliers.agg(F.count(F.lit(1))),
        sample_before=sample_of(few, order_by),
        sample_after=sample_of(after, order_by),
    )


def total_outliers(detected: DataFrame) -> DataFrame:
    return detected.agg(F.coalesce(F.sum("outliers"), F.lit(0)).alias("total_outliers"))
