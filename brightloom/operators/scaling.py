"""Standard, min-max and robust scaling of several columns at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.errors import StepError
from brightloom.functions.columns import (
    col, dtype_of, head, is_numeric, replace_columns, require, sample_of, side_by_side,
)
from brightloom.operators.profile import TableStats

METHODS = ("standard", "minmax", "robust")


def fit(df: DataFrame, columns: Sequence[str], method: str = "standard") -> dict:
    """Centre and width per column; a column without spread gets width 1."""
    require(df, columns)
    if method not in METHODS:
        raise StepError("scaling", f"unknown method '{method}'")
    for c in columns:
        if not is_numeric(dtype_of(df, c)):
            raise StepError("scaling", f"column '{c}' is not numeric")
    stats = TableStats(df.select(*[col(c) for c in columns]))
    parts: dict[str, list[float]] = {}
    if method == "robust":
        for c, (q1, median, q3) in stats.quartiles().items():
            parts[c] = [median, None if q1 is None else q3 - q1]
    else:
        for c, m in stats.moments().items():
            if method == "standard":
                parts[c] = [m["mean"], None if m["var_pop"] is None else m["var_pop"] ** 0.5]
            else:
                parts[c] = [m["min"], None if m["min"] is None else m["max"] - m["min"]]
    return {"method": method, "parts": {c: [a, b or 1.0] for c, (a, b) in parts.items()}}


def transform(df: DataFrame, state: dict) -> DataFrame:
    changes = {
        c: (col(c).cast("double") - F.lit(centre)) / F.lit(width)
        for c, (centre, width) in state["parts"].items() if centre is not None
    }
    return replace_columns(df, changes)


def scale(df: DataFrame, columns: Sequence[str], method: str = "standard") -> DataFrame:
    return transform(df, fit(df, columns, method))


def preview(df: DataFrame, columns: Sequence[str], method: str = "standard",
            order_by: Sequence[str] | None = None, n: int = 10) -> DataFrame:
    """affected_rows (all), the first ten rows before and after; fitted on all rows."""
    state = fit(df, columns, method)
    kept = list(dict.fromkeys([*(order_by or []), *columns]))
    few = head(df, n, order_by).select(*[col(c) for c in kept])
    return side_by_side(
        df.sparkSession,
        affected_rows=df.agg(F.count(F.lit(1))),
        sample_before=sample_of(few, order_by),
        sample_after=sample_of(transform(few, state), order_by),
    )
