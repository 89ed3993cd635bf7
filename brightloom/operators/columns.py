"""Dropping, renaming and casting columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightloom.errors import ColumnNotFound, InvalidDtype, StepError
from brightloom.functions.columns import (
    TEMPORAL, col, dtype_of, is_text, replace_columns, require, text_of,
)
from brightloom.operators.profile import parse_date

TARGETS = ("int", "float", "string", "datetime")


def drop(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    require(df, columns)
    gone = set(columns)
    return df.select(*[col(c) for c in df.columns if c not in gone])


def rename(df: DataFrame, old_name: str, new_name: str) -> DataFrame:
    return rename_all(df, [(old_name, new_name)])


def rename_all(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Apply renames one after the other, as a single projection."""
    names = list(df.columns)
    for old, new in pairs:
        if old not in names:
            raise ColumnNotFound(old)
        if new != old and new in names:
            raise StepError("column_rename", f"column '{new}' exists already")
        names[names.index(old)] = new
    return df.select(*[col(c).alias(n) for c, n in zip(df.columns, names)])


def _converted(value: Column, dtype: T.DataType, target: str) -> Column:
    """The value in the target type, NULL when it does not convert."""
    if target in ("int", "float"):
        return value.try_cast("double") if is_text(dtype) else value.cast("double")
    if target == "datetime":
        if isinstance(dtype, TEMPORAL):
            return value.cast("timestamp")
        return parse_date(value.cast("string"))
    return text_of(value, dtype)


def cast_problems(df: DataFrame, column: str, target: str) -> dict:
    """Values that do not convert, fractions that a whole number would lose, one example."""
    require(df, [column])
    if target.lower() not in TARGETS:
        raise InvalidDtype(column, target, "unsupported target type")
    value, dtype = col(column), dtype_of(df, column)
    converted = _converted(value, dtype, target.lower())
    bad = value.isNotNull() & converted.isNull()
    if target.lower() == "int":
        fractional = converted.isNotNull() & (converted != F.floor(converted))
    else:
        fractional = F.lit(False)
    row = df.agg(
        F.count(value).alias("present"), F.count_if(bad).alias("failing"),
        F.count_if(fractional).alias("fractional"),
        F.min(F.when(bad | fractional, value.cast("string"))).alias("example"),
    ).first()
    return row.asDict()


def cast_check(df: DataFrame, column: str, target: str) -> DataFrame:
    """column, target, present, failing, fractional, castable; all-NULL is castable."""
    found = cast_problems(df, column, target)
    return df.sparkSession.createDataFrame(
        [(column, target.lower(), found["present"], found["failing"], found["fractional"],
          found["failing"] == 0)],
        "column string, target string, present long, failing long, fractional long, castable boolean",
    )


def require_castable(df: DataFrame, column: str, target: str) -> None:
    found = cast_problems(df, column, target)
    if found["failing"]:
        raise InvalidDtype(
            column, target, f"{found['failing']} values do not convert, for one '{found['example']}'"
        )
    if found["fractional"]:
        raise InvalidDtype(
            column, target, f"{found['fractional']} values have a fraction, for one '{found['example']}'"
        )


def cast_unchecked(df: DataFrame, column: str, target: str, null_text: str | None = None) -> DataFrame:
    """The cast itself; what does not convert becomes NULL."""
    target = target.lower()
    value, dtype = col(column), dtype_of(df, column)
    if target == "int" and not is_text(dtype) and not isinstance(dtype, (T.FloatType, T.DoubleType)):
        changed = value.cast("long")
    else:
        changed = _converted(value, dtype, target)
        if target == "int":
            whole = value.try_cast("long") if is_text(dtype) else changed.cast("long")
            changed = F.coalesce(whole, changed.cast("long"))
    if target == "string" and null_text is not None:
        changed = F.coalesce(changed, F.lit(null_text))
    return replace_columns(df, {column: changed})


def cast(df: DataFrame, column: str, target: str, null_text: str | None = None) -> DataFrame:
    """Cast a column; a value that does not convert is an error, NULL stays NULL."""
    if target.lower() != "string":
        require_castable(df, column, target)
    else:
        require(df, [column])
    return cast_unchecked(df, column, target, null_text)


