"""Label, one-hot and ordinal encoding of categorical columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.errors import StepError
from brightloom.functions.columns import (
    col, dtype_of, head, is_nested, require, sample_of, side_by_side, text_of,
)
from brightloom.functions.values import (
    BROADCAST_CHARS, BROADCAST_ROWS, lookup, value_counts, with_row_index,
)
from brightloom.operators.profile import as_stats

METHODS = ("label", "onehot")
FEW_VALUES = 10_000     # maps up to this size are kept as plain data inside a recipe
HOT_VALUES = 200        # values above 1/200 of all rows are looked up by broadcast


def recommend(table) -> DataFrame:
    """One-hot for a categorical column of up to ten values, label codes beyond."""
    stats = as_stats(table)
    rows = []
    for c in stats.categorical:
        n = stats.distinct[c]
        if n <= 10:
            rows.append((c, n, "onehot", f"{n} values are few: one flag column "
                                         "for each keeps them apart."))
        else:
            rows.append((c, n, "label", f"{n} values would make as many flag "
                                        "columns: codes keep the table narrow."))
    return stats.df.sparkSession.createDataFrame(
        rows, "column string, unique_values long, recommended string, reason string"
    )


class CodeMap:
    """Codes 0, 1, ... of a column's values in text order, as a (key, code) table.

    ``key`` is the text of the value. Any number of values: the table is range-sorted
    and numbered in Spark; its size decides how it is joined.
    """

    def __init__(self, table: DataFrame, rows: int, chars: int, total: int):
        self.table, self.rows, self.chars, self.total = table, rows, chars, total

    @property
    def small(self) -> bool:
        return self.rows <= BROADCAST_ROWS and self.chars <= BROADCAST_CHARS

    @property
    def hot(self) -> DataFrame:
        """Keys held by more than 1/HOT_VALUES of the rows: fewer than HOT_VALUES keys."""
        return self.table.where(F.col("count") > F.lit(self.total / HOT_VALUES))

    def apply(self, df: DataFrame, column: str, result: str) -> DataFrame:
        key = text_of(col(column), dtype_of(df, column))
        return lookup(df, key, self.table, result, None if self.small else self.hot, self.small)

    def as_dict(self) -> dict[str, int] | None:
        """The map as plain data, for a small one."""
        if self.rows > FEW_VALUES or not self.small:
            return None
        return {r["key"]: r["code"] for r in self.table.select("key", "code").collect()}

    @staticmethod
    def of(spark, codes: dict[str, int]) -> CodeMap:
        table = spark.createDataFrame(
            [(k, v, 0) for k, v in codes.items()], "key string, code long, count long"
        )
        return CodeMap(table, len(codes), 0, 0)


def code_map(df: DataFrame, column: str) -> CodeMap:
    require(df, [column])
    dtype = dtype_of(df, column)
    if is_nested(dtype):
        raise StepError("encoding", f"column '{column}' is nested")
    counted = value_counts(df, column).select(text_of(F.col("value"), dtype).alias("key"), "count")
    sized = counted.groupBy("key").agg(F.sum("count").alias("count"))
    numbered = with_row_index(sized, [F.col("key").asc()], "code")      # written once, read below
    size = numbered.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("key")), F.lit(0)),
                        F.coalesce(F.sum("count"), F.lit(0))).first()
    return CodeMap(numbered, *size)


def label_encode(df: DataFrame, column: str, codes: CodeMap | None = None) -> DataFrame:
    """Replace a column by the codes of its values in text order; NULL stays NULL."""
    codes = codes or code_map(df, column)
    coded = codes.apply(df, column, "_code")
    return coded.select(*[
        F.col("_code").cast("long").alias(c) if c == column else col(c) for c in df.columns
    ])


def ordinal_encode(df: DataFrame, column: str, codes: CodeMap, unknown: int = -1) -> DataFrame:
    """Like ``label_encode`` with given codes; a value without a code becomes ``unknown``."""
    coded = codes.apply(df, column, "_code")
    code = F.when(col(column).isNotNull(), F.coalesce(F.col("_code"), F.lit(unknown)))
    return coded.select(*[code.cast("long").alias(c) if c == column else col(c) for c in df.columns])


def onehot_values(df: DataFrame, column: str, max_categories: int | None = None) -> list:
    """The sorted distinct values, one new column each.

    Where a limit is wanted, more than ``max_categories`` is an error, not a cut.
    """
    require(df, [column])
    if is_nested(dtype_of(df, column)):
        raise StepError("encoding", f"column '{column}' is nested")
    distinct = df.select(col(column).alias("v")).where(F.col("v").isNotNull()).distinct()
    some = distinct if max_categories is None else distinct.limit(max_categories + 1)
    values = [r["v"] for r in some.collect()]       # one column of the result each
    if max_categories is not None and len(values) > max_categories:
        raise StepError(
            "onehot", f"column '{column}' has more than {max_categories} values; use label encoding"
        )
    return sorted(values)


def onehot_encode(df: DataFrame, column: str, values: list | None = None,
                  max_categories: int | None = None) -> DataFrame:
    """Drop the column and append one 0/1 column per value; NULL gives zeros only."""
    values = onehot_values(df, column, max_categories) if values is None else values
    kept = [c for c in df.columns if c != column]
    names = [f"{column}_{v}" for v in values]
    clash = set(kept) & set(names)
    if clash:
        raise StepError("onehot", f"column '{sorted(clash)[0]}' exists already")
    dtype = dtype_of(df, column)
    flags = [
        F.when(col(column) == F.lit(v).cast(dtype), F.lit(1)).otherwise(F.lit(0)).cast("long").alias(n)
        for v, n in zip(values, names)
    ]
    return df.select(*[col(c) for c in kept], *flags)


def preview(df: DataFrame, column: str, method: str = "label",
            order_by: Sequence[str] | None = None, n: int = 10) -> DataFrame:
    """affected_rows (all), the first ten values before and after, fitted on all rows."""
    require(df, [column])
    if method not in METHODS:
        raise StepError("encoding", f"unknown method '{method}'")
    keys = [c for c in order_by or [] if c != column]
    few = head(df, n, order_by).select(*[col(c) for c in keys], col(column))
    if method == "label":
        after = label_encode(few, column, code_map(df, column))
    else:
        after = onehot_encode(few, column, onehot_values(df, column))
    return side_by_side(
        df.sparkSession,
        affected_rows=df.agg(F.count(F.lit(1))),
        sample_before=sample_of(few, keys),
        sample_after=sample_of(after, keys),
    )


