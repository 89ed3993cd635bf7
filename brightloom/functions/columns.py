"""Column references, schema classes and small expression helpers."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightloom.errors import ColumnNotFound

FLOATING = (T.FloatType, T.DoubleType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)
NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)


def col(name: str) -> Column:
    """Reference a column by its literal name (dots, spaces and backticks allowed)."""
    return F.col("`" + name.replace("`", "``") + "`")


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def require(df: DataFrame, names: Iterable[str]) -> None:
    present = set(df.columns)
    for name in names:
        if name not in present:
            raise ColumnNotFound(name)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.VarcharType, T.CharType))


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, NESTED)


def numeric_columns(df: DataFrame) -> list[str]:
    """Numbers, booleans excluded; read from the schema, no job."""
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_text(f.dataType)]


def display_class(dtype_name: Column) -> Column:
    """numeric / boolean / datetime / categorical label of a dtype name."""
    return (
        F.when(dtype_name.rlike("^(tinyint|smallint|int|bigint|float|double|decimal)"), "numeric")
        .when(dtype_name == "boolean", "boolean")
        .when(dtype_name.rlike("^(timestamp|date)"), "datetime")
        .otherwise("categorical")
    )


def replace_columns(df: DataFrame, changes: dict[str, Column]) -> DataFrame:
    """Swap several columns in place with one projection."""
    return df.select(*[changes[c].alias(c) if c in changes else col(c) for c in df.columns])


def text_of(column: Column, dtype: T.DataType) -> Column:
    """Text of a value with the notation a data-frame user expects.

    Differs from a plain cast for doubles (positional between 1e-4 and 1e16,
    two-digit exponents outside) and for booleans (capitalised).
    """
    if isinstance(dtype, T.BooleanType):
        return F.initcap(column.cast("string"))
    if not isinstance(dtype, FLOATING):
        return column.cast("string")
    value = column.cast("double")
    plain = column.cast("string")
    size = F.abs(value)
    # Large numbers have at most 9 significant decimals left, small ones at most 21.
    wide = F.regexp_replace(plain.try_cast("decimal(38,10)").cast("string"), "0+$", "")
    small = F.regexp_replace(plain.try_cast("decimal(38,22)").cast("string"), "0+$", "")
    exponent = F.regexp_extract(plain, r"E(-?)(\d+)$", 2)
    sign = F.when(plain.contains("E-"), "-").otherwise("+")
    scientific = F.concat(
        F.regexp_replace(F.substring_index(plain, "E", 1), r"\.0$", ""),
        F.lit("e"),
        sign,
        F.when(F.length(exponent) < 2, F.lpad(exponent, 2, "0")).otherwise(exponent),
    )
    return (
        F.when((size == 0) | ((size >= 1e-3) & (size < 1e7)), plain)
        .when((size >= 1e7) & (size < 1e16), F.regexp_replace(wide, r"\.$", ".0"))
        .when((size >= 1e-4) & (size < 1e-3), small)
        .when(size.isNull() | F.isnan(value), plain)
        .when(F.isnan(size - size), plain)
        .otherwise(scientific)
    )


def ordering(df: DataFrame, order_by: Sequence[str] | None) -> list[Column]:
    if not order_by:
        return []
    require(df, order_by)
    return [col(c).asc_nulls_last() for c in order_by]


def head(df: DataFrame, n: int, order_by: Sequence[str] | None = None) -> DataFrame:
    """First ``n`` rows by ``order_by``; without it, the first rows in partition order."""
    keys = ordering(df, order_by)
    return (df.orderBy(*keys) if keys else df).limit(n)


def finite(value) -> float | None:
    """A double that is safe to show: NaN and missing become None."""
    if value is None:
        return None
    value = float(value)
    return None if math.isnan(value) else value


def rounded(value, digits: int) -> float | None:
    value = finite(value)
    return None if value is None else round(value, digits)


def sample_of(few: DataFrame, order_by: Sequence[str] | None = None) -> DataFrame:
    """One cell holding a short table (a preview) as an array of structs, in order."""
    row = F.struct(*[col(c) for c in few.columns])
    if not order_by:
        return few.agg(F.collect_list(row))
    item = F.struct(F.struct(*[col(c) for c in order_by]).alias("k"), row.alias("r"))
    return few.agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["r"]))


def side_by_side(spark, **cells: DataFrame) -> DataFrame:
    """One row out of several one-cell results, each a scalar subquery."""
    return spark.range(1).select(*[cell.scalar().alias(name) for name, cell in cells.items()])
