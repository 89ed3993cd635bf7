"""Missing values: scan, recommendation, imputation, forward fill and preview."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightloom.errors import StepError
from brightloom.functions import quantiles as q
from brightloom.functions.columns import (
    INTEGRAL, col, dtype_of, head, is_numeric, is_text, replace_columns, require,
    sample_of, side_by_side,
)
from brightloom.functions.values import broadcast_if_small, most_frequent, with_row_index
from brightloom.operators.profile import as_stats

STRATEGIES = ("mean", "median", "mode", "constant", "drop")

# Words for the two truth values.
TRUE_WORDS = ("true", "1", "yes", "t", "y")
FALSE_WORDS = ("false", "0", "no", "f", "n")

ROWS_PER_STRETCH = 2_000_000


def recommend(table) -> DataFrame:
    """column, missing, percent, recommended - for the columns that miss values.

    Numbers: median below 20 %, mean below 60 %, else drop. Others: mode below 60 %,
    else drop.
    """
    stats = as_stats(table)
    rows = []
    for c in stats.columns:
        missing, percent = stats.missing(c), stats.missing_percent(c)
        if not missing:
            continue
        if percent >= 60:
            advice = "drop"
        elif c not in stats.numeric:
            advice = "mode"
        else:
            advice = "median" if percent < 20 else "mean"
        rows.append((c, missing, round(percent, 2), advice))
    return stats.df.sparkSession.createDataFrame(
        rows, "column string, missing long, percent double, recommended string"
    )


def coerce_constant(dtype: T.DataType, value):
    """The constant in the column's own type; raises when it does not fit."""
    if value is None:
        raise StepError("constant imputation", "a non-null constant is required")
    if isinstance(dtype, T.BooleanType):
        word = str(value).strip().lower()
        if word not in TRUE_WORDS + FALSE_WORDS:
            raise StepError("constant imputation", f"'{value}' is not a truth value")
        return word in TRUE_WORDS
    if is_numeric(dtype):
        try:
            number = float(value)
        except (TypeError, ValueError) as error:
            raise StepError("constant imputation", f"'{value}' is not a number") from error
        if isinstance(dtype, INTEGRAL):
            if not number.is_integer():
                raise StepError("constant imputation", f"'{value}' is not a whole number")
            return int(number)
        return number
    return str(value) if is_text(dtype) else value


def fill_value(df: DataFrame, column: str, strategy: str, constant=None):
    """The value to put in place of NULL, from the whole column (None: nothing to fill)."""
    require(df, [column])
    dtype = dtype_of(df, column)
    if strategy not in STRATEGIES:
        raise StepError("imputation", f"unknown strategy '{strategy}'")
    if strategy in ("mean", "median") and not is_numeric(dtype):
        raise StepError(f"{strategy} imputation", f"column '{column}' is not numeric")
    if strategy == "mean":
        return df.agg(F.avg(col(column).cast("double"))).first()[0]
    if strategy == "median":
        return q.exact_quantiles(df, [column], [0.5])[column][0]
    if strategy == "mode":
        return most_frequent(df, column)
    if strategy == "constant":
        return coerce_constant(dtype, constant)
    return None


def fill(df: DataFrame, column: str, value) -> DataFrame:
    """NULL becomes ``value``; a whole-number column turns double for a fractional one."""
    if value is None:
        return df
    dtype = dtype_of(df, column)
    if isinstance(dtype, (*INTEGRAL, T.DecimalType)) and isinstance(value, float):
        dtype = T.DoubleType()
    elif isinstance(dtype, T.FloatType):
        dtype = T.DoubleType()
    literal = F.lit(value).cast(dtype)
    return replace_columns(df, {column: F.coalesce(col(column).cast(dtype), literal)})


def impute(df: DataFrame, column: str, strategy: str, constant=None) -> DataFrame:
    value = fill_value(df, column, strategy, constant)
    return drop_missing(df, column) if strategy == "drop" else fill(df, column, value)


def drop_missing(df: DataFrame, column: str) -> DataFrame:
    require(df, [column])
    return df.where(col(column).isNotNull())


def preview(df: DataFrame, column: str, strategy: str, constant=None,
            order_by: Sequence[str] | None = None, n: int = 10) -> DataFrame:
    """affected_rows, up to ten rows with a gap, the same rows after the step."""
    require(df, [column])
    gaps = df.where(col(column).isNull())
    value = fill_value(df, column, strategy, constant)
    few = head(gaps, n, order_by)
    if not order_by:     # any rows will do, but the same ones before and after
        few = df.sparkSession.createDataFrame(few.collect(), df.schema)
    after = fill(few, column, value) if strategy != "drop" else few.limit(0)
    return side_by_side(
        df.sparkSession,
        affected_rows=gaps.agg(F.count(F.lit(1))),
        sample_before=sample_of(few, order_by),
        sample_after=sample_of(after, order_by),
    )


def forward_fill(df: DataFrame, columns: Sequence[str], order_by: Sequence[str],
                 partition_by: Sequence[str] = (), rows_per_stretch: int = ROWS_PER_STRETCH) -> DataFrame:
    """Carry the last known value forward along ``order_by`` within each ``partition_by`` group.

    Each stretch (see ``in_stretches``) is filled on its own. What it inherits is the last value of its group in the
    stretches before it; only one group of a stretch goes on into the next, so that is one row per stretch.
    """
    require(df, columns)
    placed = in_stretches(df, order_by, partition_by, rows_per_stretch)
    last = lambda c: F.last(c, ignorenulls=True)
    local = W.partitionBy("_group", "_stretch").orderBy("_index").rowsBetween(W.unboundedPreceding, 0)
    near = placed.select(
        "*", *[last(col(c)).over(local).alias(f"_near{i}") for i, c in enumerate(columns)]
    )
    ends = _going_on(placed, rows_per_stretch).groupBy("_group", "_stretch").agg(*[
        F.max_by(col(c), F.when(col(c).isNotNull(), F.col("_index"))).alias(f"_end{i}")
        for i, c in enumerate(columns)
    ])
    so_far = W.partitionBy("_group").orderBy("_stretch").rowsBetween(W.unboundedPreceding, 0)
    far = ends.select(
        "_group", (F.col("_stretch") + 1).alias("_stretch"),
        *[last(f"_end{i}").over(so_far).alias(f"_far{i}") for i in range(len(columns))],
    )
    filled = near.join(broadcast_if_small(far), ["_group", "_stretch"], "left")
    number = {c: i for i, c in enumerate(columns)}
    return filled.select(*[
        F.coalesce(F.col(f"_near{number[c]}"), F.col(f"_far{number[c]}")).alias(c)
        if c in number else col(c) for c in df.columns
    ])


def lags(df: DataFrame, column: str, count: int, order_by: Sequence[str],
         partition_by: Sequence[str] = (), rows_per_stretch: int = ROWS_PER_STRETCH) -> DataFrame:
    """Columns lag_1 ... lag_count: earlier values of ``column`` in the same group.

    Rows look back inside their stretch; the first ``count`` rows of a stretch are helped out by the last ``count`` values
    of their group before it, one short list per stretch.
    """
    require(df, [column])
    placed = in_stretches(df, order_by, partition_by, rows_per_stretch)
    local = W.partitionBy("_group", "_stretch").orderBy("_index")
    back = range(1, count + 1)
    near = placed.select(
        "*", F.row_number().over(local).alias("_nth"), *[F.lag(col(column), i).over(local).alias(f"_lag_{i}") for i in back])
    # The group that goes on fills the stretch to its end, so its last values stand at the stretch's last places.
    tail = _going_on(placed, rows_per_stretch).where(F.col("_index") % rows_per_stretch >= rows_per_stretch - count)
    tails = tail.groupBy("_group", "_stretch").agg(
        F.sort_array(F.collect_list(F.struct("_index", col(column).alias("v")))).alias("_tail"))
    # Each of the count stretches before holds at least one value of the group.
    few = W.partitionBy("_group").orderBy("_stretch").rowsBetween(-count, 0)
    tails = tails.select(
        "_group", (F.col("_stretch") + 1).alias("_stretch"),
        F.reverse(F.flatten(F.collect_list("_tail").over(few))).alias("_tail"))
    met = near.join(broadcast_if_small(tails), ["_group", "_stretch"], "left")
    return met.select(*[col(c) for c in df.columns], *[
        F.when(F.col("_nth") > i, F.col(f"_lag_{i}")).otherwise(F.try_element_at("_tail", F.lit(i) - F.col("_nth") + 1)["v"]).alias(f"lag_{i}")
        for i in back
    ])


def _going_on(placed: DataFrame, rows_per_stretch: int) -> DataFrame:
    """The rows of the group that holds the last place of a full stretch; at most one group a stretch."""
    last = placed.where(F.col("_index") % rows_per_stretch == rows_per_stretch - 1).select("_group", "_stretch")
    return placed.join(broadcast_if_small(last), ["_group", "_stretch"], "left_semi")


def in_stretches(df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str] = (),
                 rows_per_stretch: int = ROWS_PER_STRETCH) -> DataFrame:
    """Add ``_group`` (the partition columns as one value), ``_index`` and ``_stretch``.

    All rows are put in the order of group and order columns by one range sort and numbered; each ``rows_per_stretch`` of
    them are a stretch. So neither a group nor a value of the order columns with a third of all rows is bound to one
    task. NULL comes last; rows tied in all order columns follow a hash of the whole row.
    """
    require(df, [*order_by, *partition_by])
    if not order_by:
        raise StepError("order", "order_by is required")
    hashable = [col(f.name) for f in df.schema if not _has_map(f.dataType)]
    placed = df.withColumn("_group", F.struct(*[col(c) for c in partition_by]) if partition_by else F.lit(0))
    order = [*[col(c).asc_nulls_last() for c in [*partition_by, *order_by]], F.xxhash64(*hashable), F.monotonically_increasing_id()]
    indexed = with_row_index(placed, order, "_index")
    return indexed.withColumn("_stretch", F.floor(F.col("_index") / F.lit(max(1, rows_per_stretch))))


def _has_map(dtype: T.DataType) -> bool:
    return "map<" in dtype.simpleString()


def kpis(table) -> DataFrame:
    """missing_cells, total_cells, missing_percent over the whole table."""
    stats = as_stats(table)
    cells = stats.rows * len(stats.columns)
    missing = sum(stats.missing(c) for c in stats.columns)
    return stats.df.sparkSession.createDataFrame(
        [(missing, cells, round(missing / cells * 100, 2) if cells else 0.0)],
        "missing_cells long, total_cells long, missing_percent double",
    )


