"""Distinct counts, frequent values and row numbers, all without a single hot task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brightloom.functions.columns import col, dtype_of, is_nested
from brightloom.functions.runtime import materialise

COLUMNS_PER_JOB = 24
BROADCAST_ROWS = 100_000     # a lookup of at most this many rows ...
BROADCAST_CHARS = 8_000_000  # ... and this much text may be broadcast


def distinct_counts(
    df: DataFrame, columns: Sequence[str], exact: bool = True, one_scan: bool = False
) -> dict[str, int | None]:
    """Distinct non-null values per column; nested columns give None.

    Exact counts group each column on its own (native types, combined before the
    shuffle), all branches in one job; on columnar files the branches together
    read each column once. ``one_scan`` uses one multi-distinct aggregate instead,
    for inputs that are dear to read twice.
    """
    usable = [c for c in columns if not is_nested(dtype_of(df, c))]
    counts: dict[str, int | None] = {c: None for c in columns}
    for start in range(0, len(usable), COLUMNS_PER_JOB):
        part = usable[start:start + COLUMNS_PER_JOB]
        if exact and not one_scan:
            branches = [
                df.select(col(c).alias("v")).where(F.col("v").isNotNull()).distinct()
                .agg(F.count(F.lit(1)).alias("n")).select(F.lit(i).alias("i"), "n")
                for i, c in enumerate(part)
            ]
            for row in reduce(DataFrame.unionAll, branches).collect():
                counts[part[row["i"]]] = row["n"]
        else:
            count = F.count_distinct if exact else F.approx_count_distinct
            row = df.agg(*[count(col(c)).alias(f"c{i}") for i, c in enumerate(part)]).first()
            counts.update({c: row[f"c{i}"] for i, c in enumerate(part)})
    return counts


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, count) of the non-null values; a hot value is combined before the shuffle."""
    return (
        df.select(col(column).alias("value"))
        .where(F.col("value").isNotNull())
        .groupBy("value")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def most_frequent(df: DataFrame, column: str):
    """The most frequent value, the smallest one among ties; None without values."""
    row = (
        value_counts(df, column)
        .orderBy(F.col("count").desc(), F.col("value").asc())
        .limit(1).collect()
    )
    return row[0]["value"] if row else None


def with_row_index(df: DataFrame, order: Sequence[Column], name: str = "row_index") -> DataFrame:
    """Zero-based position of each row in ``order`` (a total order).

    The table is range-sorted, its (partition, position) pairs are frozen by writing it, and each partition is shifted by the rows before it. No
    single task ever sees the whole table.
    """
    frozen, offsets = _frozen_order(df, order, name)
    shift = F.lit(0).cast("long")
    if offsets:
        starts = df.sparkSession.createDataFrame(list(offsets.items()), "_part int, _start long")
        frozen = frozen.withColumn("_part", F.shiftright(F.col(name), 33).cast("int"))
        frozen = frozen.join(F.broadcast(starts), "_part", "left")  # one row per partition
        shift = F.col("_start")
    position = F.col(name).bitwiseAND(F.lit((1 << 33) - 1)) + shift
    kept = [col(c) for c in df.columns]
    return frozen.select(*kept, position.alias(name))


def rows_at(df: DataFrame, order: Sequence[Column], positions: Sequence[int],
            name: str = "row_index") -> DataFrame:
    """The rows at the given zero-based positions, numbered 0, 1, ... in that order.

    ``positions`` is a short list (a chart sample); ``df`` holds only what the
    chart needs.
    """
    frozen, offsets = _frozen_order(df, order, name)
    picks = []
    parts = sorted(offsets.items(), key=lambda item: item[1])
    which = 0
    for out, position in enumerate(positions):
        while which + 1 < len(parts) and parts[which + 1][1] <= position:
            which += 1
        part, start = parts[which]
        picks.append(((part << 33) + position - start, out))
    # A short IN list lets the scan skip all row groups without a wanted id.
    wanted = dict(picks)
    number = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair]) if wanted else None
    kept = [col(c) for c in df.columns]
    chosen = frozen.where(col(name).isin(list(wanted)))
    out = number[col(name)] if wanted else F.lit(None)
    return chosen.select(out.cast("long").alias(name), *kept)


def _frozen_order(df, order, name):
    """Sorted rows with frozen ids, and the number of rows before each partition."""
    arranged = df.orderBy(*order) if order else df
    frozen = materialise(arranged.withColumn(name, F.monotonically_increasing_id()), "order")
    sizes = (
        frozen.groupBy(F.shiftright(F.col(name), 33).cast("int").alias("part"))
        .agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    )
    offsets, total = {}, 0
    for row in sizes:
        offsets[row["part"]] = total
        total += row["n"]
    return frozen, offsets


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast after counting that it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def lookup(df: DataFrame, key: Column, mapping: DataFrame, result: str,
           hot: DataFrame | None = None, small: bool = False) -> DataFrame:
    """Left-join ``mapping`` (key, code) onto ``df`` by ``key``; no partner gives NULL.

    ``small`` says that the mapping's size has been checked, then it is broadcast.
    Otherwise ``hot`` holds its most frequent keys (a few hundred rows): they are
    answered by a broadcast, and only the remaining rows are shuffled. Rows already
    answered, and rows without a key, are spread by a salt instead of meeting in one
    task.
    """
    if small:
        codes = F.broadcast(mapping.select(F.col("key").alias("_key"), F.col("code").alias(result)))
        return df.withColumn("_probe", key).join(
            codes, F.col("_probe") == F.col("_key"), "left"
        ).drop("_probe", "_key")
    hot_codes = F.broadcast(hot.select(F.col("key").alias("_hot_key"), F.col("code").alias("_hot")))
    cold_codes = mapping.select(
        F.col("key").alias("_cold_key"), F.col("code").alias("_cold"), F.lit(0).alias("_cold_salt")
    )
    probed = df.withColumn("_probe", key).join(
        hot_codes, F.col("_probe") == F.col("_hot_key"), "left"
    )
    unanswered = F.col("_probe").isNotNull() & F.col("_hot").isNull()
    probed = probed.withColumn("_cold_probe", F.when(unanswered, F.col("_probe"))).withColumn(
        "_salt",
        F.when(unanswered, 0).otherwise(
            F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(65_536)).cast("int") + 1
        ),
    )
    joined = probed.join(
        cold_codes,
        (F.col("_cold_probe") == F.col("_cold_key")) & (F.col("_salt") == F.col("_cold_salt")),
        "left",
    )
    return joined.withColumn(result, F.coalesce("_hot", "_cold")).drop(
        "_probe", "_hot_key", "_hot", "_cold_probe", "_salt", "_cold_key", "_cold", "_cold_salt"
    )
