"""Duplicate rows: counting, removal and preview.

Rows are compared on all columns except ``order_by``, which plays the part of the
row position (say an id or a load time). Copies are combined by partial aggregation
before the shuffle, so one row repeated through a third of the table costs no more
than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brightloom.errors import StepError
from brightloom.functions.columns import (
    col, head, ordering, require, sample_of, side_by_side,
)

KEEP = ("first", "last", "none")
WIDE_ROW = 6                # compared columns from which a row hash is shuffled before the rows
MOST_BROADCAST = 1_000_000  # shared row hashes that may be broadcast


def _compared(df: DataFrame, order_by: Sequence[str] | None) -> list[str]:
    require(df, order_by or [])
    return [c for c in df.columns if c not in set(order_by or [])]


def detect(df: DataFrame, order_by: Sequence[str] | None = None) -> DataFrame:
    """total_rows, duplicate_rows (rows beyond the first copy), duplicate_percent.

    Wide rows are first counted by a row hash, so 8 bytes per row are shuffled; only
    rows whose hash occurs twice are then compared in full.
    """
    names = _compared(df, order_by)
    rows = df.select(*[col(c) for c in names])
    if len(names) < WIDE_ROW:
        total, distinct = _group_sizes(rows, names)
    else:
        hashed = rows.withColumn("_h", F.xxhash64(*[col(c) for c in names]))
        by_hash = hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("n"))
        found = by_hash.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count_if(F.col("n") == 1).alias("alone"),
            F.count_if(F.col("n") > 1).alias("shared"),
        ).first()
        total, distinct = found["total"], found["alone"]
        if found["shared"]:
            shared = by_hash.where("n > 1").select("_h")
            if found["shared"] <= MOST_BROADCAST:
                shared = F.broadcast(shared)        # at most 8 MB of hashes
            distinct += _group_sizes(hashed.join(shared, "_h", "left_semi"), names)[1]
    copies = total - distinct
    percent = round(copies / total * 100, 2) if total else 0.0
    return df.sparkSession.createDataFrame(
        [(total, copies, percent)], "total_rows long, duplicate_rows long, duplicate_percent double"
    )


def _group_sizes(rows: DataFrame, names: list[str]) -> tuple[int, int]:
    """Rows and distinct rows."""
    groups = rows.groupBy(*[col(c) for c in names]).agg(F.count(F.lit(1)).alias("n"))
    return tuple(groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first())


def remove(df: DataFrame, keep: str = "first", order_by: Sequence[str] | None = None) -> DataFrame:
    """Keep the first copy, the last copy, or no copy of repeated rows."""
    if keep not in KEEP:
        raise StepError("duplicates", f"keep must be one of {KEEP}")
    names = _compared(df, order_by)
    if keep == "none":
        order = [F.min(col(c)).alias(c) for c in order_by or []]
        alone = (
            df.groupBy(*[col(c) for c in names])
            .agg(F.count(F.lit(1)).alias("_copies"), *order).where("_copies = 1")
        )
        return alone.select(*[col(c) for c in df.columns])
    if not order_by:
        return df.dropDuplicates()
    pick = F.min if keep == "first" else F.max
    position = F.struct(*[col(c) for c in order_by]) if len(order_by) > 1 else col(order_by[0])
    kept = df.groupBy(*[col(c) for c in names]).agg(pick(position).alias("_at"))
    if len(order_by) > 1:
        places = {c: F.col("_at")[c].alias(c) for c in order_by}
    else:
        places = {order_by[0]: F.col("_at").alias(order_by[0])}
    return kept.select(*[places.get(c, col(c)) for c in df.columns])


def preview(df: DataFrame, keep: str = "first", order_by: Sequence[str] | None = None,
            n: int = 10) -> DataFrame:
    """affected_rows, sample_before (rows to be removed), sample_after (survivors)."""
    if keep not in KEEP:
        raise StepError("duplicates", f"keep must be one of {KEEP}")
    names = _compared(df, order_by)
    counts = df.groupBy(*[col(c) for c in names]).agg(F.count(F.lit(1)).alias("n"))
    lost = F.when(F.col("n") > 1, F.col("n")) if keep == "none" else F.col("n") - 1
    affected = counts.agg(F.coalesce(F.sum(lost), F.lit(0)).alias("affected_rows"))
    # At most n + 1 copies of a row are looked at; Spark applies this limit per task
    # before the shuffle, so a hot row does not travel whole.
    keys = ordering(df, order_by) or [F.lit(0)]
    group = W.partitionBy(*[col(c) for c in names])
    near = (
        df.withColumn("_nth", F.row_number().over(group.orderBy(*keys)))
        .where(F.col("_nth") <= n + 1)
        .withColumn("_last", F.max("_nth").over(group))
    )
    removed = {
        "first": near.where("_nth > 1"),
        "last": near.where("_nth < _last"),
        "none": near.where("_last > 1"),
    }[keep].drop("_nth", "_last")
    return side_by_side(
        df.sparkSession,
        affected_rows=affected,
        sample_before=sample_of(head(removed, n, order_by), order_by),
        sample_after=sample_of(head(remove(df, keep, order_by), n, order_by), order_by),
    )


def rows_remaining(df: DataFrame, keep: str = "first", order_by=None) -> int:
    return remove(df, keep, order_by).count()
