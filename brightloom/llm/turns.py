"""Turns of conversations in order, without a task that holds a whole conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.functions.values import with_row_index

HEAD = 64


def plain_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text; rows without a conv_id take no part, a NULL role or text is empty."""
    return conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def order_columns() -> list[Column]:
    """What puts a conversation's turns in order: turn (NULL first), role, the text's first characters, its md5."""
    return [F.col("turn").alias("_turn"), F.col("role").alias("_role"), F.left("text", F.lit(HEAD)).alias("_head"), F.unhex(F.md5("text")).alias("_md5")]


def in_order() -> list[Column]:
    return [F.col("_turn").asc_nulls_first(), F.col("_role"), F.col("_head"), F.col("_md5")]


def positions(turns: DataFrame, *kept: str | Column) -> DataFrame:
    """conv_id, the ``kept`` columns of ``plain_turns``, pos (from 1) and n_turns of the conversation.

    One range sort over all rows; equal rows are spread by their place in the input, so that neither a conversation nor a
    repeated row has to fit into a task. Texts are shuffled and written only if ``kept`` has them.
    """
    keyed = turns.select("conv_id", *order_columns(), *kept, F.monotonically_increasing_id().alias("_at"))
    ordered = keyed.orderBy("conv_id", *in_order(), "_at").drop("_turn", "_role", "_head", "_md5", "_at")
    rows = with_row_index(ordered, [], "_row")
    own = rows.groupBy("conv_id").agg(F.min("_row").alias("_first"), F.count("*").alias("n_turns"))
    return rows.join(own, "conv_id").withColumn("pos", F.col("_row") - F.col("_first") + 1).drop("_row", "_first")


def before(totals: DataFrame, key: str, index: str, values: list[str], fold, combine, wide: int = 10) -> DataFrame:
    """``totals`` (key, index, values) with each value replaced by the fold of the rows of its key before it, or 0.

    Windows cover 2**wide rows of a key, and the blocks of so many rows, never all rows of a key at once.
    """
    blocks = totals.withColumn("_block", F.shiftright(index, wide))
    inner = Window.partitionBy(key, "_block").orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocks.groupBy(key, "_block").agg(*[fold(v).alias(f"_{v}") for v in values])
    sums = sums.select(key, "_block", *[F.coalesce(fold(f"_{v}").over(outer), F.lit(0)).alias(f"_{v}") for v in values])
    local = blocks.select(key, index, "_block", *[F.coalesce(fold(v).over(inner), F.lit(0)).alias(v) for v in values])
    return local.join(sums, [key, "_block"]).select(key, index, *[combine(F.col(v), F.col(f"_{v}")).alias(v) for v in values])
