"""Ordered target statistics: a text value coded by the target's mean over the rows before it in a seeded order.

A training row's own target, and those of the rows after it, never enter its code, so the code leaks nothing; rows with an equal
key share the same past. New rows are coded by all training rows. Values seen little lean to ``prior`` with the weight
``strength``. Running sums go over blocks of the order first, so a value that a third of all rows have is spread.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.functions.columns import col, require
from brightloom.functions.runtime import materialise
from brightloom.functions.values import broadcast_if_small

NONE = "\x00none"   # stands for NULL, a value of its own
ROWS_PER_BLOCK = 100_000


def place(keys: list[str], seed: int) -> Column:
    """A row's place in the order: the first 60 bits of the md5 of the seed and its key columns."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(col(c).cast("string"), F.lit("")) for c in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def _value(column: str) -> Column:
    return F.coalesce(col(column).cast("string"), F.lit(NONE))


@dataclass
class TargetCodes:
    """What all training rows say: for each column a table (value, total, n), and the prior."""

    columns: list[str]
    prior: float
    strength: float
    tables: dict[str, DataFrame]

    def _code(self, total: Column, n: Column) -> Column:
        total, n = F.coalesce(total, F.lit(0.0)), F.coalesce(n, F.lit(0))
        return (total + self.prior * self.strength) / (n + self.strength)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``<column>__target`` for each column; a value that was not seen gets the prior."""
        for c, sums in self.tables.items():
            sums = sums.select(F.col("value").alias("_value"), F.col("total").alias("_total"), F.col("n").alias("_n"))
            df = df.withColumn("_asked", _value(c)).join(broadcast_if_small(sums), F.col("_asked") == F.col("_value"), "left")
            df = df.withColumn(f"{c}__target", self._code(F.col("_total"), F.col("_n"))).drop("_asked", "_value", "_total", "_n")
        return df


def fit(df: DataFrame, columns: list[str], target: str, strength: float = 1.0) -> TargetCodes:
    """The codes for new rows; rows without a target take no part."""
    require(df, [*columns, target])
    known = df.where(col(target).isNotNull())
    prior = known.agg(F.avg(col(target).cast("double"))).first()[0] or 0.0
    tables = {
        c: materialise(known.groupBy(_value(c).alias("value")).agg(F.sum(col(target).cast("double")).alias("total"), F.count("*").alias("n")), "target-codes")
        for c in columns
    }
    return TargetCodes(list(columns), float(prior), strength, tables)


def ordered(df: DataFrame, columns: list[str], target: str, keys: list[str] | None = None, codes: TargetCodes | None = None,
            strength: float = 1.0, seed: int = 42, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """The training rows with ``<column>__target`` from the rows before them.

    ``keys`` (all columns, if not given) place a row; the result doesn't depend on how the rows are stored or blocked.
    """
    codes = codes or fit(df, columns, target, strength)
    df = df.withColumn("_place", place(keys or df.columns, seed))
    blocks = max(1, -(-df.count() // rows_per_block))
    block = F.floor(F.col("_place") / F.lit((1 << 60) // blocks + 1)).cast("int")
    goal = F.col("_target")
    df = df.withColumn("_target", col(target).cast("double")).withColumn("_block", block)
    for c in columns:
        df = df.withColumn("_value", _value(c))
        totals = df.groupBy("_value", "_block").agg(F.sum(goal).alias("_sum"), F.count(goal).alias("_count"))
        earlier = Window.partitionBy("_value").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.select("_value", "_block", F.sum("_sum").over(earlier).alias("_sum"), F.sum("_count").over(earlier).alias("_count"))
        own = Window.partitionBy("_value", "_block").orderBy("_place").rangeBetween(Window.unboundedPreceding, -1)
        df = df.withColumn("_own", F.sum(goal).over(own)).withColumn("_n", F.count(goal).over(own)).join(totals, ["_value", "_block"])
        total = F.coalesce("_own", F.lit(0.0)) + F.coalesce("_sum", F.lit(0.0))
        df = df.withColumn(f"{c}__target", codes._code(total, F.col("_n") + F.coalesce("_count", F.lit(0)))).drop("_own", "_n", "_sum", "_count")
    return df.drop("_place", "_block", "_target", "_value")
