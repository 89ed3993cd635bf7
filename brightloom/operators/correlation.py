"""Pearson correlation of all numeric columns, skipping NULLs pair by pair.

One pass over the centred columns sums the products every pair needs. Each task
keeps one small matrix (columns squared, not rows) and emits its cells once; Spark
adds them up per pair.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.functions.columns import col
from brightloom.functions.runtime import ship_by_value
from brightloom.operators.profile import as_stats

ship_by_value(__name__)

TILE = 150              # columns of one side of a block of pairs
PARTS = 32              # sums that reach the driver for each block

SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _tile_sums(means: Sequence[float], left: int):
    """The six sums of every pair (one of the first ``left`` columns, any column) of one task, as one row."""
    centre = np.asarray(means, dtype=float)

    def run(batches):
        total = None
        for batch in batches:
            x = batch.to_numpy(dtype=float)
            known = ~np.isnan(x)
            x = np.where(known, x - centre, 0.0)
            mask, square = known.astype(float), x * x
            a, am, a2 = x[:, :left], mask[:, :left], square[:, :left]
            part = np.stack([am.T @ mask, a.T @ mask, am.T @ x, a2.T @ mask, am.T @ square, a.T @ x])
            total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"part": [TaskContext.get().partitionId() % PARTS], "sums": [total.tobytes()]})

    return run


def _add_sums(frame: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(b, dtype=float) for b in frame["sums"])
    return pd.DataFrame({"part": [frame["part"].iloc[0]], "sums": [total.tobytes()]})


def _blocks(count: int) -> list[tuple[range, range]]:
    tiles = [range(start, min(start + TILE, count)) for start in range(0, count, TILE)]
    return [(a, b) for i, a in enumerate(tiles) for b in tiles[i:]]


def matrix(table, columns: Sequence[str] | None = None) -> dict[tuple[str, str], float | None]:
    """(column1, column2) -> r for every ordered pair; None for a constant side.

    Columns are taken in blocks of ``TILE``, so a task holds one block of pairs however wide the
    table is. Each task gives one row; the rows are added up in ``PARTS`` groups, then here.
    """
    stats = as_stats(table)
    columns = stats.numeric if columns is None else list(columns)
    if len(columns) < 2:
        return {}
    means = {c: stats.moments()[c]["mean"] or 0.0 for c in columns}
    cells: dict[tuple[str, str], float | None] = {}
    for a, b in _blocks(len(columns)):
        names = [columns[i] for i in a] + ([columns[i] for i in b] if a != b else [])
        values = stats.df.select(*[col(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)])
        rows = (
            values.mapInPandas(_tile_sums([means[c] for c in names], len(a)), "part int, sums binary")
            .groupBy("part").applyInPandas(_add_sums, "part int, sums binary").collect()    # at most PARTS
        )
        if not rows:
            total = np.zeros((6, len(a), len(names)))
        else:
            total = sum(np.frombuffer(r["sums"], dtype=float) for r in rows).reshape(6, len(a), len(names))
        for i in range(len(a)):
            for j in range(i if a == b else len(a), len(names)):
                r = _coefficient(dict(zip(SUMS, total[:, i, j])), names[i] == names[j])
                cells[names[i], names[j]] = cells[names[j], names[i]] = r
    return cells


def _coefficient(row, diagonal: bool) -> float | None:
    n = row["n"]
    if n < 2:
        return None
    spread_x = row["sxx"] - row["sx"] ** 2 / n
    spread_y = row["syy"] - row["sy"] ** 2 / n
    # A spread within rounding of zero is a constant.
    if spread_x <= 1e-13 * row["sxx"] or spread_y <= 1e-13 * row["syy"]:
        return None
    if not (spread_x > 0 and spread_y > 0):
        return None
    if diagonal:
        return 1.0
    r = (row["sxy"] - row["sx"] * row["sy"] / n) / math.sqrt(spread_x * spread_y)
    return float(max(-1.0, min(1.0, r)))


def warning(table, most_columns: int | None = None) -> str | None:
    """Why no matrix is drawn: only a limit that the caller sets."""
    width = max(len(as_stats(table).columns), len(as_stats(table).numeric))
    if most_columns is not None and width > most_columns:
        return f"Correlation was skipped: {width} columns are more than the {most_columns} allowed."
    return None


def _cells(table):
    return matrix(as_stats(table))


def matrix_table(table) -> DataFrame:
    """One row per numeric column: its name and one value per column."""
    stats = as_stats(table)
    cells = _cells(stats)
    names = stats.numeric if cells else []
    fields = ", ".join(f"`{c.replace('`', '``')}` double" for c in names)
    rows = [(a, *[cells[a, b] for b in names]) for a in names]
    return stats.df.sparkSession.createDataFrame(
        rows, f"column string, {fields}" if fields else "column string"
    )


def heatmap(table) -> DataFrame:
    """x, y, value (3 digits) for every ordered pair, diagonal included."""
    stats = as_stats(table)
    cells = _cells(stats)
    names = stats.numeric if cells else []
    rows = [
        (a, b, None if cells[a, b] is None else round(cells[a, b], 3)) for a in names for b in names
    ]
    return stats.df.sparkSession.createDataFrame(rows, "x string, y string, value double")


def high_pairs(table, threshold: float = 0.9) -> DataFrame:
    """column1, column2, correlation, recommendation for abs(r) >= threshold."""
    stats = as_stats(table)
    cells, names, rows = _cells(stats), stats.numeric, []
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            r = cells.get((a, b))
            if r is not None and abs(r) >= threshold:
                rows.append((
                    a, b, round(r, 3),
                    f"'{a}' and '{b}' move together (r = {round(r, 2)}): "
                    "one of them can go.",
                ))
    return stats.df.sparkSession.createDataFrame(
        rows, "column1 string, column2 string, correlation double, recommendation string"
    )


def target_ranking(table, target: str) -> DataFrame:
    """Other numeric columns by abs(r) with the target, strongest first; no value counts as 0."""
    pairs = heatmap(table).where((F.col("x") == target) & (F.col("y") != target))
    return pairs.select(
        F.col("y").alias("feature"), F.coalesce("value", F.lit(0.0)).alias("correlation")
    ).orderBy(F.abs("correlation").desc(), "feature")
