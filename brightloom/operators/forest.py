"""Isolation forests on numeric columns, all columns together.

Each of the 100 trees of a column sees 256 values of its own, drawn from the whole column; a column of fewer values than all
trees need lends them to several. On one column a forest is a step function of the value: merging the split points of
all trees gives a few thousand value ranges, each with one anomaly score. The cut at the contamination share, the number
of outliers and the bounds of the inliers follow from the number of values in each range.

Three jobs serve all columns. The first counts equal values of each column. The second draws from these counts - each of
a value's copies has a hash of (column, value, copy), and the copies of least hash are the sample, so it does not depend on how
the table is stored - and grows each column's trees in one task. The third counts the values of each range.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.functions.columns import col
from brightloom.functions.runtime import materialise, ship_by_value

ship_by_value(__name__)

# Library defaults of the method.
TREES = 100
VALUES_PER_TREE = 256
SEED = 42
EULER = 0.5772156649015329

DRAWN = TREES * VALUES_PER_TREE     # values that all trees of a column see
COLUMNS_AT_ONCE = 64


@dataclass
class FittedForest:
    bounds: tuple[float | None, float | None]
    outliers: int
    inlier_ranges: list[tuple[float, float]]


def _average_path(n: int) -> float:
    """Expected path length of an unsuccessful search among ``n`` values."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def _grow(values: np.ndarray, rng: np.random.Generator) -> tuple[list[float], list[float]]:
    """Split points of one random tree, ascending, and the path length of each range."""
    limit = math.ceil(math.log2(max(len(values), 2)))
    splits: list[float] = []
    lengths: list[float] = []

    def descend(part: np.ndarray, depth: int) -> None:
        low, high = part[0], part[-1]
        if depth >= limit or len(part) <= 1 or low == high:
            lengths.append(depth + _average_path(len(part)))
            return
        cut = rng.uniform(low, high)
        cut = low if cut >= high else cut
        place = int(np.searchsorted(part, cut, side="right"))
        descend(part[:place], depth + 1)
        splits.append(float(cut))
        descend(part[place:], depth + 1)

    descend(np.sort(values), 0)
    return splits, lengths


def _forest(pool: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Split points and range scores of the trees on a sample in random order."""
    size = min(VALUES_PER_TREE, len(pool))
    trees = []
    for tree in range(TREES):
        rng = np.random.default_rng(SEED + tree)
        own = pool[tree * size:(tree + 1) * size] if len(pool) >= DRAWN else rng.choice(pool, size, replace=False)
        trees.append(_grow(own, rng))
    return _score_ranges(pd.DataFrame(trees, columns=["splits", "lengths"]), size)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well mixed bits of each of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draw(column: int, values: np.ndarray, counts: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Hash and value of the copies whose hash, as a number from 0 to 1, is below ``share``."""
    with np.errstate(over="ignore"):
        seed = _mixed(values.astype(np.float64).view(np.uint64) + np.uint64(column + 1) * np.uint64(0x9E3779B97F4A7C15))
        few = counts <= 64
        copies = np.repeat(np.flatnonzero(few), counts[few])
        nth = np.arange(len(copies)) - np.repeat(np.cumsum(counts[few]) - counts[few], counts[few])
        hashes = _mixed(seed[copies] + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) / 2.0**64
    taken = hashes < share
    found, drawn = [hashes[taken]], [values[copies[taken]]]
    for i in np.flatnonzero(~few):      # many copies: how many fall below the share, and where
        rng = np.random.default_rng(int(seed[i]))
        found.append(rng.uniform(0, share, rng.binomial(int(counts[i]), share)))
        drawn.append(np.full(len(found[-1]), values[i]))
    return np.concatenate(found), np.concatenate(drawn)


def _score_ranges(trees: pd.DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Merged split points and the score of each range between them (lower is stranger)."""
    cuts = np.unique(np.concatenate([np.asarray(s, dtype=float) for s in trees["splits"]] + [[]]))
    # A value falls left of a split when value <= split, so range i is (cuts[i-1], cuts[i]].
    depth = np.zeros(len(cuts) + 1)
    probe = np.append(cuts, np.inf)
    for splits, lengths in zip(trees["splits"], trees["lengths"]):
        depth += np.asarray(lengths)[np.searchsorted(np.asarray(splits, dtype=float), probe, side="left")]
    norm = _average_path(size) or 1.0
    return cuts, -np.exp2(-(depth / len(trees)) / norm)


def fit_all(df: DataFrame, columns: Sequence[str], contamination: float, present: dict[str, int]) -> dict[str, FittedForest]:
    """The forests of all columns; ``present``: how many values each has. A column without values has no bounds."""
    found = {c: FittedForest((None, None), 0, []) for c in columns}
    named = [c for c in columns if present[c]]
    for start in range(0, len(named), COLUMNS_AT_ONCE):
        part = named[start:start + COLUMNS_AT_ONCE]
        found.update(_fit_part(df, part, contamination, [present[c] for c in part]))
    return found


def fit(df: DataFrame, column: str, contamination: float, present: int) -> FittedForest:
    return fit_all(df, [column], contamination, {column: present})[column]


def ranges_of(df: DataFrame, columns: Sequence[str], present: Sequence[int]) -> pd.DataFrame:
    """c (place of the column), r, n, low, high, score: the ranges of each column's forest that hold values."""
    spark = df.sparkSession
    cells = F.array(*[F.struct(F.lit(i).alias("c"), (col(c).cast("double") + F.lit(0.0)).alias("v")) for i, c in enumerate(columns)])
    cells = df.select(F.explode(cells).alias("e")).select("e.c", "e.v").where("v is not null")
    counted = materialise(cells.groupBy("c", "v").agg(F.count("*").alias("n")), "values")
    shares = [min(1.0, 1.1 * DRAWN / max(n, 1)) for n in present]    # a little more, as the number drawn varies

    def sample(batches):
        for batch in batches:
            number, values, counts = (batch[c].to_numpy() for c in ("c", "v", "n"))
            for c in np.unique(number):
                own = number == c
                hashes, drawn = draw(int(c), values[own], counts[own], shares[c])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(drawn), c, np.int32)), pa.array(hashes), pa.array(drawn)], ["c", "h", "v"])

    def grow(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        pool = table["v"].to_numpy()[np.lexsort((table["v"].to_numpy(), table["h"].to_numpy()))][:DRAWN]
        cuts, scores = _forest(pool)
        return pa.table({"c": pa.array([key[0].as_py()], pa.int32()), "cuts": [cuts.tolist()], "scores": [scores.tolist()]})

    sampled = counted.mapInArrow(sample, "c int, h double, v double")    # about 1.1 DRAWN values of a column
    forests = sampled.groupBy("c").applyInArrow(grow, "c int, cuts array<double>, scores array<double>").toArrow().to_pandas()
    forests = {int(c): (np.asarray(cuts), np.asarray(scores)) for c, cuts, scores in zip(forests["c"], forests["cuts"], forests["scores"])}
    shared = spark.sparkContext.broadcast({c: cuts for c, (cuts, _) in forests.items()})     # at most 100 x 255 numbers a column

    def count(batches):
        edges = shared.value
        for batch in batches:
            frame = batch.to_pandas()
            frame["r"] = 0
            for c, own in frame.groupby("c").groups.items():
                frame.loc[own, "r"] = np.searchsorted(edges[c], frame.loc[own, "v"].to_numpy(), side="left")
            out = frame.groupby(["c", "r"]).agg(n=("n", "sum"), low=("v", "min"), high=("v", "max")).reset_index()
            yield pa.RecordBatch.from_pandas(out.astype({"c": "int32", "r": "int32", "n": "int64"}), preserve_index=False)

    ranges = (
        counted.mapInArrow(count, "c int, r int, n long, low double, high double")
        .groupBy("c", "r").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        .toArrow().to_pandas().sort_values(["c", "r"])
    )
    ranges["score"] = [forests[c][1][r] for c, r in zip(ranges["c"], ranges["r"])]
    return ranges


def _fit_part(df, columns, contamination, present):
    out = {}
    for c, ranges in ranges_of(df, columns, present).groupby("c"):
        cut = _weighted_percentile(ranges["score"].to_numpy(), ranges["n"].to_numpy(), contamination)
        inside = ranges[ranges["score"] >= cut]
        outliers = int(ranges.loc[ranges["score"] < cut, "n"].sum())
        bounds = (None, None) if inside.empty else (float(inside["low"].min()), float(inside["high"].max()))
        out[columns[c]] = FittedForest(bounds, outliers, [] if inside.empty else _join_ranges(ranges, cut))
    return out


def _weighted_percentile(scores, counts, share):
    """Linearly interpolated quantile of scores that occur ``counts`` times each."""
    order = np.argsort(scores)
    ends = np.cumsum(counts[order])
    position = share * (ends[-1] - 1)
    low, high = math.floor(position), math.ceil(position)
    at = [scores[order][np.searchsorted(ends, rank, side="right")] for rank in (low, high)]
    return at[0] + (at[1] - at[0]) * (position - low)


def _join_ranges(ranges, cut) -> list[tuple[float, float]]:
    """Neighbouring inlier ranges joined into as few closed intervals as possible."""
    joined: list[list[float]] = []
    previous = False
    for low, high, score in zip(ranges["low"], ranges["high"], ranges["score"]):
        inside = score >= cut
        if inside and previous:
            joined[-1][1] = float(high)
        elif inside:
            joined.append([float(low), float(high)])
        previous = inside
    return [(low, high) for low, high in joined]
