"""Exact quantiles of whole columns without sorting or gathering them.

``percentile`` keeps every distinct value of a column in one task, which only a
small table survives. Here the wanted order statistics are closed in by brackets, at
every size: a bounded random sample of each column proposes a bracket around each
wanted rank, one scan counts exactly how many values lie below and inside it, and the
few values inside are grouped and read out. A bracket that is still too full is sampled again
from its inside; one that missed its rank is moved. The answer never depends on the
sample, only the number of scans does. Copies of a hot value are combined before the
shuffle, or turn out to be a bracket of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.functions.columns import col

SAMPLE = 60_000          # sampled values per bracket and round
READ_OUT = 500_000       # values inside all brackets of one read-out, about
COLUMNS_PER_SCAN = 24
FEW = 100                # a bracket of so few values is never narrowed further
MOST_ROUNDS = 200


@dataclass(eq=False)
class _Target:
    column: str
    rank: int
    total: int                  # values in the column
    size: float                 # values strictly between low and high
    before: int = 0             # values up to and including low
    low: float = -math.inf      # the wanted value lies in [low, high]
    high: float = math.inf
    guess: float = math.inf     # size of a proposed bracket, before it is counted
    value: float | None = None

    @property
    def bracket(self) -> tuple[str, float, float]:
        return self.column, self.low, self.high


def _chunks(items: Sequence, size: int) -> Iterable[Sequence]:
    for start in range(0, len(items), size):
        yield items[start:start + size]


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    counts: dict[str, int] | None = None,
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column, NULLs skipped.

    ``counts`` are the non-null counts, if already known. Columns without values
    give a list of None.
    """
    columns = list(columns)
    if not columns:
        return {}
    if counts is None:
        row = df.agg(*[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
        counts = {c: row[f"c{i}"] for i, c in enumerate(columns)}
    result: dict[str, list[float | None]] = {c: [None] * len(probabilities) for c in columns}
    for part in _chunks([c for c in columns if counts[c]], COLUMNS_PER_SCAN):
        result.update(_by_brackets(df, part, probabilities, counts))
    return result


def approximate_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], accuracy: int = 10_000
) -> dict[str, list[float | None]]:
    """One scan, rank error at most 1/accuracy, no interpolation."""
    columns = list(columns)
    if not columns:
        return {}
    row = df.agg(*[
        F.percentile_approx(col(c).cast("double"), list(probabilities), accuracy).alias(f"c{i}")
        for i, c in enumerate(columns)
    ]).first()
    return {c: list(row[f"c{i}"] or [None] * len(probabilities)) for i, c in enumerate(columns)}


def _by_brackets(df, columns, probabilities, counts):
    values = df.select(*[col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    slot = {c: f"v{i}" for i, c in enumerate(columns)}
    wanted: dict[str, list[tuple[int, int, float]]] = {}
    targets: dict[tuple[str, int], _Target] = {}
    for c in columns:
        for p in probabilities:
            position = p * (counts[c] - 1)
            lower = math.floor(position)
            upper = min(lower + 1, counts[c] - 1)
            wanted.setdefault(c, []).append((lower, upper, position - lower))
            for rank in {lower, upper}:
                targets.setdefault((c, rank), _Target(c, rank, counts[c], counts[c]))

    for _ in range(MOST_ROUNDS):
        still_open = [t for t in targets.values() if t.value is None]
        if not still_open:
            break
        # Neighbouring ranks share their bracket, so each bracket is worked on once.
        sizes = {t.bracket: t.size for t in still_open}
        share = max(READ_OUT / len(sizes), FEW)
        wide = [t for t in still_open if t.size > share]
        if wide and sum(sizes.values()) > READ_OUT:
            _tighten(values, slot, wide)
            proposed = {t.bracket: t.guess if t in wide else t.size for t in still_open}
            if sum(proposed.values()) > READ_OUT:
                _count(values, slot, wide)
                continue
        _read_out(values, slot, still_open)
    else:
        raise RuntimeError("the quantile brackets did not close")

    found = {key: t.value for key, t in targets.items()}
    return {
        c: [found[c, lo] + (found[c, hi] - found[c, lo]) * part for lo, hi, part in wanted[c]]
        for c in columns
    }


def _inside(value, low, high):
    """low < value < high, written without infinite literals; NULL is outside."""
    condition = value.isNotNull()
    if low != -math.inf:
        condition = condition & (value > F.lit(low))
    if high != math.inf:
        condition = condition & (value < F.lit(high))
    return condition


def _by_bracket(targets):
    grouped: dict[tuple[str, float, float], list[_Target]] = {}
    for t in targets:
        grouped.setdefault(t.bracket, []).append(t)
    return list(grouped.items())


def _tighten(values, slot, targets):
    """Propose narrower brackets, and guess their sizes, from about SAMPLE values inside each."""
    grouped = _by_bracket(targets)
    entries = F.array(*[
        F.when(
            _inside(F.col(slot[c]), low, high) & (F.col("_draw") < min(1.0, SAMPLE / mine[0].size)),
            F.struct(F.lit(i).alias("b"), F.col(slot[c]).alias("v")),
        )
        for i, ((c, low, high), mine) in enumerate(grouped)
    ])
    drawn = (
        values.withColumn("_draw", F.rand(seed=17)).select(F.explode(entries).alias("e"))
        .where(F.col("e").isNotNull()).select("e.b", "e.v").toArrow().to_pandas()
    )
    samples = [drawn.loc[drawn["b"] == i, "v"].to_numpy() for i in range(len(grouped))]
    for (_, mine), sample in zip(grouped, samples):
        if len(sample) == 0:        # nothing learnt: the count decides how to go on
            for t in mine:
                t.guess = t.size
            continue
        sample = np.sort(sample)
        for t in mine:
            share = (t.rank - t.before + 0.5) / t.size
            margin = 4.5 * math.sqrt(max(share * (1 - share), 0.0) * len(sample)) + 3
            first = math.floor(share * len(sample) - margin)
            last = math.ceil(share * len(sample) + margin)
            if first >= 0:
                t.low = float(sample[first])
            if last < len(sample):
                t.high = float(sample[last])
            t.guess = t.size * (min(last, len(sample)) - max(first, 0)) / len(sample)


def _count(values, slot, targets):
    """One scan: exact counts around every bracket; close it, accept it or move it."""
    grouped = _by_bracket(targets)
    aggregates = []
    for i, ((c, low, high), _) in enumerate(grouped):
        value = F.col(slot[c])
        aggregates += [
            F.count_if(value < F.lit(low)).alias(f"below{i}"),
            F.count_if(value <= F.lit(low)).alias(f"low{i}"),
            F.count_if(value < F.lit(high)).alias(f"under{i}"),
            F.count_if(value <= F.lit(high)).alias(f"high{i}"),
        ]
    row = values.agg(*aggregates).first()
    for i, (_, mine) in enumerate(grouped):
        below, low, under, high = (row[f"{k}{i}"] for k in ("below", "low", "under", "high"))
        for t in mine:
            if t.rank < below:                  # the bracket missed: look to its left
                t.low, t.high, t.before, t.size = -math.inf, t.low, 0, below
            elif t.rank >= high:                # or to its right
                t.low, t.high, t.before, t.size = t.high, math.inf, high, t.total - high
            elif t.rank < low:
                t.value = t.low
            elif t.rank >= under:
                t.value = t.high
            else:
                t.before, t.size = low, under - low


def _read_out(values, slot, targets):
    """One scan: the values inside the brackets one by one, everything between them as counts.

    Per column the brackets cut the number line into regions 0, 1, 2, ...; odd regions
    are brackets and keep their values, even ones only count.
    """
    ranges: dict[str, list[list[float]]] = {}
    for c, low, high in sorted({t.bracket for t in targets}):
        mine = ranges.setdefault(c, [])
        if mine and low <= mine[-1][1]:
            mine[-1][1] = max(mine[-1][1], high)
        else:
            mine.append([low, high])
    numbers = {c: i for i, c in enumerate(ranges)}
    entries = F.array(*[_regions(numbers[c], F.col(slot[c]), mine) for c, mine in ranges.items()])
    frame = (
        values.select(F.explode(entries).alias("e")).where(F.col("e").isNotNull())
        .groupBy(F.col("e.c").alias("c"), F.col("e.r").alias("r"), F.col("e.v").alias("v"))
        .agg(F.count(F.lit(1)).alias("n")).toArrow().to_pandas()       # at most about READ_OUT rows
        .sort_values(["c", "r", "v"])
    )
    for c, mine in ranges.items():
        part = frame[frame["c"] == numbers[c]]
        for t in (t for t in targets if t.column == c):
            region = 2 * next(i for i, (low, high) in enumerate(mine) if low <= t.low <= high) + 1
            before = int(part.loc[part["r"] < region, "n"].sum())
            inner = part[part["r"] == region]
            ends = inner["n"].cumsum().to_numpy()
            inside = int(ends[-1]) if len(ends) else 0
            if t.rank < before:                     # the bracket missed: look to its left
                t.low, t.high, t.before, t.size = -math.inf, mine[region // 2][0], 0, before
            elif t.rank >= before + inside:         # or to its right
                t.low, t.high = mine[region // 2][1], math.inf
                t.before, t.size = before + inside, t.total - before - inside
            else:
                t.value = float(inner["v"].iloc[int((ends <= t.rank - before).sum())])


def _regions(number, value, ranges):
    """(column number, region, value if the region is a bracket) of one value."""
    def entry(region, shown):
        return F.struct(F.lit(number).alias("c"), F.lit(region).alias("r"), shown.alias("v"))

    nothing = F.lit(None).cast("double")
    chain = F.when(value.isNull(), F.lit(None))
    for i, (low, high) in enumerate(ranges):
        if low != -math.inf:
            chain = chain.when(value < F.lit(low), entry(2 * i, nothing))
        inside = F.lit(True) if high == math.inf else value <= F.lit(high)
        chain = chain.when(inside, entry(2 * i + 1, value))
    return chain        # what lies above the last bracket is not needed
