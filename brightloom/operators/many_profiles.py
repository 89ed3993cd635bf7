"""Profiles of many tables in a constant number of jobs, however many tables and columns there are.

1. counts of every column and of texts that are no dates: one aggregate row for each table
2. distinct values and the smallest and largest class: each column grouped on its own, by its own type, in one job
3. a bounded sample of each numeric column, of which those around the quartiles' ranks are ends
4. counts at the ends and between them, which place each rank at an end or between two; what lies there is sampled and counted
   again, until it is so little that the sample holds all of it and the rank is read from it. Each round cuts what is left
   by a hundred or more, and both passes read the columns of a table side by side
5. values outside the fences: one aggregate row for each table
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.functions.columns import col, dtype_of, is_nested, text_columns
from brightloom.functions.quantiles import FEW, MOST_ROUNDS
from brightloom.functions.runtime import ship_by_value

ship_by_value(__name__)

SAMPLE, READ_OUT = 400_000, 500_000   # values of all columns together that reach the driver: sampled, and read out in the end, about
MOST_ENDS = 128                       # sampled values at which is counted, for each rank
LONG = 32                             # a longer text is counted by its md5

Key = tuple[int, int]


class Span(NamedTuple):
    """Bounds that hold a wanted value, the values below them, and between them, themselves included."""

    low: float
    high: float
    before: int
    size: int


def _together(parts: Sequence[DataFrame]) -> list:
    return reduce(DataFrame.unionAll, parts).collect() if parts else []


def _number(df: DataFrame, name: str):
    return F.nanvl(col(name).cast("double"), F.lit(math.inf))


def _class(df: DataFrame, name: str):
    """What equal values share; 0.0 and -0.0 are grouped as one."""
    if dtype_of(df, name).typeName() not in ("string", "varchar", "char"):
        return col(name)
    return F.when(F.octet_length(col(name)) > LONG, F.concat(F.lit("md5 "), F.md5(col(name)))).otherwise(col(name))


def counts(tables: Sequence[DataFrame], parse_date) -> list[tuple[int, dict[str, int], set[str]]]:
    """For each table: rows, values of each column, and the text columns whose values are all dates."""
    parts = []
    for t, df in enumerate(tables):
        texts = set(text_columns(df))
        bad = [F.count_if(col(c).isNotNull() & parse_date(col(c)).isNull()) if c in texts else F.lit(None).cast("long") for c in df.columns]
        parts.append(df.agg(F.lit(t).alias("t"), F.count("*").alias("rows"), F.array(*[F.count(col(c)) for c in df.columns]).alias("n"), F.array(*bad).alias("bad")))
    out = []
    for row in sorted(_together(parts), key=lambda r: r["t"]):
        names = tables[row["t"]].columns
        dates = {c for c, n, b in zip(names, row["n"], row["bad"]) if b == 0 and n}
        out.append((row["rows"], dict(zip(names, row["n"])), dates))
    return out


def classes(tables: Sequence[DataFrame]) -> dict[Key, tuple[int, int, int]]:
    """(table, column): distinct values, and the rows of the rarest and of the most frequent."""
    parts = []
    for t, df in enumerate(tables):
        for c, name in enumerate(df.columns):
            if not is_nested(dtype_of(df, name)):
                each = df.where(col(name).isNotNull()).groupBy(_class(df, name).alias("v")).agg(F.count("*").alias("n"))
                parts.append(each.agg(F.lit(t).alias("t"), F.lit(c).alias("c"), F.count("*").alias("d"), F.min("n").alias("low"), F.max("n").alias("high")))
    return {(r["t"], r["c"]): (r["d"], r["low"], r["high"]) for r in _together(parts) if r["d"]}


def quantiles(tables: Sequence[DataFrame], columns: Sequence[Sequence[str]], present: Sequence[dict[str, int]],
              probabilities: Sequence[float], sample: int = SAMPLE, read_out: int = READ_OUT) -> dict[Key, list[float]]:
    """Linearly interpolated exact quantiles of every (table, column) with values."""
    wanted: dict[tuple[Key, int], float | None] = {}
    asked: dict[Key, list[tuple[int, int, float]]] = {}
    span: dict[tuple[Key, int], Span] = {}
    for t, own in enumerate(columns):
        for c in own:
            n, key = present[t][c], (t, tables[t].columns.index(c))
            whole = Span(-math.inf, math.inf, 0, n)
            for p in probabilities if n else ():
                place = p * (n - 1)
                low = math.floor(place)
                high = min(low + 1, n - 1)
                asked.setdefault(key, []).append((low, high, place - low))
                for rank in (low, high):
                    wanted[key, rank], span[key, rank] = None, whole
    for number in range(MOST_ROUNDS):
        still = [target for target, value in wanted.items() if value is None]
        if not still:
            break
        open_: dict[Key, set[Span]] = {}
        for key, rank in still:
            open_.setdefault(key, set()).add(span[key, rank])
        spans = {key: sorted(own) for key, own in open_.items()}
        total, parts = sum(s.size for own in spans.values() for s in own), sum(map(len, spans.values()))
        each = math.inf if total <= max(read_out, FEW * parts) else max(FEW, sample // parts)
        drawn = _drawn(tables, spans, each, number)
        ends: dict[tuple[Key, Span], set[float]] = {}
        for key, rank in still:
            own = span[key, rank]
            found = drawn.get((key, own), np.zeros(0))
            if own.size <= each:
                wanted[key, rank] = float(found[rank - own.before])
            else:
                ends.setdefault((key, own), set()).update(_ends(found, (rank - own.before + 0.5) / own.size))
        if not ends:
            continue
        counted = _counted(tables, ends)
        for key, rank in still:
            if (key, span[key, rank]) in ends:
                wanted[key, rank], span[key, rank] = _closer(rank, span[key, rank], *counted[key, span[key, rank]])
    else:
        raise RuntimeError("the quantile brackets did not close")
    return {key: [wanted[key, a] + (wanted[key, b] - wanted[key, a]) * part for a, b, part in own] for key, own in asked.items()}


def _by_table(tables, keys, task, ddl: str) -> DataFrame:
    """The rows that ``task(t, columns)`` makes of the batches of each table, which hold the given columns as doubles."""
    parts = []
    for t in sorted({t for t, _ in keys}):
        own = sorted(c for u, c in keys if u == t)
        names = [tables[t].columns[c] for c in own]
        parts.append(tables[t].select(*[_number(tables[t], n).alias(f"v{c}") for n, c in zip(names, own)]).mapInArrow(task(t, own), ddl))
    return reduce(DataFrame.unionAll, parts)


def _values(batch, c: int) -> np.ndarray:
    return batch[f"v{c}"].drop_null().to_numpy(zero_copy_only=False) + 0.0    # -0.0 is 0.0


def _drawn(tables, spans: dict[Key, list[Span]], each: float, number: int) -> dict:
    """About ``each`` of the values in each span, sorted; all of them if there are no more."""
    def task(t, columns):
        own = [(c, [(i, s.low, s.high, min(1.0, each / max(1, s.size))) for i, s in enumerate(spans[t, c])]) for c in columns]

        def draw(batches):
            rng = np.random.default_rng([17, number, t, TaskContext.get().partitionId()])
            for batch in batches:
                out = [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0))]
                for c, ranges in own:
                    v = _values(batch, c)
                    for i, low, high, share in ranges:
                        inside = v if (low, high) == (-math.inf, math.inf) else v[(v >= low) & (v <= high)]
                        inside = inside if share >= 1 else inside[rng.random(len(inside)) < share]
                        out.append((np.full(len(inside), c, np.int32), np.full(len(inside), i, np.int32), inside))
                column, place, value = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(value), t, np.int32)), pa.array(column), pa.array(place), pa.array(value)], ["t", "c", "i", "v"])

        return draw

    rows = _by_table(tables, spans, task, "t int, c int, i int, v double").toArrow().to_pandas()
    return {((t, c), spans[t, c][i]): np.sort(part["v"].to_numpy()) for (t, c, i), part in rows.groupby(["t", "c", "i"])}


def _ends(found: np.ndarray, share: float) -> list[float]:
    """Up to ``MOST_ENDS`` sampled values around the wanted one, so wide that they miss it hardly ever."""
    if not len(found):
        return []
    margin = 4.5 * math.sqrt(share * (1 - share) * len(found)) + 3
    first, last = max(0, math.floor(share * len(found) - margin)), min(len(found) - 1, math.ceil(share * len(found) + margin))
    places = np.linspace(first, last, min(MOST_ENDS, last - first + 1)).round().astype(int)
    return found[places].tolist()


def _counted(tables, ends: dict[tuple[Key, Span], set[float]]) -> dict:
    """(ends, values in each region) of each span. Region 2i + 1 is the i-th end, 2i what lies below it."""
    at: dict[Key, list] = {}
    for (key, own), points in sorted(ends.items()):
        at.setdefault(key, []).append((own, np.array(sorted(points))))

    def task(t, columns):
        own = [(c, [(s.low, s.high, points) for s, points in at[t, c]]) for c in columns]

        def count(batches):
            sums = {(c, i): np.zeros(2 * len(points) + 1, np.int64) for c, ranges in own for i, (_, _, points) in enumerate(ranges)}
            for batch in batches:
                for c, ranges in own:
                    v = _values(batch, c)
                    for i, (low, high, points) in enumerate(ranges):
                        inside = v if (low, high) == (-math.inf, math.inf) else v[(v >= low) & (v <= high)]
                        place = np.searchsorted(points, inside)
                        region = 2 * place + (np.append(points, np.nan)[place] == inside)
                        sums[c, i] += np.bincount(region, minlength=2 * len(points) + 1)
            for (c, i), n in sums.items():
                r = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(np.full(len(r), x, np.int32)) for x in (t, c, i)), pa.array(r.astype(np.int32)), pa.array(n[r])], ["t", "c", "i", "r", "n"])

        return count

    rows = _by_table(tables, at, task, "t int, c int, i int, r int, n long").groupBy("t", "c", "i", "r").agg(F.sum("n").alias("n")).collect()
    out = {(key, own): (points, np.zeros(2 * len(points) + 1, np.int64)) for key, all_ in at.items() for own, points in all_}
    for r in rows:
        key = (r["t"], r["c"])
        out[key, at[key][r["i"]][0]][1][r["r"]] = r["n"]
    return out


def _closer(rank: int, own: Span, points: np.ndarray, counts: np.ndarray) -> tuple[float | None, Span]:
    """The value of a rank, if it is an end, or the region between two ends that holds it."""
    upto = np.cumsum(counts)
    r = int(np.searchsorted(upto, rank - own.before, side="right"))
    if r % 2:
        return float(points[r // 2]), own
    low = float(np.nextafter(points[r // 2 - 1], math.inf)) if r else own.low
    high = float(np.nextafter(points[r // 2], -math.inf)) if r < 2 * len(points) else own.high
    return None, Span(low, high, own.before + int(upto[r] - counts[r]), int(counts[r]))


def outside(tables: Sequence[DataFrame], fences: Sequence[dict[str, tuple[float, float]]]) -> list[int]:
    """For each table, the values outside the fences of their columns."""
    parts = []
    for t, (df, own) in enumerate(zip(tables, fences)):
        if own:
            found = [F.count_if((col(c) < low) | (col(c) > high)) for c, (low, high) in own.items()]
            parts.append(df.agg(F.lit(t).alias("t"), reduce(lambda a, b: a + b, found).alias("n")))
    out = dict.fromkeys(range(len(tables)), 0) | {r["t"]: r["n"] for r in _together(parts)}
    return list(out.values())
