"""Cox regression by its partial likelihood, with tied times after Efron.

Rows are sorted once by falling time, so that the rows at risk at a time are those before its end. Each Newton step
is two passes over the sorted rows. The first adds up exp(xb), exp(xb) x and exp(xb) x x' of every run of rows that a task reads,
and of the tied times at both ends of the run. The driver, which gets one such row for each run, adds these up in
order: what is at risk before each run, and whole sums for the tied times that go over its ends. The second pass adds up
likelihood, gradient and curvature of the tied times inside each run. So a time that many rows share is spread, too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.errors import StepError
from brightloom.functions.runtime import ship_by_value
from brightloom.functions.values import with_row_index
from brightloom.models import batches as ba

ENDS = "first long, last long, total binary, ends binary"
INSIDE = "first long, value double, gradient binary, curvature binary"

ship_by_value(ba.__name__)
ship_by_value(__name__)


class Sums:
    """Sums over rows: w, w x, w x x' of all and of those with an event, events, and xb and x of the events."""

    def __init__(self, d: int, size: int = 1):
        self.d = d
        self.values = np.zeros((size, 2 * (1 + d + d * d) + 2 + d))

    @property
    def parts(self):
        d, q = self.d, 1 + self.d + self.d**2
        v = self.values
        all_, hit, rest = v[:, :q], v[:, q : 2 * q], v[:, 2 * q :]
        square = lambda s: s[:, 1 + d :].reshape(-1, d, d)
        return (all_[:, 0], all_[:, 1 : 1 + d], square(all_)), (hit[:, 0], hit[:, 1 : 1 + d], square(hit)), (rest[:, 0], rest[:, 1], rest[:, 2:])


def summed(x, beta, event, starts) -> np.ndarray:
    """The sums of each group of rows that begins at ``starts``."""
    xb = x @ beta
    w = np.exp(xb)
    square = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
    q = np.concatenate([np.ones((len(x), 1)), x, square], axis=1) * w[:, None]
    rows = np.concatenate([q, q * event[:, None], event[:, None], (xb * event)[:, None], x * event[:, None]], axis=1)
    return np.add.reduceat(rows, starts, axis=0)


def tied(n: float, s0: float, d0: float) -> tuple[float, float, float, float, float, float]:
    """Over l = 0 .. n - 1 with f = l / n and p = s0 - f d0: the sums of log p, 1/p, f/p, 1/p^2, f/p^2, f^2/p^2."""
    out = np.zeros(6)
    for at in range(0, int(n), 1 << 20):
        f = np.arange(at, min(int(n), at + (1 << 20))) / n
        p = s0 - f * d0
        out += [np.log(p).sum(), (1 / p).sum(), (f / p).sum(), (1 / p**2).sum(), (f / p**2).sum(), (f**2 / p**2).sum()]
    return tuple(out)


def contributions(groups: np.ndarray, risk: np.ndarray, d: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood, gradient and curvature of tied times; ``risk``: the sums w, w x, w x x' at risk at each."""
    sums = Sums(d, 0)
    sums.values = groups
    _, (d0, d1, d2), (n, xb, x) = sums.parts
    some = np.flatnonzero(n > 0)
    value, gradient, curvature = float(xb.sum()), x.sum(0), np.zeros((d, d))
    if not len(some):
        return value, gradient, curvature
    s0, s1, s2 = risk[:, 0], risk[:, 1 : 1 + d], risk[:, 1 + d :].reshape(-1, d, d)
    one = some[n[some] == 1]
    if len(one):
        z = s1[one] / s0[one, None]
        value -= np.log(s0[one]).sum()
        gradient = gradient - z.sum(0)
        curvature += (s2[one] / s0[one, None, None]).sum(0) - z.T @ z
    for g in some[n[some] > 1].tolist():
        logs, a, b, c, e, h = tied(n[g], s0[g], d0[g])
        cross = np.outer(s1[g], d1[g])
        value -= logs
        gradient = gradient - a * s1[g] + b * d1[g]
        curvature += a * s2[g] - b * d2[g] - c * np.outer(s1[g], s1[g]) + e * (cross + cross.T) - h * np.outer(d1[g], d1[g])
    return value, gradient, curvature


def _runs(batches, beta):
    """(first row, times and sums of tied times) in pieces of each run of consecutive rows; the last piece of a run has None."""
    at, first = None, None
    step = max(1, (1 << 20) // (len(beta) ** 2 + 1))
    for batch in batches:
        rows = batch["_row"].to_numpy()
        cuts = np.flatnonzero(np.diff(rows) != 1) + 1
        for a, b in zip(np.append(0, cuts).tolist(), np.append(cuts, len(rows)).tolist()):
            for low in range(a, b, step):
                high = min(b, low + step)
                if low == a and at != rows[a]:
                    if first is not None:
                        yield first, None, None
                    first = int(rows[a])
                at = int(rows[high - 1]) + 1
                time = batch["time"].to_numpy()[low:high]
                starts = np.append(0, np.flatnonzero(np.diff(time) != 0) + 1)
                x, event = ba.matrix(batch["x"].slice(low, high - low)), batch["event"].to_numpy()[low:high]
                yield first, time[starts], summed(x, beta, event, starts)
    if first is not None:
        yield first, None, None


def _ends(schema, beta):
    q = 1 + len(beta) + len(beta) ** 2

    def ends(batches):
        total, edge = np.zeros(q), []
        for first, times, groups in _runs(batches, beta):
            if times is None:
                packed = [np.concatenate([[t], g]) for t, g in edge]
                yield pa.RecordBatch.from_arrays([
                    pa.array([first]), pa.array([len(edge)], pa.int64()), pa.array([total.tobytes()], pa.binary()),
                    pa.array([np.array(packed).tobytes()], pa.binary())], schema=schema)
                total, edge = np.zeros(q), []
                continue
            total += groups[:, :q].sum(0)
            for i in sorted({0, len(times) - 1}):
                if edge and edge[-1][0] == times[i]:
                    edge[-1] = (times[i], edge[-1][1] + groups[i])
                else:
                    edge = [*edge[:1], (times[i], groups[i].copy())]
        return

    return ends


def _inside(schema, beta, before: dict[int, np.ndarray]):
    d = len(beta)
    q = 1 + d + d * d

    def inside(batches):
        risk, held, opened, sums = None, None, False, [0.0, np.zeros(d), np.zeros((d, d))]

        def take(groups):
            nonlocal risk
            at_risk = risk + np.cumsum(groups[:, :q], axis=0)
            for i, part in enumerate(contributions(groups, at_risk, d)):
                sums[i] = sums[i] + part
            risk = at_risk[-1]

        for first, times, groups in _runs(batches, beta):
            if times is None:
                yield pa.RecordBatch.from_arrays([
                    pa.array([first]), pa.array([float(sums[0])]), pa.array([np.asarray(sums[1]).tobytes()], pa.binary()),
                    pa.array([np.asarray(sums[2]).tobytes()], pa.binary())], schema=schema)
                risk, held, opened, sums = None, None, False, [0.0, np.zeros(d), np.zeros((d, d))]
                continue
            if risk is None:
                risk = before[first].copy()
            if held is not None and held[0] == times[0]:
                groups = groups.copy()
                groups[0] += held[1]
            elif held is not None:
                times, groups = np.append(held[0], times), np.concatenate([held[1][None], groups])
            # The last tied time waits for more rows; the run's first and last are the driver's.
            held, done = (times[-1], groups[-1]), groups[:-1]
            if len(done) and not opened:
                opened = True
                risk = risk + done[0, :q]
                done = done[1:]
            if len(done):
                take(done)

    return inside


def evaluate(rows: DataFrame, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood, gradient and curvature at ``beta`` over sorted rows (_row, time, event, x)."""
    spark, d = rows.sparkSession, len(beta)
    q = 1 + d + d * d
    runs = sorted(rows.mapInArrow(_ends(ba.arrow_schema(spark, ENDS), beta), ENDS).collect(), key=lambda r: r["first"])
    before, risk, edges = {}, np.zeros(q), []
    for r in runs:
        before[r["first"]] = risk
        total = np.frombuffer(r["total"])
        found = np.frombuffer(r["ends"]).reshape(r["last"], -1)
        for i, row in enumerate(found):
            start = risk if i == 0 else risk + total - row[1 : 1 + q]
            if edges and edges[-1][0] == row[0]:
                edges[-1] = (row[0], edges[-1][1] + row[1:], edges[-1][2])
            else:
                edges.append((row[0], row[1:].copy(), start))
        risk = risk + total
    groups = np.array([e[1] for e in edges])
    out = list(contributions(groups, np.array([e[2] for e in edges]) + groups[:, :q], d))
    for r in rows.mapInArrow(_inside(ba.arrow_schema(spark, INSIDE), beta, before), INSIDE).collect():
        out[0] += r["value"]
        out[1] = out[1] + np.frombuffer(r["gradient"])
        out[2] = out[2] + np.frombuffer(r["curvature"]).reshape(d, d)
    return float(out[0]), out[1], out[2]


class CoxHazards(Estimator):
    """``features``, ``label`` (time) and ``censor`` (1: the event was seen) to ``prediction``, the relative hazard exp(xb).

    Where the features put the times in perfect order the likelihood has no maximum; the last finite step is kept then.
    """

    def __init__(self, ridge: float = 0.0, rounds: int = 30):
        super().__init__()
        self.ridge, self.rounds = ridge, rounds

    def _fit(self, df: DataFrame) -> CoxHazardsModel:
        rows = df.select(F.col("label").cast("double").alias("time"), F.col("censor").cast("double").alias("event"), ba.dense(df, "features"))
        rows = rows.where("time is not null and event is not null and x is not null")
        if not rows.where("event > 0").limit(1).count():
            raise StepError("train", "no event was seen")
        rows = with_row_index(rows, [F.desc("time"), F.xxhash64("x", "event", F.monotonically_increasing_id())], "_row")
        width = ba.width_of(rows, "x")
        mean = np.array([r for r in rows.agg(*[F.avg(F.col("x")[i]) for i in range(width)]).first()])
        rows = rows.withColumn("x", F.zip_with("x", F.lit(mean.tolist()), lambda a, b: a - b))
        beta = np.zeros(width)
        value, gradient, curvature = evaluate(rows, beta)
        for _ in range(self.rounds):
            step = np.linalg.lstsq(curvature + self.ridge * np.eye(width), gradient - self.ridge * beta, rcond=1e-10)[0]
            size, better = 1.0, None
            while better is None and size > 1e-4:
                to = beta + size * step
                with np.errstate(all="ignore"):
                    trial = evaluate(rows, to)
                gain = trial[0] - value - self.ridge / 2 * (to @ to - beta @ beta)
                if all(np.isfinite(part).all() for part in trial) and gain >= -1e-9 * abs(value):
                    better = trial
                size /= 2
            if better is None:   # the likelihood grows without end, or no longer at this precision
                break
            moved = np.abs(to - beta).max()
            beta, (value, gradient, curvature) = to, better
            if moved < 1e-8 or gain < 1e-10 * abs(value):
                break
        return CoxHazardsModel(beta, mean, value)


class CoxHazardsModel(Model):
    def __init__(self, coefficients: np.ndarray, mean: np.ndarray, log_likelihood: float):
        super().__init__()
        self.coefficients, self.mean, self.logLikelihood = coefficients, mean, log_likelihood

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", _hazard(self.coefficients, self.mean)(ba.dense(df, "features")))


def _hazard(coefficients, mean):
    @F.arrow_udf("double")
    def hazard(column: pa.Array) -> pa.Array:
        return pa.array(np.exp((ba.matrix(column) - mean) @ coefficients) if len(column) else [], pa.float64())

    return hazard
