"""Principal components by a randomised range finder: no matrix of width squared, sparse rows stay sparse.

A few random directions are multiplied with the covariance in one pass over the rows (each task adds up width x directions
numbers), orthogonalised, and multiplied again until the variances along them are steady. If more than three quarters of
them are needed for the wanted share of the total variance, they are doubled and the search goes on from those found, up
to the full width.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Params
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.functions.runtime import ship_by_value
from brightloom.models import batches as ba

SEED, START, SLAB, STEADY, MOST_PASSES = 42, 16, 4096, 1e-7, 40
SUMS = "slab int, sums binary"

ship_by_value(ba.__name__)
ship_by_value(__name__)


def _multiplier(schema, directions: np.ndarray):
    width, n = directions.shape

    def multiply(batches):
        total = np.zeros((width, n))
        step = max(1, (1 << 22) // (width + n))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                rows = ba.Rows(batch.slice(at, step)["f"])
                total += rows.gathered(rows.times(directions), width)
        slabs = range(0, width, SLAB)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(range(len(slabs))), pa.int32()), pa.array([total[s : s + SLAB].tobytes() for s in slabs], pa.binary())], schema=schema)

    return multiply


def _adder(schema):
    def add(batches):
        at, total = None, None
        for batch in batches:
            for slab, sums in zip(batch["slab"].to_pylist(), batch["sums"]):
                sums = np.frombuffer(sums.as_buffer())
                if slab != at:
                    if at is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], schema=schema)
                    at, total = slab, np.zeros(len(sums))
                total += sums
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], schema=schema)

    return add


def times_covariance(rows: DataFrame, directions: np.ndarray, mean: np.ndarray, n: int) -> np.ndarray:
    """The covariance of the vectors ``f`` times ``directions``; width x directions numbers reach the driver."""
    schema = ba.arrow_schema(rows.sparkSession, SUMS)
    sums = rows.mapInArrow(_multiplier(schema, directions), SUMS).repartition("slab").sortWithinPartitions("slab").mapInArrow(_adder(schema), SUMS)
    raw = np.concatenate([np.frombuffer(r["sums"]) for r in sorted(sums.collect())]).reshape(directions.shape)
    return (raw - n * np.outer(mean, mean @ directions)) / max(n - 1, 1)


def find(rows: DataFrame, share: float | None = None, k: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Components (width x count) and the share of the total variance of each, for the vectors ``f`` of ``rows``.

    The fewest components that hold ``share``, or the first ``k``. Signs: each component's largest entry is positive.
    """
    stats = rows.select(Summarizer.metrics("mean", "variance", "count").summary(F.col("f")).alias("s")).first()["s"]
    mean, total, n = stats["mean"].toArray(), float(stats["variance"].toArray().sum()), stats["count"]
    width = len(mean)
    rng = np.random.default_rng(SEED)
    wanted = min(width, max(START, 2 * (k or 0)))
    found, variances = np.zeros((width, 0)), np.zeros(0)
    while True:
        fresh = rng.normal(size=(width, wanted - found.shape[1]))
        basis = np.linalg.qr(np.concatenate([found, fresh], axis=1))[0]
        for turn in range(MOST_PASSES):
            image = times_covariance(rows, basis, mean, n)
            inner = basis.T @ image
            values, rotation = np.linalg.eigh((inner + inner.T) / 2)
            values, rotation = np.maximum(values[::-1], 0), rotation[:, ::-1]
            found = basis @ rotation
            held = np.cumsum(values) / total if total > 0 else np.ones(wanted)
            enough = k if k is not None else int(np.searchsorted(held, share - 1e-12)) + 1
            # A few more directions than wanted make the wanted ones settle fast.
            short = enough > 3 * wanted // 4
            steady = len(variances) == wanted and np.abs(values - variances)[:enough].sum() <= STEADY * max(values.sum(), 1e-300)
            variances = values
            if wanted == width or (steady and not short) or (short and turn >= 2):
                break
            basis = np.linalg.qr(image @ rotation)[0]
        if wanted == width or not short:
            break
        wanted = min(width, 2 * wanted)
    enough = max(1, min(enough, width))
    found = found[:, :enough]
    found = found * np.where(found[np.abs(found).argmax(0), np.arange(enough)] < 0, -1.0, 1.0)
    return found, variances[:enough] / total if total > 0 else np.zeros(enough)


class RangePCA(Estimator, Params):
    """PCA of ``scaled`` into ``features`` (other columns by name); keeps a variance share, or k components."""

    def __init__(self, share: float | None = None, k: int | None = None, inputCol: str = "scaled", outputCol: str = "features"):
        super().__init__()
        self.share, self.k, self.inputCol, self.outputCol = share, k, inputCol, outputCol

    def _fit(self, df: DataFrame) -> RangePCAModel:
        components, shares = find(df.select(F.col(self.inputCol).alias("f")), self.share, self.k)
        return RangePCAModel(components, shares, self.inputCol, self.outputCol)


class RangePCAModel(Model):
    def __init__(self, components: np.ndarray, shares: np.ndarray, inputCol: str, outputCol: str):
        super().__init__()
        self.components, self.explainedVariance, self.inputCol, self.outputCol = components, shares, inputCol, outputCol

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.outputCol, array_to_vector(_projection(self.components)(F.col(self.inputCol))))


def _projection(components: np.ndarray):
    @F.arrow_udf("array<double>")
    def project(column: pa.Array) -> pa.Array:
        out = ba.Rows(column).times(components)
        return pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1], pa.array(out.ravel()))

    return project
