"""Support vectors with a radial kernel: random Fourier features in front of the linear machine."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml import classification as cl
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.functions.runtime import ship_by_value
from brightloom.models import batches as ba

SEED = 42
TASK_BYTES = 4 << 20   # of lifted rows that a task goes over in every iteration, about

ship_by_value(ba.__name__)
ship_by_value(__name__)


def scale_gamma(df: DataFrame, features: str) -> tuple[float, int, int]:
    """1 / (width * variance of all entries), the width, and the rows."""
    s = df.select(Summarizer.metrics("mean", "variance", "count").summary(F.col(features)).alias("s")).first()["s"]
    mean, n = s["mean"].toArray(), s["count"]
    within = s["variance"].toArray() * (n - 1) / max(n, 1)
    spread = float((within + mean**2).mean() - mean.mean() ** 2)
    return 1 / (len(mean) * spread) if spread > 0 else 1.0, len(mean), n


def fourier(width: int, components: int, gamma: float):
    """The map x -> sqrt(2 / components) cos(w x + b), whose inner products come near exp(-gamma |x - y|^2)."""
    rng = np.random.default_rng(SEED)
    directions = rng.normal(size=(width, components)) * math.sqrt(2 * gamma)
    shift, size = rng.uniform(0, 2 * math.pi, components), math.sqrt(2 / components)

    @F.arrow_udf("array<double>")
    def lift(column: pa.Array) -> pa.Array:
        out = np.cos(ba.Rows(column).times(directions) + shift) * size
        return pa.ListArray.from_arrays(np.arange(len(out) + 1, dtype=np.int32) * components, pa.array(out.ravel()))

    return lift


class _Settings(Params):
    def __init__(self):
        super().__init__()
        number = TypeConverters.toFloat
        self.C = Param(self, "C", "weight of the misfit against the margin", number)
        self.kernel = Param(self, "kernel", "rbf or linear", TypeConverters.toString)
        self.gamma = Param(self, "gamma", "width of the radial kernel, 0 for 1 / (width * variance)", number)
        self.components = Param(self, "components", "random features", TypeConverters.toInt)
        self._setDefault(C=1.0, kernel="rbf", gamma=0.0, components=256)


class KernelMachine(Estimator, _Settings):
    """``features``, ``label`` to ``prediction``; more than two classes one against the rest."""

    def __init__(self, **settings):
        super().__init__()
        self._set(**settings)

    def _fit(self, df: DataFrame) -> KernelMachineModel:
        gamma, width, n = scale_gamma(df, "features")
        lift = None
        if self.getOrDefault(self.kernel) == "rbf":
            lift = fourier(width, self.getOrDefault(self.components), self.getOrDefault(self.gamma) or gamma)
        machine = cl.LinearSVC(featuresCol="lifted", regParam=1 / (self.getOrDefault(self.C) * max(n, 1)), maxIter=100, standardization=False)
        classes = df.agg(F.max("label")).first()[0]
        if classes is not None and classes > 1:
            machine = cl.OneVsRest(classifier=machine, featuresCol="lifted")
        tasks = -(-n * 8 * (width if lift is None else self.getOrDefault(self.components)) // TASK_BYTES)
        spread = df.repartition(tasks) if tasks > df.rdd.getNumPartitions() else df
        return KernelMachineModel(lift, machine.fit(_lifted(spread, lift)))


class KernelMachineModel(Model):
    def __init__(self, lift, machine):
        super().__init__()
        self.lift, self.machine = lift, machine

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.machine.transform(_lifted(df, self.lift)).drop("lifted")


def _lifted(df: DataFrame, lift) -> DataFrame:
    return df.withColumn("lifted", F.col("features") if lift is None else array_to_vector(lift(F.col("features"))))
