"""Joining clusters (Ward) over any number of rows by mergeable clustering features.

A clustering feature is (n, mean, squared distances to the mean). Each task keeps at most ``most`` of them: a row joins the nearest one if that
adds no more than the task's last merges did, else it starts one; when there are twice too many, the cheapest merges are
made. Tasks' features are merged in a tree, ``most`` at a time, and the bounded rest is joined into ``k`` clusters. A row's
cluster is that of its nearest feature. With at most ``most`` distinct rows nothing is merged beforehand, so the
result is that of joining the rows themselves; beyond, features depend on how the rows are dealt to tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.functions.runtime import materialise, ship_by_value
from brightloom.models import batches as ba

FEATURES = "n double, centre binary, inner double"
FAN_IN = 16

ship_by_value(ba.__name__)
ship_by_value(__name__)


def ward(n: np.ndarray, centres: np.ndarray) -> list[tuple[int, int, float]]:
    """All merges (first, second, cost) of clusters of ``n`` rows at ``centres``, cheapest first, by chains of nearest neighbours.

    The merged cluster keeps the number of the second. A cost is what the merge adds to the squared distances.
    """
    n, centres = n.astype(float).copy(), centres.astype(float).copy()
    alive, chain, merges = np.ones(len(n), bool), [], []
    while len(merges) < len(n) - 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        a = chain[-1]
        cost = n * n[a] / (n + n[a]) * ((centres - centres[a]) ** 2).sum(1)
        cost[~alive] = np.inf
        cost[a] = np.inf
        b = int(cost.argmin())
        if len(chain) > 1 and cost[chain[-2]] <= cost[b]:
            b = chain[-2]
            chain = chain[:-2]
            merges.append((a, b, float(cost[b])))
            centres[b] = (n[a] * centres[a] + n[b] * centres[b]) / (n[a] + n[b])
            n[b] += n[a]
            alive[a] = False
        else:
            chain.append(b)
    return sorted(merges, key=lambda m: m[2])


def groups(size: int, merges: list[tuple[int, int, float]], k: int) -> np.ndarray:
    """The group 0 .. k - 1 of each of ``size`` clusters after the cheapest merges, numbered by first member."""
    parent = list(range(size))

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b, _ in merges[: max(0, size - k)]:
        parent[top(a)] = top(b)
    tops = [top(i) for i in range(size)]
    return np.array([list(dict.fromkeys(tops)).index(t) for t in tops], np.int64) if size else np.zeros(0, np.int64)


class FeatureSet:
    """At most ``most`` clustering features after ``reduce``, under twice as many between."""

    def __init__(self, most: int, width: int):
        self.most, self.limit = most, 0.0
        self.n, self.centre, self.inner = np.zeros(0), np.zeros((0, width)), np.zeros(0)

    def add(self, n: np.ndarray, centre: np.ndarray, inner: np.ndarray):
        for at in range(0, len(n), self.most):
            self._add(*(x[at : at + self.most] for x in (n, centre, inner)))

    def _add(self, n, centre, inner):
        far = np.ones(len(n), bool)
        if len(self.n):
            squared = np.maximum((centre**2).sum(1)[:, None] + (self.centre**2).sum(1) - 2 * centre @ self.centre.T, 0)
            near = squared.argmin(1)
            gap = ((centre - self.centre[near]) ** 2).sum(1)
            far = n * self.n[near] / (n + self.n[near]) * gap > self.limit
            self._join(near[~far], n[~far], centre[~far], inner[~far])
        n, centre, inner = n[far], centre[far], inner[far]
        # Equal rows are one feature.
        _, first, same = np.unique(centre, axis=0, return_index=True, return_inverse=True) if len(n) else (None, np.zeros(0, int), np.zeros(0, int))
        same = same.ravel()
        self.centre = np.concatenate([self.centre, centre[first]])
        self.n = np.concatenate([self.n, np.bincount(same, n, len(first))])
        self.inner = np.concatenate([self.inner, np.bincount(same, inner, len(first))])
        if len(self.n) > self.most:
            self.reduce()

    def _join(self, near, n, centre, inner):
        if not len(near):
            return
        size = len(self.n)
        extra = np.bincount(near, n, size)
        total = self.n + extra
        sums = self.centre * self.n[:, None]
        np.add.at(sums, near, centre * n[:, None])
        mean = sums / total[:, None]
        spread = self.inner + self.n * ((self.centre - mean) ** 2).sum(1)
        self.inner = spread + np.bincount(near, inner + n * ((centre - mean[near]) ** 2).sum(1), size)
        self.n, self.centre = total, mean

    def reduce(self):
        merges = ward(self.n, self.centre)
        made = merges[: max(0, len(self.n) - self.most)]
        group = groups(len(self.n), merges, self.most)
        count = int(group.max()) + 1
        n = np.bincount(group, self.n, count)
        mean = np.zeros((count, self.centre.shape[1]))
        np.add.at(mean, group, self.centre * self.n[:, None])
        mean /= n[:, None]
        self.inner = np.bincount(group, self.inner + self.n * ((self.centre - mean[group]) ** 2).sum(1), count)
        self.n, self.centre = n, mean
        self.limit = max(self.limit, made[-1][2] if made else 0.0)

    def batch(self, schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.n), pa.array([c.tobytes() for c in self.centre], pa.binary()), pa.array(self.inner)], schema=schema)


def _from_rows(schema, most):
    def build(batches):
        features = None
        for batch in batches:
            x = ba.matrix(batch["x"])
            if len(x):
                features = features or FeatureSet(most, x.shape[1])
                features.add(np.ones(len(x)), x, np.zeros(len(x)))
        if features:
            yield features.batch(schema)

    return build


def _from_features(schema, most):
    def merge(batches):
        features = None
        for batch in batches:
            if batch.num_rows:
                centre = np.stack([np.frombuffer(c.as_buffer()) for c in batch["centre"]])
                features = features or FeatureSet(most, centre.shape[1])
                features.add(batch["n"].to_numpy(), centre, batch["inner"].to_numpy())
        if features:
            yield features.batch(schema)

    return merge


def clustering_features(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, centres) of at most ``most`` features of the arrays ``x``; they are all that reaches the driver."""
    schema = ba.arrow_schema(rows.sparkSession, FEATURES)
    found = materialise(rows.mapInArrow(_from_rows(schema, most), FEATURES), "features")
    tasks = max(1, -(-found.count() // most))
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        found = materialise(found.repartition(tasks).mapInArrow(_from_features(schema, most), FEATURES), "features")
    rest = found.coalesce(1).mapInArrow(_from_features(schema, most), FEATURES).collect()
    rest = sorted(rest, key=lambda r: tuple(np.frombuffer(r["centre"])))
    return np.array([r["n"] for r in rest]), np.array([np.frombuffer(r["centre"]) for r in rest])


class JoinedClusters(Estimator):
    """``features`` to ``prediction``, ``k`` clusters by joining."""

    def __init__(self, k: int = 3, most: int = 512):
        super().__init__()
        self.clusters, self.most = k, most

    def _fit(self, df: DataFrame) -> JoinedClustersModel:
        n, centres = clustering_features(df.select(ba.dense(df, "features")).where("x is not null"), self.most)
        return JoinedClustersModel(centres, groups(len(n), ward(n, centres), self.clusters))


class JoinedClustersModel(Model):
    def __init__(self, centres: np.ndarray, cluster: np.ndarray):
        super().__init__()
        self.centres, self.cluster = centres, cluster

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", _nearest(self.centres, self.cluster)(ba.dense(df, "features")))


def _nearest(centres, cluster):
    @F.arrow_udf("int")
    def nearest(column: pa.Array) -> pa.Array:
        x = ba.matrix(column)
        if not len(x):
            return pa.array([], pa.int32())
        squared = (centres**2).sum(1) - 2 * x @ centres.T
        return pa.array(cluster[squared.argmin(1)].astype(np.int32))

    return nearest
