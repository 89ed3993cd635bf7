"""Labelled rows to learn from, held-out rows, and the calibration of a score."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold(parts: int):
    """The remainder of crc32(doc_id as text); NULL for a NULL doc_id."""
    return F.crc32(F.col("doc_id").cast("string")) % parts


def training_rows(docs: DataFrame, labels: DataFrame, label: str, allowed, most: int) -> DataFrame:
    """doc_id, text, y (0 or 1) and half (0 or 1) of at most ``most`` labelled rows for which ``allowed`` holds.

    A bounded sample by hash of doc_id; a document labelled several times takes its largest label; NULL labels and ids are
    left out. A doc_id on several documents labels each of them; its repeated texts count once. The rows are chosen by
    id and text hash first, so no more than ``most`` whole texts are ever brought together.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & allowed)
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
        .withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(most)
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    chosen = (
        texts.join(F.broadcast(known), "doc_id").groupBy("doc_id", "t").agg(F.first("y").alias("y"), F.first("h").alias("h"))
        .orderBy("h", "doc_id", "t").limit(most)
    )
    return texts.join(F.broadcast(chosen), ["doc_id", "t"]).groupBy("doc_id", "t", "y", "h").agg(F.min("text").alias("text")).select(
        "doc_id", "text", "y", F.pmod("h", F.lit(2)).cast("int").alias("half")
    )


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights (the first for the constant) of a logistic fit by Newton steps; without both classes, the smoothed rate."""
    x = np.column_stack([np.ones(len(x)), x]).astype(float)
    w = np.zeros(x.shape[1])
    rate = (y.sum() + 0.5) / (len(y) + 2)
    w[0] = np.log(rate / (1 - rate))
    if len(y) == 0 or y.min() == y.max():
        return w
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(
            (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty) + 1e-9 * np.eye(len(w)), x.T @ (y - p) - penalty * w
        )
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def probability(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30)))


def rising(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """A logistic fit whose score falls with no column: columns of negative weight leave, the worst first, and weigh nothing."""
    left = list(range(x.shape[1]))
    while True:
        w = logistic(x[:, left], y, ridge)
        if not left or w[1:].min() >= 0:
            break
        del left[int(np.argmin(w[1:]))]
    out = np.zeros(1 + x.shape[1])
    out[[0, *(1 + i for i in left)]] = w
    return out
