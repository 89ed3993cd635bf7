"""Feature vectors in Arrow batches."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dense(df: DataFrame, features: str, name: str = "x") -> Column:
    """A vector or array column as array<double>."""
    kind = df.schema[features].dataType.typeName()
    return (F.col(features).cast("array<double>") if kind == "array" else vector_to_array(features)).alias(name)


def matrix(column) -> np.ndarray:
    """The rows of an Arrow list column of equally long lists."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def arrow_schema(spark, ddl: str):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def width_of(df: DataFrame, features: str) -> int:
    row = df.select(dense(df, features)).where("x is not null").first()
    return len(row["x"]) if row else 0


class Rows:
    """A batch of vectors as Arrow gives them, dense ones and sparse ones apart."""

    def __init__(self, column):
        kinds = np.array(column.field("type").to_numpy(zero_copy_only=False))
        self.n = len(kinds)
        self.dense_rows = np.flatnonzero(kinds == 1)
        values, indices = column.field("values"), column.field("indices")
        self.dense = matrix(values.take(_places(self.dense_rows))) if len(self.dense_rows) else None
        sparse = np.flatnonzero(kinds == 0)
        picked = indices.take(_places(sparse))
        sizes = np.diff(picked.offsets.to_numpy())
        self.row = np.repeat(sparse, sizes)
        self.index = picked.flatten().to_numpy(zero_copy_only=False)
        self.value = values.take(_places(sparse)).flatten().to_numpy(zero_copy_only=False)

    def times(self, m: np.ndarray) -> np.ndarray:
        """rows @ m."""
        out = np.zeros((self.n, m.shape[1]))
        if self.dense is not None:
            out[self.dense_rows] = self.dense @ m
        for j in range(m.shape[1]):
            if len(self.row):
                out[:, j] += np.bincount(self.row, self.value * m[self.index, j], self.n)
        return out

    def gathered(self, z: np.ndarray, width: int) -> np.ndarray:
        """rows.T @ z."""
        out = self.dense.T @ z[self.dense_rows] if self.dense is not None else np.zeros((width, z.shape[1]))
        for j in range(z.shape[1]):
            if len(self.row):
                out[:, j] += np.bincount(self.index, self.value * z[self.row, j], width)
        return out


def _places(rows: np.ndarray):
    import pyarrow as pa

    return pa.array(rows, pa.int64())
