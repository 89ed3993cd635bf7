"""K nearest neighbours by locality-sensitive order: an approximate top-k join without bucket overflow.

Each of ``tables`` random rotations puts the rows into the order of a code: the bits of the quantile ranks of a few random
projections, interleaved, so that rows close to each other mostly stand close in some table. A query looks at the
``window`` rows before and after its place in each table. Every block of the order has equally many rows, however the values
cluster, so no bucket can overflow and no key can become hot; equal rows are counted together beforehand. Work is
tables * 2 * window for each query; with at most 2 * window distinct rows the answer is exact.

The quantiles are those of a bounded sample of ``sample`` rows; all rows are coded and searched.

With ``exact`` every query is compared with every distinct row instead: blocks of rows and parts of the queries, both of
bounded size, meet in one cell each, and a cell gives at most ``k`` rows for a query. Work is then queries times rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightloom.errors import StepError
from brightloom.functions.runtime import materialise, ship_by_value
from brightloom.models import batches as ba

BITS, SEED = 63, 42
BLOCK_BYTES, PART_BYTES = 8 << 20, 4 << 20   # rows of a block, and queries of a part, that meet in one cell

ship_by_value(ba.__name__)
ship_by_value(__name__)


def projections(width: int, tables: int) -> np.ndarray:
    """For each table, up to eight random directions."""
    rng = np.random.default_rng(SEED)
    return rng.normal(size=(tables, width, min(8, max(2, width))))


def thresholds(sample: np.ndarray, directions: np.ndarray, levels: int) -> np.ndarray:
    """The inner quantiles of the projections of a sample, 2**levels parts for each table and direction."""
    shares = np.arange(1, 1 << levels) / (1 << levels)
    return np.stack([np.quantile(sample @ d, shares, axis=0).T for d in directions])


def codes(x: np.ndarray, directions: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A code of at most ``BITS`` bits for each row and table: the ranks' bits, highest first, over all directions in turn."""
    out = np.zeros((len(x), len(directions)), np.int64)
    levels = int(np.log2(cuts.shape[2] + 1))
    for t, d in enumerate(directions):
        projected = x @ d
        ranks = [np.searchsorted(cuts[t, j], projected[:, j], side="right") for j in range(d.shape[1])]
        for level in range(levels - 1, -1, -1):
            for r in ranks:
                out[:, t] = (out[:, t] << 1) | ((r >> level) & 1)
    return out


def _coder(schema, directions, cuts):
    def code(batches):
        for batch in batches:
            x = ba.matrix(batch["x"])
            found = codes(x, directions, cuts) if len(x) else np.zeros((0, len(directions)), np.int64)
            lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * found.shape[1], pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([batch["id"], lists], schema=schema)

    return code


def _counter(schema):
    """Rows before each row of a sorted task, queries not counted."""

    def count(batches):
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            stored = batch["query"].to_numpy(zero_copy_only=False) == 0
            seen = before + np.cumsum(stored) - stored
            before += int(stored.sum())
            yield pa.RecordBatch.from_arrays(
                [batch["table"], batch["id"], batch["query"], pa.array(np.full(len(stored), part, np.int32)), pa.array(seen)], schema=schema)

    return count


def _searcher(schema, size: int, wide: int, k: int):
    def search(batches):
        at, parts, stored = None, [], None
        for batch in batches:
            out = []
            blocks, query = batch["block"].to_numpy(), batch["query"].to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(query) != 0)) + 1
            for start, stop in zip(np.append(0, cuts).tolist(), np.append(cuts, len(blocks)).tolist()):
                if start == stop:
                    continue
                piece = batch.slice(start, stop - start)
                if blocks[start] != at:
                    at, parts, stored = blocks[start], [], None
                x, places, ids = ba.matrix(piece["x"]), piece["place"].to_numpy(), piece["id"].to_numpy()
                if not query[start]:
                    parts.append((places, x, ids, piece["label"].to_numpy(), piece["n"].to_numpy()))
                    continue
                if stored is None and parts:
                    stored = [np.concatenate(c) for c in zip(*parts)]
                    stored = [c[np.argsort(stored[0])] for c in stored]
                    parts = []
                if stored is None:
                    continue
                low = np.searchsorted(stored[0], places)
                high = np.searchsorted(stored[0], places + wide)
                for q, v, a, b in zip(ids.tolist(), x, low.tolist(), high.tolist()):
                    if a == b:
                        continue
                    d = ((stored[1][a:b] - v) ** 2).sum(1)
                    near = np.lexsort((stored[2][a:b], stored[3][a:b], d))[:k]
                    out += [(q, int(stored[2][a + i]), float(d[i]), float(stored[3][a + i]), int(stored[4][a + i])) for i in near]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)

    return search


def _nearest(stored, ids, x, k: int):
    """(query, id, squared distance, label, n) of the ``k`` rows nearest to each query; ties by label, then id.

    Products rule out what is farther for certain; the rest is measured by differences.
    """
    rows, own, labels, counts, lengths = stored
    for low in range(0, len(x), 64):
        some = x[low : low + 64]
        squares = (some**2).sum(1)
        rough = lengths[None, :] - 2 * (some @ rows.T) + squares[:, None]
        slack = 1e-14 * (rows.shape[1] + 8) * (squares + lengths.max())
        reach = np.inf if len(rows) <= k else np.partition(rough, k - 1, axis=1)[:, k - 1] + 2 * slack
        kept = ~(rough > np.broadcast_to(reach, len(some))[:, None])   # those that are no number stay
        for i, (q, v) in enumerate(zip(ids[low : low + 64].tolist(), some)):
            at = np.flatnonzero(kept[i])
            d = ((rows[at] - v) ** 2).sum(1)
            for j in np.lexsort((own[at], labels[at], d))[:k].tolist():
                yield q, int(own[at[j]]), float(d[j]), float(labels[at[j]]), int(counts[at[j]])


def _comparer(schema, k: int):
    """Over rows sorted by (cell, query): the nearest rows of a cell's block for each query of its part."""

    def compare(batches):
        at, parts, stored = None, [], None
        for batch in batches:
            out = []
            cells, query = batch["cell"].to_numpy(), batch["query"].to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(query) != 0)) + 1
            for start, stop in zip(np.append(0, cuts).tolist(), np.append(cuts, len(cells)).tolist()):
                if start == stop:
                    continue
                piece = batch.slice(start, stop - start)
                if cells[start] != at:
                    at, parts, stored = cells[start], [], None
                x, ids = ba.matrix(piece["x"]), piece["id"].to_numpy()
                if not query[start]:
                    parts.append((x, ids, piece["label"].to_numpy(), piece["n"].to_numpy()))
                    continue
                if stored is None and parts:
                    stored = [np.concatenate(c) for c in zip(*parts)]
                    stored.append((stored[0] ** 2).sum(1))
                    parts = []
                if stored is not None:
                    out += _nearest(stored, ids, x, k)
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)

    return compare


class _Settings(Params):
    def __init__(self):
        super().__init__()
        whole, text = TypeConverters.toInt, TypeConverters.toString
        self.k = Param(self, "k", "neighbours that vote", whole)
        self.weights = Param(self, "weights", "uniform or distance", text)
        self.tables = Param(self, "tables", "random orders", whole)
        self.window = Param(self, "window", "rows looked at on each side in each order", whole)
        self.sample = Param(self, "sample", "rows whose quantiles shape the codes", whole)
        self.exact = Param(self, "exact", "compare each query with all rows", TypeConverters.toBoolean)
        self._setDefault(k=5, weights="uniform", tables=8, window=96, sample=8192, exact=False)


class Neighbours(Estimator, _Settings):
    """Keeps the training rows (``features``, ``label``), equal ones together, with their codes."""

    def __init__(self, **settings):
        super().__init__()
        self._set(**settings)

    def _fit(self, df: DataFrame) -> NeighboursModel:
        rows = df.select(ba.dense(df, "features"), F.col("label").cast("double").alias("label")).where("x is not null and label is not null")
        rows = rows.groupBy("x", "label").agg(F.count("*").alias("n"))
        rows = materialise(rows.select(F.monotonically_increasing_id().alias("id"), "*"), "neighbours")
        taken = rows.select("x", F.xxhash64("x").alias("h")).orderBy("h").limit(self.getOrDefault(self.sample)).select("x").toArrow()
        if not taken.num_rows:
            raise StepError("train", "there are no rows to learn from")
        sample = ba.matrix(taken["x"].combine_chunks())
        directions = projections(sample.shape[1], self.getOrDefault(self.tables))
        model = NeighboursModel(rows, rows.count(), directions, thresholds(sample, directions, min(8, BITS // directions.shape[2])))
        return model._set(**{p.name: self.getOrDefault(p) for p in self.params})


class NeighboursModel(Model, _Settings):
    def __init__(self, rows: DataFrame, n: int, directions: np.ndarray, cuts: np.ndarray):
        super().__init__()
        self.rows, self.n, self.directions, self.cuts = rows, n, directions, cuts

    def _coded(self, rows: DataFrame) -> DataFrame:
        ddl = "id long, codes array<bigint>"
        coded = rows.select("id", "x").mapInArrow(_coder(ba.arrow_schema(rows.sparkSession, ddl), self.directions, self.cuts), ddl)
        return coded.select("id", F.posexplode("codes").alias("table", "code"))

    def neighbours(self, queries: DataFrame) -> DataFrame:
        """(query, id, distance, label, n): for each query (id, x), the nearest rows found, at least ``k`` if there are any."""
        if self.getOrDefault(self.exact):
            return self._compared(queries)
        spark, k = queries.sparkSession, self.getOrDefault(self.k)
        wide = 2 * self.getOrDefault(self.window)
        both = self._coded(self.rows).withColumn("query", F.lit(0)).unionByName(self._coded(queries).withColumn("query", F.lit(1)))
        ordered = both.orderBy("table", "code", F.xxhash64("id", "query")).select("table", "id", "query")
        ddl = "table int, id long, query int, part int, seen long"
        counted = materialise(ordered.mapInArrow(_counter(ba.arrow_schema(spark, ddl)), ddl), "order")
        sizes = counted.groupBy("part").agg(F.sum(1 - F.col("query")).alias("n")).orderBy("part").collect()  # a row for each task
        starts, total = [], 0
        for r in sizes:
            starts.append((r["part"], total))
            total += r["n"]
        starts = spark.createDataFrame(starts, "part int, start long")
        placed = counted.join(F.broadcast(starts), "part").withColumn("place", F.col("seen") + F.col("start"))

        width = max(1, self.directions.shape[1])
        size = max(2 * wide, min(4096, (32 << 20) // (8 * width)))
        first, last = F.col("table") * self.n, (F.col("table") + 1) * self.n - wide
        window = F.greatest(first, F.least(F.col("place") - wide // 2, last))
        stored = placed.where("query = 0").select("id", "place", F.floor(F.col("place") / size).alias("block"), F.lit(0).alias("query"))
        asked = placed.where("query = 1").withColumn("place", window)
        blocks = F.sequence(F.floor(F.col("place") / size), F.floor((F.col("place") + wide - 1) / size))
        asked = asked.select("id", "place", F.explode(blocks).alias("block"), F.lit(1).alias("query"))
        stored = stored.join(self.rows, "id")
        asked = asked.join(queries.select("id", "x"), "id").withColumns({"label": F.lit(None).cast("double"), "n": F.lit(None).cast("long")})
        cells = stored.unionByName(asked).repartition("block").sortWithinPartitions("block", "query")
        ddl = "query long, id long, distance double, label double, n long"
        found = cells.mapInArrow(_searcher(ba.arrow_schema(spark, ddl), size, wide, k), ddl)
        return found.groupBy("query", "id").agg(F.min("distance").alias("distance"), F.min("label").alias("label"), F.min("n").alias("n"))

    def _compared(self, queries: DataFrame) -> DataFrame:
        """As ``neighbours``, by comparison with all rows: the nearest of each block."""
        spark, width = queries.sparkSession, max(1, self.directions.shape[1])
        blocks = max(1, -(-self.n * 8 * width // BLOCK_BYTES))
        parts = max(1, -(-queries.count() * 8 * width // PART_BYTES))
        block, part = (F.pmod(F.xxhash64("id"), F.lit(n)) for n in (blocks, parts))
        stored = self.rows.select("id", "x", "label", "n", F.lit(0).alias("query"), F.explode(
            F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: block * parts + i)).alias("cell"))
        asked = queries.select("id", "x", F.lit(None).cast("double").alias("label"), F.lit(None).cast("long").alias("n"), F.lit(1).alias("query"), F.explode(
            F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: i * parts + part)).alias("cell"))
        cells = stored.unionByName(asked).repartition(blocks * parts, "cell").sortWithinPartitions("cell", "query")
        ddl = "query long, id long, distance double, label double, n long"
        return cells.mapInArrow(_comparer(ba.arrow_schema(spark, ddl), self.getOrDefault(self.k)), ddl)

    def _transform(self, df: DataFrame) -> DataFrame:
        k, weights = self.getOrDefault(self.k), self.getOrDefault(self.weights)
        asked = materialise(df.withColumn("_query", F.monotonically_increasing_id()), "asked")
        near = self.neighbours(asked.select(F.col("_query").alias("id"), ba.dense(asked, "features")).where("x is not null"))
        order = Window.partitionBy("query").orderBy("distance", "label", "id")
        before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        votes = near.withColumn("votes", F.least(F.col("n"), k - before)).withColumn("least", F.min("distance").over(Window.partitionBy("query"))).where("votes > 0")
        if weights == "distance":
            exact = F.when(F.col("distance") == 0, F.col("votes")).otherwise(0)
            votes = votes.withColumn("votes", F.when(F.col("least") == 0, exact).otherwise(F.col("votes") / F.sqrt(F.greatest("distance", F.lit(1e-300)))))
        sums = votes.groupBy("query", "label").agg(F.sum("votes").alias("votes"))
        said = sums.groupBy("query").agg(F.min(F.struct(-F.col("votes"), F.col("label").alias("label")))["label"].alias("prediction"))
        return asked.join(said, asked["_query"] == said["query"], "left").drop("_query", "query")
