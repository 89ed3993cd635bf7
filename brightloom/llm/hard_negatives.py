"""Hard negatives by rotated one-bit codes whose intervals bound every inner product.

Each vector becomes whole numbers, floor(scale * x), which a fixed random rotation turns into a unit vector u. Stored are the
signs of u as a bit code, and its alignment a = <u, c> with the code vector c (entries +-1/sqrt(dims)). For an anchor's
unit vector q, u = a c + r with r orthogonal to c and |r| = sqrt(1 - a^2), so by Cauchy-Schwarz

    <u, q> = a <c, q> + <r, q>   lies within   a s +- sqrt(1 - a^2) sqrt(1 - s^2),   s = <c, q>.

s comes from popcounts of the code with four bit planes of q; what the planes leave out of q bounds the error of s. Only rows
whose interval reaches into what an anchor still looks for are scored in whole numbers, so the result is exact.

Rows are dealt to blocks of bounded bytes; a task holds one block and lets all anchors stream past it, each with the best
rows found so far in the block, and the blocks' best are merged. The first pass finds an anchor's positives, the second
the negatives within the window that each positive's score opens.

Defined cases: rows with a NULL vec_id, label or vector, a NULL or non-finite component, or a vector whose whole numbers
have a squared length of 2**62 or more take no part; a shorter vector counts as filled up with zeros, an empty one as
zeros; rows of an anchor's own vec_id are not its positives, otherwise a repeated row counts as often as it stands there;
ties go by vec_id; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brightloom.functions.runtime import materialise, ship_by_value

BLOCK_BYTES, LEAST_ROWS, SEED = 64 << 20, 4096, 20
CHUNK, TILE = 64, 4096
ROWS = "row long, vec_id long, label long, vector binary, norm double, code binary, align double"
FOUND = "row long, goal long, other_id long, score long"
LOW = np.iinfo(np.int64).min

ship_by_value(__name__)


def padded(dims: int) -> int:
    return max(64, 1 << max(0, dims - 1).bit_length())


def rotate(x: np.ndarray) -> np.ndarray:
    """Rows of a power of two of entries, rotated by three rounds of fixed signs and a Hadamard transform."""
    n, size = x.shape
    signs = np.random.default_rng(SEED).integers(0, 2, (3, size)) * 2.0 - 1
    for s in signs:
        x = x * s
        step = 1
        while step < size:
            pairs = x.reshape(n, size // (2 * step), 2, step)
            x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(n, size)
            step *= 2
        x = x / np.sqrt(size)
    return x


def unit(vectors: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """The rotated directions of whole-number vectors."""
    wide = np.zeros((len(vectors), padded(vectors.shape[1])))
    wide[:, : vectors.shape[1]] = vectors / np.where(norms > 0, norms, 1)[:, None]
    return rotate(wide)


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length, code words and alignment of each vector."""
    norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
    u = unit(vectors, norms)
    codes = np.packbits(u > 0, axis=1, bitorder="little").view("<u8")
    align = np.where(norms > 0, np.abs(u).sum(1) / np.sqrt(u.shape[1]), 1.0)
    return norms, codes, align


class Query:
    """Anchors with their bit planes."""

    def __init__(self, vectors: np.ndarray, planes: int = 4):
        self.vectors = vectors
        self.norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        q = unit(vectors, self.norms)
        self.root, top = np.sqrt(q.shape[1]), (1 << planes) - 1
        self.low = q.min(1)
        self.step = (q.max(1) - self.low) / top
        level = np.rint((q - self.low[:, None]) / np.where(self.step > 0, self.step, 1)[:, None]).astype(np.int64)
        kept = self.low[:, None] + self.step[:, None] * level
        self.total, self.error = kept.sum(1), np.abs(q - kept).sum(1) / self.root
        self.planes = [np.packbits((level >> p) & 1, axis=1, bitorder="little").view("<u8") for p in range(planes)]

    def bounds(self, norms, codes, align) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor and row, whole numbers that the inner product is not below and not above."""
        ones = np.bitwise_count(codes).sum(1)
        levels = np.zeros((len(self.norms), len(codes)))
        for p, plane in enumerate(self.planes):
            for w in range(codes.shape[1]):
                levels += np.bitwise_count(plane[:, w, None] & codes[None, :, w]) * float(1 << p)
        s = (2 * (self.low[:, None] * ones + self.step[:, None] * levels) - self.total[:, None]) / self.root
        error = self.error[:, None]
        free = np.sqrt(1 - np.clip(np.abs(s) - error, 0, 1) ** 2) * np.sqrt(np.clip(1 - align**2, 0, 1))
        size = self.norms[:, None] * norms
        reach = (free + align * error + 1e-6) * size
        middle = align * s * size
        return np.floor(middle - reach), np.ceil(middle + reach)

    def scores(self, vectors: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Exact inner products; the lengths' product bounds each partial sum and so says which type is exact."""
        most = self.norms.max(initial=0) * norms.max(initial=0)
        kind = np.float32 if most < 2**23 else np.float64 if most < 2**52 else np.int64
        return (self.vectors.astype(kind) @ vectors.astype(kind).T).astype(np.int64)


class Best:
    """The ``k`` best (score, id) of each of ``n`` goals so far."""

    def __init__(self, n: int, k: int):
        self.k, self.n = k, n
        self.goal, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.floor = np.full(n, LOW)

    def add(self, goal: np.ndarray, score: np.ndarray, ids: np.ndarray):
        if not len(goal):
            return
        goal, score, ids = (np.concatenate(x) for x in ((self.goal, goal), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, goal))
        goal, score, ids = goal[order], score[order], ids[order]
        rank = np.arange(len(goal)) - np.searchsorted(goal, goal)
        last = rank == self.k - 1
        self.floor[goal[last]] = score[last]
        kept = rank < self.k
        self.goal, self.score, self.id = goal[kept], score[kept], ids[kept]


class Block:
    """The rows of a block, by label and vec_id."""

    def __init__(self, table: pa.Table):
        col = lambda c: table[c].to_numpy()
        order = np.lexsort((col("vec_id"), col("label")))
        self.ids, self.labels, self.norms, self.align = (col(c)[order] for c in ("vec_id", "label", "norm", "align"))
        self.vectors = _matrix(table["vector"], "<i4")[order]
        self.codes = _matrix(table["code"], "<u8")[order]

    def tiles(self, start: int, stop: int):
        for at in range(start, stop, TILE):
            yield slice(at, min(stop, at + TILE))

    def reach(self, query: Query, tile: slice, least: np.ndarray, most: np.ndarray | None = None):
        """Rows of the tile that some anchor may want, and the scores where an anchor may (else LOW)."""
        low, high = query.bounds(self.norms[tile], self.codes[tile], self.align[tile])
        open_ = high >= least[:, None]
        if most is not None:
            open_ &= low <= most[:, None]
        some = np.flatnonzero(open_.any(0))
        rows = some + tile.start
        scores = query.scores(self.vectors[rows], self.norms[rows])
        return rows, np.where(open_[:, some], scores, LOW)

    def positives(self, rows, ids, labels, vectors, k: int):
        """The best rows of the same label for anchors that share it."""
        query, best = Query(vectors), Best(len(rows), k)
        start, stop = np.searchsorted(self.labels, [labels[0], labels[0] + 1])
        for tile in self.tiles(int(start), int(stop)):
            at, scores = self.reach(query, tile, best.floor)
            scores = np.where(self.ids[at] == ids[:, None], LOW, scores)
            _keep(best, np.arange(len(rows)), scores, best.floor, self.ids[at], k)
        yield rows[best.goal], np.zeros(len(best.goal), np.int64), best.id, best.score

    def negatives(self, rows, labels, vectors, goals: list[list[int]], window, k: int):
        """For each anchor and goal (a positive's score), the best rows of other labels in the goal's window."""
        query = Query(vectors)
        spans = [[window(g) for g in own] for own in goals]
        width = max(map(len, goals))
        floors = np.array([[s[i][0] if i < len(s) else -LOW - 1 for i in range(width)] for s in spans])
        tops = np.array([[s[i][1] if i < len(s) else LOW + 1 for i in range(width)] for s in spans])
        best = [Best(len(rows), k) for _ in range(width)]
        for tile in self.tiles(0, len(self.ids)):
            wanted = np.stack([np.maximum(floors[:, i], best[i].floor) for i in range(width)], 1)
            at, scores = self.reach(query, tile, wanted.min(1), tops.max(1))
            scores = np.where(self.labels[at] == labels[:, None], LOW, scores)
            for i in range(width):
                inside = np.where(scores <= tops[:, i, None], scores, LOW)
                _keep(best[i], np.arange(len(rows)), inside, wanted[:, i], self.ids[at], k)
        for i in range(width):
            goal = np.array([own[i] if i < len(own) else 0 for own in goals], np.int64)
            yield rows[best[i].goal], goal[best[i].goal], best[i].id, best[i].score


def _keep(best: Best, goals: np.ndarray, scores: np.ndarray, least: np.ndarray, ids: np.ndarray, k: int):
    """Add the scores of at least ``least``, or of at least the k-th best if those are many."""
    inside = scores >= np.maximum(least, LOW + 1)[:, None]
    if inside.sum() > 8 * k * len(goals) and scores.shape[1] > k:
        kth = np.partition(np.where(inside, scores, LOW), -k, axis=1)[:, -k]
        inside &= scores >= kth[:, None]
    i, j = np.nonzero(inside)
    best.add(goals[i], scores[i, j], ids[j])


def _matrix(column, kind: str) -> np.ndarray:
    """The rows of a column of equally long byte strings."""
    values = column.to_pylist() if len(column) else []
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


def _encoder(schema, dims: int, scale: int):
    def encode_(batches):
        for batch in batches:
            lists = batch["vector"]
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            x = np.zeros((len(lists), max(dims, 1)))
            at = np.repeat(np.arange(len(lists)), sizes)
            x[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.floor(scale * flat.astype(np.float64))
            with np.errstate(over="ignore"):
                whole = (x**2).sum(1) < 2.0**62
            x = x[whole].astype("<i4")
            norms, codes, align = encode(x)
            kept = batch.filter(pa.array(whole))
            yield pa.RecordBatch.from_arrays([
                kept["row"], kept["vec_id"], kept["label"], pa.array([r.tobytes() for r in x], pa.binary()), pa.array(norms),
                pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(align)], schema=schema)

    return encode_


def _searcher(schema, k: int, window):
    """Blocks of rows (goals NULL), each followed by the anchors, by label; goals are empty in the first pass."""

    def search(batches):
        block, parts, at = None, [], None

        def answers(table):
            for start in range(0, table.num_rows, CHUNK):
                some = table.slice(start, CHUNK)
                rows, ids, labels = (some[c].to_numpy() for c in ("row", "vec_id", "label"))
                vectors, goals = _matrix(some["vector"], "<i4"), some["goals"].to_pylist()
                if window:
                    found = block.negatives(rows, labels, vectors, goals, window, k)
                else:
                    same = np.split(np.arange(len(rows)), np.flatnonzero(np.diff(labels)) + 1)
                    found = (x for s in same for x in block.positives(rows[s], ids[s], labels[s], vectors[s], k))
                for arrays in found:
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], schema=schema)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            numbers = table["block"].to_numpy()
            for piece in np.split(np.arange(len(numbers)), np.flatnonzero(np.diff(numbers)) + 1):
                own = table.slice(int(piece[0]), len(piece)) if len(piece) else None
                if own is None:
                    continue
                if numbers[piece[0]] != at:
                    block, parts, at = None, [], numbers[piece[0]]
                anchor = own["goals"].is_valid().to_numpy()
                if not anchor.all():
                    parts.append(own.filter(pa.array(~anchor)))
                if anchor.any() and parts:
                    block, parts = Block(pa.concat_tables(parts)), []
                if anchor.any() and block:
                    yield from answers(own.filter(pa.array(anchor)))

    return search


def _schema(spark, ddl):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def _searched(rows: DataFrame, anchors: DataFrame, blocks: int, k: int, window) -> DataFrame:
    """What each block finds for each anchor: row (the anchor's), goal, other_id, score."""
    stored = rows.withColumn("goals", F.lit(None).cast("array<bigint>")).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    asked = anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cells = stored.unionByName(asked).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", F.col("goals").isNotNull(), "label")
    return cells.mapInArrow(_searcher(_schema(rows.sparkSession, FOUND), k, window), FOUND)


def window_of(low: int, high: int):
    """From a positive's score, the least and greatest score of its negatives, in per cent."""
    return lambda score: (-((-low * score) // 100), (high * score) // 100)


def mine(embeddings: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         scale: int = 256, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``embeddings``: vec_id, label, embedding. Rows for which ``anchor`` holds are anchors. An anchor's positives are the
    ``positives`` best rows of its label; for each, the ``negatives`` best rows of other labels whose score is at least ``low``
    and at most ``high`` per cent of the positive's.
    """
    spark = embeddings.sparkSession
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    vector = F.col("embedding").cast("array<double>")
    plain = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector.alias("vector"))
    plain = plain.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", finite))
    dims = plain.agg(F.max(F.size("vector"))).first()[0]
    if dims is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    plain = plain.select(F.monotonically_increasing_id().alias("row"), "*")
    rows = materialise(plain.mapInArrow(_encoder(_schema(spark, ROWS), dims, scale), ROWS), "codes")
    n = rows.count()
    bytes_ = n * (4 * dims + padded(dims) // 8 + 64)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(-(-bytes_ // block_bytes), min(tasks, -(-n // LEAST_ROWS)), 1)

    anchors = rows.where(anchor)
    found = _searched(rows, anchors.withColumn("goals", F.array().cast("array<bigint>")), blocks, positives, None)
    best = Window.partitionBy("row").orderBy(F.desc("score"), "other_id")
    found = found.withColumn("k", F.row_number().over(best)).where(F.col("k") <= positives)
    chosen = materialise(found.select("row", F.col("other_id").alias("positive_id"), F.col("score").alias("goal")), "positives")

    goals = chosen.groupBy("row").agg(F.sort_array(F.collect_set("goal")).alias("goals"))
    found = _searched(rows, anchors.join(goals, "row"), blocks, negatives, window_of(low, high))
    best = Window.partitionBy("row", "goal").orderBy(F.desc("score"), "other_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    ids = anchors.select("row", F.col("vec_id").alias("anchor_id"))
    return chosen.join(found, ["row", "goal"]).join(ids, "row").select(
        "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), F.col("goal").alias("positive_score"), F.col("score").alias("negative_score"))
