"""Sharding: a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

The ring is cut into ``cells`` equal arcs. A row's place is the cell of ``xxhash64(doc_id)``; every shard owns
``vnodes`` points. Going clockwise, a point takes the rows of the arc before it, after those handed on to it, until its
shard is full; the rest go on clockwise. Capacities differ by one row at most, so the law is ``rows``.

Only the ``cells`` row counts come to the driver. Rows of a cell are numbered in ``lanes`` parts, so one key that
holds a third of all rows is numbered by many tasks. Places are frozen in a written table first, so that a lost
executor cannot renumber rows.
"""

from __future__ import annotations

import json

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brightloom.functions.runtime import materialise

CELLS, LANES, VNODES = 4096, 32, 64


def ring_points(shards: int, vnodes: int = VNODES, cells: int = CELLS) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise. Adding a shard only adds points."""
    return sorted(
        (xxhash.xxh64_intdigest(f"{shard}/{v}") % cells, shard) for shard in range(shards) for v in range(vnodes)
    )


def spread(counts: list[int], points: list[tuple[int, int]], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Intervals (cell, first rank, end rank, shard, slot of the first) that place every row of every cell.

    A point at cell ``c`` takes what was handed on, oldest first, then the rows of the cells up to ``c``.
    """
    filled, out, waiting = [0] * len(capacity), [], []
    at = 0

    def take(shard):
        while waiting and filled[shard] < capacity[shard]:
            cell, low, high = waiting[0]
            n = min(high - low, capacity[shard] - filled[shard])
            out.append((cell, low, low + n, shard, filled[shard]))
            filled[shard] += n
            if low + n == high:
                waiting.pop(0)
            else:
                waiting[0] = (cell, low + n, high)

    for cell, shard in points:
        while at <= cell:
            if counts[at]:
                waiting.append((at, 0, counts[at]))
            at += 1
        take(shard)
    waiting.extend((c, 0, counts[c]) for c in range(at, len(counts)) if counts[c])
    for _, shard in points:  # past the last point the ring goes on at the first
        take(shard)
    return out


def assign(docs: DataFrame, shards: int = 24, vnodes: int = VNODES, cells: int = CELLS, lanes: int = LANES) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes (NULL: none) plus 8; the ``text_crc32`` of a NULL text is 0. A NULL doc_id is a
    key like any other; equal keys share a cell and go to the same shard until it is full. Repeated rows are placed one
    by one. Other columns are ignored, an empty table gives an empty result. ``grown_shard`` is NULL, as the law is
    ``rows``: the shard of a row depends on the loads, too.
    """
    placed = materialise(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"),
            F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
            F.pmod(F.xxhash64("doc_id"), F.lit(cells)).cast("int").alias("cell"),
            F.pmod(F.monotonically_increasing_id(), F.lit(lanes)).cast("int").alias("lane"),
        ), "ring",
    )
    parts = placed.groupBy("cell", "lane").agg(F.count("*").alias("n"))
    base = parts.withColumn(
        "base", F.sum("n").over(Window.partitionBy("cell").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1))
    ).select("cell", "lane", F.coalesce("base", F.lit(0)).alias("base"))

    counts = [0] * cells
    for cell, n in parts.groupBy("cell").agg(F.sum("n")).collect():  # at most `cells` rows
        counts[cell] = n
    least, more = divmod(sum(counts), shards)
    capacity = [least + (s < more) for s in range(shards)]
    plan = docs.sparkSession.range(1).select(F.inline(F.from_json(
        F.lit(json.dumps([dict(zip(("cell", "low", "high", "shard", "slot"), p)) for p in
                          spread(counts, ring_points(shards, vnodes, cells), capacity)])),
        "array<struct<cell:int,low:bigint,high:bigint,shard:int,slot:bigint>>",
    )))

    # Both small tables are bounded: cells * lanes rows, and cells + 2 * shards * vnodes rows.
    numbered = placed.withColumn(
        "rank", F.row_number().over(Window.partitionBy("cell", "lane").orderBy("doc_id", "text_crc32", "size")) - 1
    ).join(F.broadcast(base), ["cell", "lane"]).withColumn("rank", F.col("rank") + F.col("base"))
    return numbered.join(
        F.broadcast(plan), (numbered["cell"] == plan["cell"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    ).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("slot") + F.col("rank") - F.col("low")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
