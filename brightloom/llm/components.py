"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.functions.runtime import materialise


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every end of ``edges`` (a, b); component is the smallest id of its own.

    Each round every node joins the neighbour, or itself, that has the least hash of the round; edges between joined
    nodes vanish and the rest are relabelled, so that a chain shrinks by a constant share whatever its ids. Each round's
    tables are written to the shared folder. Loops and repeated edges are fine; NULL ends are left out.
    """
    links = edges.where("a is not null and b is not null").select(
        F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"))
    nodes = links.select(F.col("a").alias("id")).union(links.select("b"))
    labels = materialise(nodes.distinct().select("id", F.col("id").alias("at")), "labels")
    links = materialise(links.where("a <> b").distinct(), "links")
    turn = 0
    while not links.isEmpty():
        turn += 1
        rank = lambda c: F.xxhash64(F.lit(turn), c)
        both = links.select("a", "b").union(links.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min(F.struct(rank(F.col("b")).alias("r"), F.col("b").alias("to"))).alias("m"))
        own = F.struct(rank(F.col("a")).alias("r"), F.col("a").alias("to"))
        joined = materialise(least.select(F.col("a").alias("node"), F.least(F.col("m"), own)["to"].alias("to")), "joined")
        labels = materialise(
            labels.join(joined, labels["at"] == joined["node"], "left").select("id", F.coalesce("to", "at").alias("at")), "labels")
        a = joined.select(F.col("node").alias("a"), F.col("to").alias("x"))
        b = joined.select(F.col("node").alias("b"), F.col("to").alias("y"))
        links = materialise(links.join(a, "a").join(b, "b").where("x <> y").select(
            F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    least = labels.groupBy("at").agg(F.min("id").alias("component"))
    return labels.join(least, "at").select("id", "component")
