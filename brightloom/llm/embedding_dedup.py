"""Embedding near-dedup by a small-world graph for each shard; each two shards search each other's graph in one task.

Equal vectors are one class; classes are dealt to shards by hash, so that near copies spread over them. A shard's graph is
searched with a beam that widens until an audit passes: vectors in random order are compared with the whole shard until
``AUDIT`` of them have links there, but few enough for a beam, and of the links of a vector, ``RECALL`` must be found on
average, both over these and over those with more links. Where too few vectors have links, all have been compared by then
and nothing is left to search. A vector whose whole beam qualifies is compared with the whole shard. Similarities are
verified in double precision, so no link is below the threshold; a link found from either end counts for both.

Components are made in each shard first; links between two shards then join the components of their ends, which keeps
them whole without a row for every pair. Numbers of links count all pairs found.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.functions.runtime import materialise, ship_by_value
from brightloom.llm import hnsw
from brightloom.llm.components import components
from brightloom.llm.hnsw import Graph

ship_by_value(hnsw.__name__)
ship_by_value(__name__)

LEAST_SHARDS, SHARD_ROWS, SLICE_ROWS = 8, 50_000, 20_000
BEAM, AUDIT, RECALL = 32, 48, 0.99
INDEX = "dim int, shard int, graph binary, cids binary, raw binary, weights binary, local binary, inner binary"
FOUND = "cid bigint, n bigint, other bigint"


class Shard:
    def __init__(self, graph, cids, exact, weights, local=None):
        self.graph, self.cids, self.exact, self.weights, self.local = graph, cids, exact, weights, local

    def links(self, cids: np.ndarray, queries: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, bool]:
        """(row of the query, place in the shard) of every link found, without that of a vector to itself; whether all were compared.

        ``SLICE_ROWS`` queries are audited and searched at a time.
        """
        rows, places, whole = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], True
        for low in range(0, len(queries), SLICE_ROWS):
            a, b, all_of_it = self._audited(cids[low : low + SLICE_ROWS], queries[low : low + SLICE_ROWS], least)
            rows.append(a + low)
            places.append(b)
            whole &= all_of_it
        return np.concatenate(rows), np.concatenate(places), whole

    def _audited(self, cids, queries, least):
        n, beam, audited, few = len(self.cids), BEAM, 0, 0
        order = np.random.default_rng(len(queries)).permutation(len(queries))
        rows, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while audited < len(order) and (few < AUDIT or beam >= n):
            part = order[audited : audited + 256]
            a, b = self._compare(cids[part], queries[part], least)
            rows.append(part[a])
            places.append(b)
            audited += len(part)
            sizes = np.bincount(a, minlength=len(part))
            few += ((sizes > 0) & (sizes <= BEAM)).sum()
        if audited < len(order):
            true = np.bincount(np.concatenate(rows), minlength=len(order))
            linked, rest = np.flatnonzero(true), order[audited:]
            while beam < n:
                a, _ = self._search(cids[linked], queries[linked], beam, least)
                share = np.bincount(a, minlength=len(linked)) / true[linked]
                kinds = [share[true[linked] <= BEAM], share[true[linked] > BEAM]]
                if all(k.mean() >= RECALL for k in kinds if len(k)):
                    break
                beam *= 2
            a, b = self._search(cids[rest], queries[rest], min(n, beam), least)
            rows.append(rest[a])
            places.append(b)
        return np.concatenate(rows), np.concatenate(places), audited == len(order) or beam >= n

    def _compare(self, cids, queries, least):
        """Links by comparison with all of the shard: what single precision cannot rule out is verified."""
        r, c = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for low in range(0, len(queries), 256):
            near = np.ascontiguousarray(queries[low : low + 256], np.float32) @ self.graph.vectors.T
            a, b = np.nonzero(near >= least - max(1e-4, 1e-6 * queries.shape[1]))
            r.append(a + low)
            c.append(b)
        r, c = np.concatenate(r), np.concatenate(c)
        good = np.zeros(len(r), bool)
        for low in range(0, len(r), 65_536):
            part = slice(low, low + 65_536)
            good[part] = np.einsum("pd,pd->p", queries[r[part]], self.exact[c[part]]) >= least
        good &= self.cids[c] != cids[r]
        return r[good], c[good]

    def _search(self, cids, queries, beam, least):
        if beam >= len(self.cids):
            return self._compare(cids, queries, least)
        ids, sims = self.graph.search(queries, beam)
        full = (ids >= 0).all(1) & (sims[:, -1] >= least - 1e-4)  # there may be more
        rows, places = [], []
        for low in range(0, len(queries), 256):
            some = np.arange(low, min(low + 256, len(queries)))
            few, many = some[~full[some]], some[full[some]]
            for todo, (a, b) in ((few, self._pairs(cids[few], queries[few], ids[few], least)), (many, self._compare(cids[many], queries[many], least))):
                rows.append(todo[a])
                places.append(b)
        return np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *places])

    def _pairs(self, cids, queries, ids, least):
        """Links among the ids of each query's beam."""
        sims = np.where(ids >= 0, np.einsum("qd,qed->qe", queries, self.exact[ids]), -2)
        r, c = np.nonzero(sims >= least)
        p = ids[r, c]
        other = self.cids[p] != cids[r]
        return r[other], p[other]


def _unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors / np.abs(vectors).max(1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    at = np.arange(n)
    while True:
        least = at.copy()
        np.minimum.at(least, a, at[b])
        np.minimum.at(least, b, at[a])
        np.minimum.at(least, at, least.copy())
        least = least[least]
        if (least == at).all():
            return at
        at = least


def _build(least):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid")
        cids, raw = pdf["cid"].to_numpy(np.int64), np.stack(pdf["embedding"])
        exact, weights = _unit(raw.astype(np.float64)), pdf["n"].to_numpy(np.int64)
        shard = Shard(Graph(exact), cids, exact, weights)
        a, b, _ = shard.links(cids, exact, least)
        a, b = _both_ends(a, b, b, a, len(cids))
        inner = np.bincount(a, weights=weights[b], minlength=len(cids)).astype(np.int64)
        return pd.DataFrame([{
            "dim": exact.shape[1], "shard": int(pdf["shard"].iloc[0]), "graph": shard.graph.to_bytes(False), "cids": cids.tobytes(),
            "raw": raw.tobytes(), "weights": weights.tobytes(), "local": cids[_components(len(cids), a, b)].tobytes(), "inner": inner.tobytes(),
        }])

    return build


def _both_ends(a, b, c, d, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that are among (a, b) or among (c, d), once; ``n`` is more than any b or d."""
    keys = np.unique(np.concatenate([a * np.int64(n) + b, c * np.int64(n) + d]))
    return keys // max(n, 1), keys % max(n, 1)


def _shard(row) -> Shard:
    cids, weights, local = (np.frombuffer(row[c], np.int64) for c in ("cids", "weights", "local"))
    parts = len(cids) * int(row["dim"])
    raw = np.frombuffer(row["raw"], np.float32 if len(row["raw"]) == 4 * parts else np.float64)
    exact = _unit(raw.astype(np.float64).reshape(len(cids), -1))
    return Shard(Graph.from_bytes(row["graph"], exact), cids, exact, weights, local)


def _within(batches):
    """What the shards have found in themselves: numbers of links, and each vector's component there."""
    for pdf in batches:
        for _, row in pdf.iterrows():
            cids, local, inner = (np.frombuffer(row[c], np.int64) for c in ("cids", "local", "inner"))
            some = inner > 0
            yield pd.DataFrame({"cid": cids[some], "n": inner[some], "other": local[some]})


def _between(least):
    def between(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"cid": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "other": np.zeros(0, np.int64)})
        return _cross(_shard(left.iloc[0]), _shard(right.iloc[0]), least)

    return between


def _cross(one: Shard, two: Shard, least: float) -> pd.DataFrame:
    """Numbers of links of both shards' vectors into the other shard, and the components that these links join."""
    b, a, whole = one.links(two.cids, two.exact, least)
    c, d = (a, b) if whole else two.links(one.cids, one.exact, least)[:2]
    a, b = _both_ends(a, b, c, d, len(two.cids))
    ones, twos = (np.bincount(x, weights=w, minlength=len(s.cids)).astype(np.int64)
                  for x, w, s in ((a, two.weights[b], one), (b, one.weights[a], two)))
    met = np.unique(np.column_stack([one.local[a], two.local[b]]), axis=0).reshape(-1, 2)
    return pd.concat([
        pd.DataFrame({"cid": one.cids[ones > 0], "n": ones[ones > 0], "other": one.cids[ones > 0]}),
        pd.DataFrame({"cid": two.cids[twos > 0], "n": twos[twos > 0], "other": two.cids[twos > 0]}),
        pd.DataFrame({"cid": met[:, 0], "n": 0, "other": met[:, 1]}),
    ], ignore_index=True)


def near_duplicates(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """Per row of ``vectors``: vec_id, n_links, component_id, kept.

    A vector that is NULL, empty or zero or holds NULL or non-finite parts links with nothing; vectors of different
    lengths do not link; equal vectors link as copies do. A NULL vec_id takes part but names a component only if it has
    no other; repeated vec_ids are rows of their own. Other columns are ignored, an empty table gives an empty result.
    """
    e = F.col("embedding")
    fine = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = materialise(vectors.select(
        "vec_id", "embedding", F.when(fine, F.sha2(F.array_join(F.transform(e, lambda x: (x + F.lit(0).cast("float")).cast("string")), ","), 256)).alias("key")
    ), "vectors")
    classes = materialise(rows.where("key is not null").groupBy("key").agg(
        F.min("vec_id").alias("vec_id"), F.count("*").alias("n"), F.first("embedding").alias("embedding"),
    ).select(F.monotonically_increasing_id().alias("cid"), "key", "vec_id", "n", "embedding", F.size("embedding").alias("dim")), "classes")
    shards = max(LEAST_SHARDS, -(-classes.count() // SHARD_ROWS))
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("cid"), F.lit(shards)).cast("int"))
    index = materialise(dealt.select("dim", "shard", "cid", "n", "embedding").groupBy("dim", "shard").applyInPandas(_build(least), INDEX), "graphs")

    sent = index.drop("inner")
    left = sent.withColumn("high", F.explode(F.sequence(F.col("shard"), F.lit(shards)))).where(f"high > shard and high < {shards}").withColumnRenamed("shard", "low")
    right = sent.withColumn("low", F.explode(F.sequence(F.lit(0), F.col("shard")))).where("low < shard").withColumnRenamed("shard", "high")
    keys = ("dim", "low", "high")
    found = materialise(
        index.select("cids", "local", "inner").mapInPandas(_within, FOUND).union(
            left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_between(least), FOUND)), "found")

    linked = components(found.where("cid <> other").select(F.col("cid").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("cid").agg(F.sum("n").alias("links"))
    named = classes.join(linked.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    smallest = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    named = named.join(smallest, "component").join(counts, "cid", "left").select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    return rows.select("vec_id", "key").join(named, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
