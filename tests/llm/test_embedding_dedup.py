import numpy as np
import pytest
from pyspark.sql import functions as F

from brightloom.llm import embedding_dedup, hnsw
from brightloom.llm.components import components
from brightloom.llm.hnsw import Graph


def vectors():
    rng = np.random.default_rng(4)
    rows = []
    centres = rng.normal(size=(60, 16))
    for i in range(700):
        c = centres[min(59, i % 90)]
        rows.append((i, [float(x) for x in np.float32(c + rng.normal(size=16) * 0.18)]))
    rows += [(700, rows[5][1]), (701, rows[5][1]), (701, rows[5][1]), (None, rows[6][1]), (702, None), (703, []), (704, [0.0] * 16), (705, [None] + [1.0] * 15),
             (706, [float("nan")] * 16), (707, [float("inf")] * 16), (708, [1.0, 2.0]), (709, [2.0, 4.0]), (710, [float(np.float32(x * 1e30)) for x in rows[7][1]]),
             (711, [float(np.float32(x * 1e-30)) for x in rows[7][1]])]
    return rows


def brute(rows, least):
    def fine(v):
        return v and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)

    n, at, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if fine(v) else None for _, v in rows]
    for i in range(n):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
                links[i] += 1
                links[j] += 1
                at[root(i)] = root(j)
    out = []
    for i, (vec, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(n) if root(j) == root(i) and rows[j][0] is not None]
        least_id = min(ids, default=None)
        out.append((vec, links[i], least_id, vec == least_id))
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, v, 0, 1) for i, v in vectors()], "vec_id long, embedding array<float>, label int, shard int").cache()


def key(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("shards", [1, 5])
def test_against_all_pairs(table, monkeypatch, shards):
    monkeypatch.setattr(embedding_dedup, "LEAST_SHARDS", shards)
    monkeypatch.setattr(embedding_dedup, "SLICE_ROWS", 300)
    got = [tuple(r) for r in embedding_dedup.near_duplicates(table).collect()]
    want = brute(vectors(), 0.9)
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert 0.97 * there <= found <= there
    assert sum(a != b for a, b in zip(key(got), key(want))) <= 0.05 * len(want)


def test_small_shards_are_exact(table, monkeypatch):
    """Shards no larger than a beam are searched by brute force."""
    monkeypatch.setattr(embedding_dedup, "BEAM", 1000)
    got = [tuple(r) for r in embedding_dedup.near_duplicates(table).collect()]
    assert key(got) == key(brute(vectors(), 0.9))


def test_empty_and_lone(table):
    assert embedding_dedup.near_duplicates(table.limit(0)).collect() == []
    one = embedding_dedup.near_duplicates(table.where("vec_id = 3")).collect()
    assert [tuple(r) for r in one] == [(3, 0, 3, True)]
    none = embedding_dedup.near_duplicates(table.where("vec_id between 702 and 707")).collect()
    assert all(r["kept"] and r["n_links"] == 0 for r in none) and len(none) == 6


def test_recall_of_the_graph():
    rng = np.random.default_rng(9)
    v = rng.normal(size=(3000, 24)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph = Graph(v)
    found, _ = graph.search(v[:200], 64)
    truth = np.argsort(-(v[:200] @ v.T), axis=1)[:, :10]
    assert np.mean([len(set(t) & set(f)) / 10 for t, f in zip(truth, found)]) > 0.9
    again = Graph.from_bytes(graph.to_bytes()).search(v[:200], 64)[0]
    assert (again == found).all()


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 240)] + [(5, 5), (3, 4), (4, 3), (None, 1)] + [(160, 2)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 2 for i in [*range(100, 161), 2]}, **{i: 7 for i in [7, *range(200, 240)]}, 5: 5, 3: 3, 4: 3}
    assert components(spark.createDataFrame([], "a long, b long")).where(F.lit(True)).collect() == []


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sparse_and_hot(n, groups, hot, dim=24):
    """Unit vectors in random order: ``n`` alone, ``groups`` of two and a hot group."""
    rng = np.random.default_rng(3)
    pairs = np.repeat(rng.normal(size=(groups, dim)), 2, axis=0)
    close = np.repeat(rng.normal(size=(1, dim)), hot, axis=0)
    both = np.concatenate([pairs, close])
    x = np.concatenate([rng.normal(size=(n, dim)), both + 0.05 * rng.normal(size=both.shape)])
    return unit(x[rng.permutation(len(x))])


def true_links(x, y, least=0.9):
    a, b = np.nonzero(x @ y.T >= least)
    return set(zip(a.tolist(), b.tolist()))


class Misses:
    """A graph whose walks find nothing with beams below ``least``, or only members of the hot group."""

    def __init__(self, vectors, least, hot=()):
        self.vectors, self.least, self.hot = vectors.astype(np.float32), least, np.asarray(hot, int)

    def search(self, queries, beam):
        sims = queries.astype(np.float32) @ self.vectors.T
        if beam < self.least:
            hidden = np.setdiff1d(np.arange(len(self.vectors)), self.hot)
            sims[:, hidden] = -1
        ids = np.argsort(-sims, axis=1)[:, :beam]
        sims = np.take_along_axis(sims, ids, 1)
        return np.where(sims > -1, ids, -1), sims


def shard_of(x, graph, at=0):
    cids = np.arange(at, at + len(x))
    return embedding_dedup.Shard(graph, cids, x, np.ones(len(x), int), cids.copy())


@pytest.mark.parametrize("hot", [0, 300])
def test_the_audit_sees_rare_links(hot):
    """A beam that misses all groups of two is not taken for good, with no other links or with many."""
    x = sparse_and_hot(1500, 12, hot)
    truth = true_links(x, x) - {(i, i) for i in range(len(x))}
    often = np.flatnonzero(np.bincount([a for a, _ in truth], minlength=len(x)) > 100)
    shard = shard_of(x, Misses(x, 128, often))
    a, b, _ = shard.links(shard.cids, x, 0.9)
    assert set(zip(a.tolist(), b.tolist())) == truth and len(a) == len(truth)


def test_a_link_counts_for_both_ends(monkeypatch):
    monkeypatch.setattr(embedding_dedup.Shard, "_audited", lambda self, cids, queries, least: (
        *((np.array([1, 2]), np.array([0, 3])) if self.cids[0] == 0 else (np.array([0, 4]), np.array([1, 5]))), False))
    one, two = (shard_of(np.eye(6), None, at) for at in (0, 10))
    got = embedding_dedup._cross(one, two, 0.9)
    counts = {c: n for c, n in zip(got["cid"], got["n"]) if n}
    assert counts == {0: 1, 3: 1, 4: 1, 11: 1, 12: 1, 15: 1}  # links 0-11 (found twice), 3-12 and 4-15
    assert {(c, o) for c, n, o in zip(got["cid"], got["n"], got["other"]) if not n} == {(0, 11), (3, 12), (4, 15)}


def test_every_node_is_reached():
    x = sparse_and_hot(500, 200, 2500, 8)
    graph = Graph(x)
    for links, nodes in zip(graph.neighbours, graph.nodes):
        assert len(np.unique(links[links >= 0])) == len(nodes)
        reached, front = np.zeros(len(nodes), bool), np.zeros(1, int)
        while len(front):
            reached[front] = True
            front = np.unique(links[front])
            front = front[(front >= 0) & ~reached[front]]
        assert reached.all()


def test_links_of_real_graphs(monkeypatch):
    """Sparse, skewed and between shards: all links of groups of two, and of the hot group nearly all."""
    x = sparse_and_hot(4000, 300, 600)
    half = len(x) // 2
    for own, asked, at in ((x, x, 0), (x[:half], x[half:], half)):
        shard = shard_of(own, Graph(own))
        a, b, _ = shard.links(np.arange(at, at + len(asked)), asked, 0.9)
        truth = {(i, j) for i, j in true_links(asked, own) if i + at != j}
        got = set(zip(a.tolist(), b.tolist()))
        assert got <= truth and len(got) >= 0.99 * len(truth)
        sizes = np.bincount([i for i, _ in truth], minlength=len(asked))
        rare = {p for p in truth if sizes[p[0]] <= 2}
        assert len(rare & got) >= 0.99 * len(rare)


def test_only_new_vectors_are_compared(monkeypatch):
    """A walk compares what it has not seen, in no more columns than the row with the most of it needs."""
    x = sparse_and_hot(1500, 100, 20).astype(np.float32)
    graph, real, asked = Graph(x), hnsw.similarities, []
    monkeypatch.setattr(hnsw, "similarities", lambda vectors, ids, queries: asked.append(ids.copy()) or real(vectors, ids, queries))
    ids, sims = graph.search(x[:300], 32)
    assert asked and all((a >= 0).all(1).any() for a in asked if a.size)
    wide = sum(a.size for a in asked)
    assert wide < 0.7 * sum(len(a) for a in asked) * hnsw.EXPAND * graph.neighbours[0].shape[1]
    there = ids >= 0
    assert np.allclose(sims[there], np.einsum("qd,qed->qe", x[:300], x[ids])[there], atol=1e-5)
    truth = true_links(x[:300], x)
    assert len(truth & {(i, int(j)) for i, row in enumerate(ids) for j in row}) >= 0.99 * len(truth)
