import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightloom.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<float>, row int, goals string, norm string"


def rows_of(n=420, dims=24, seed=1):
    """Clusters, copies, ties, repeated rows, shorter, empty, zero, NULL and non-finite vectors."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    rows = []
    for i in range(n):
        v = centres[i % 6] + rng.normal(size=dims)
        rows.append((i, int(rng.integers(0, 4)), (v / np.linalg.norm(v)).tolist(), 1, "g", "n"))
    copy = rows[0][2]
    rows += [(n + i, i % 4, copy, 1, "g", "n") for i in range(60)]
    rows += [rows[0], rows[7], (1000, 1, [0.5, -0.25], 1, "g", "n"), (1001, 1, [], 1, "g", "n"), (1002, 2, [0.0] * dims, 1, "g", "n")]
    rows += [(1003, 1, None, 1, "g", "n"), (1004, None, copy, 1, "g", "n"), (None, 1, copy, 1, "g", "n"), (1005, 1, copy[:-1] + [None], 1, "g", "n")]
    rows += [(1006, 1, copy[:-1] + [math.nan], 1, "g", "n"), (1007, 1, copy[:-1] + [math.inf], 1, "g", "n"), (1008, 1, [1e20] * dims, 1, "g", "n"), (1009, 3, [-x for x in copy], 1, "g", "n")]
    random.Random(seed).shuffle(rows)
    return rows


def brute(rows, step, scale=256):
    width = max(len(r[2]) for r in rows if r[2])
    good = []
    for i, label, v, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(scale * float(np.float32(x))) for x in v] + [0] * (width - len(v))
        if sum(x * x for x in w) < 2**62:
            good.append((i, label, w))
    out = []
    for i, label, w in good:
        if i % step:
            continue
        scored = sorted((-sum(a * b for a, b in zip(w, x)), j, m) for j, m, x in good)
        chosen = [(-s, j) for s, j, m in scored if m == label and j != i][:5]
        for ps, j in chosen:
            fit = [(-s, k) for s, k, m in scored if m != label and 30 * ps <= -100 * s <= 90 * ps][:10]
            out += [(i, j, rank + 1, k, ps, s) for rank, (s, k) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("block_bytes,dims", [(64 << 20, 24), (4000, 24), (8000, 70)])
def test_against_brute_force(spark, block_bytes, dims):
    rows = rows_of(dims=dims)
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = hn.mine(table, F.col("vec_id") % 50 == 0, block_bytes=block_bytes).collect()
    assert sorted(map(tuple, got)) == brute(rows, 50)


def test_large_numbers(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i % 3, (rng.normal(size=8) * 10.0 ** rng.integers(2, 6)).tolist(), 1, "g", "n") for i in range(200)]
    got = hn.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, got)) == brute(rows, 20)


def test_nothing_to_mine(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hn.mine(empty, F.col("vec_id") % 100 == 0).collect() == []
    alone = spark.createDataFrame([(100, 1, [1.0], 1, "g", "n")], SCHEMA)
    assert hn.mine(alone, F.col("vec_id") % 100 == 0).collect() == []
    assert hn.mine(alone, F.col("vec_id") < 0).collect() == []


def test_intervals_hold_every_score():
    rng = np.random.default_rng(3)
    for dims in (1, 24, 64, 100, 768):
        v = np.floor(256 * rng.normal(size=(500, dims))).astype("<i4")
        v[:5] = 0
        v[5:10] = v[300]
        norms, codes, align = hn.encode(v)
        query = hn.Query(v[:40])
        low, high = query.bounds(norms, codes, align)
        exact = v[:40].astype(np.int64) @ v.astype(np.int64).T
        assert (low <= exact).all() and (exact <= high).all()
        assert (query.scores(v, norms) == exact).all()
    far = high < np.partition(exact, -5, axis=1)[:, -5, None]
    assert far.mean() > 0.01  # intervals do rule rows out


def test_best_keeps_ties_by_id():
    best = hn.Best(2, 3)
    best.add(np.array([0, 0, 1, 0]), np.array([5, 5, 1, 5]), np.array([9, 2, 4, 7]))
    best.add(np.array([0, 0]), np.array([5, 6]), np.array([1, 30]))
    assert list(zip(best.goal, best.score, best.id)) == [(0, 6, 30), (0, 5, 1), (0, 5, 2), (1, 1, 4)]
    assert best.floor[0] == 5 and best.floor[1] == hn.LOW
