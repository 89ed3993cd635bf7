import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from brightloom.errors import StepError
from brightloom.models import agglomerate, fourier, neighbours, range_finder, survival, target_codes


def vectors(spark, x, **more):
    names = list(more)
    rows = [(Vectors.dense(v), *(float(more[c][i]) for c in names)) for i, v in enumerate(x.tolist())]
    return spark.createDataFrame(rows, ["features", *names]).repartition(5)


# -- Cox regression ---------------------------------------------------------------


def plain_cox(x, time, event, rounds=30):
    """Newton's steps over all events in turn, ties after Efron."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        w = np.exp(x @ beta)
        value, gradient, curvature = 0.0, np.zeros(len(beta)), np.zeros((len(beta),) * 2)
        for t in np.unique(time[event == 1]):
            risk, hit = time >= t, (time == t) & (event == 1)
            n = hit.sum()
            value += (x[hit] @ beta).sum()
            gradient += x[hit].sum(0)
            for k in range(n):
                share = risk - k / n * hit
                p = (share * w).sum()
                mean = (share * w) @ x / p
                value -= np.log(p)
                gradient -= mean
                curvature += (x * (share * w)[:, None]).T @ x / p - np.outer(mean, mean)
        step = np.linalg.solve(curvature, gradient)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return beta, value


@pytest.mark.parametrize("times", [2000, 12, 1])
def test_cox_equals_newton(spark, times):
    rng = np.random.default_rng(times)
    x = rng.normal(size=(300, 3))
    raw = rng.exponential(np.exp(-(x @ [0.8, -0.5, 0.0])))
    time = np.ceil(np.argsort(np.argsort(raw)) / 300 * times) + 1.0
    event = (rng.random(300) < 0.7).astype(float)
    model = survival.CoxHazards().fit(vectors(spark, x, label=time, censor=event))
    beta, value = plain_cox(x - x.mean(0), time, event)
    assert np.allclose(model.coefficients, beta, atol=1e-6)
    assert model.logLikelihood == pytest.approx(value, abs=1e-4)


def test_cox_over_many_runs(spark):
    """Runs of a few rows, most of them inside one tied time."""
    rng = np.random.default_rng(1)
    x, time, event = rng.normal(size=(90, 2)), np.sort(np.r_[np.full(60, 5.0), rng.integers(1, 9, 30)])[::-1].copy(), np.ones(90)
    whole = survival.contributions
    beta = np.array([0.3, -0.2])
    rows = [(i, float(time[i]), 1.0, x[i].tolist()) for i in range(90)]
    parts = spark.sparkContext.parallelize([rows[i : i + 7] for i in range(0, 90, 7)], 13).flatMap(lambda r: r)
    table = spark.createDataFrame(parts, "_row long, time double, event double, x array<double>")
    value, gradient, curvature = survival.evaluate(table, beta)
    one = spark.createDataFrame(rows, table.schema).coalesce(1)
    for a, b in zip(survival.evaluate(one, beta), (value, gradient, curvature)):
        assert np.allclose(a, b)
    groups = survival.summed(x, beta, event, np.append(0, np.flatnonzero(np.diff(time)) + 1))
    direct = whole(groups, np.cumsum(groups[:, :7], axis=0), 2)
    assert np.allclose(direct[0], value) and np.allclose(direct[1], gradient) and np.allclose(direct[2], curvature)


# -- nearest neighbours -----------------------------------------------------------


def exact(x, y, q, k, weights="uniform"):
    out = []
    for v in q:
        d = ((x - v) ** 2).sum(1)
        near = np.lexsort((y, d))[:k]
        w = np.ones(k) if weights == "uniform" else ((d[near] == 0) * 1.0 if (d[near] == 0).any() else 1 / np.sqrt(d[near]))
        out.append(max(set(y[near]), key=lambda c: (w[y[near] == c].sum(), -c)))
    return np.array(out)


def three_groups(n, seed, width=6):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n).astype(float)
    return rng.normal(size=(n, width)) + 1.3 * np.eye(3, width)[y.astype(int)], y


@pytest.mark.parametrize("weights", ["uniform", "distance"])
def test_neighbours_of_a_small_table_are_exact(spark, weights):
    x, y = three_groups(150, 1)
    x[100:], y[100:120] = x[:50], 2.0  # repeated rows, some with another label
    q = np.concatenate([three_groups(60, 2)[0], x[:5]])
    model = neighbours.Neighbours(k=7, weights=weights).fit(vectors(spark, x, label=y))
    got = model.transform(vectors(spark, q, at=np.arange(len(q)))).orderBy("at").collect()
    assert [r["prediction"] for r in got] == exact(x, y, q, 7, weights).tolist()


def test_neighbours_come_near_the_exact_ones(spark):
    x, y = three_groups(6000, 3)
    q, truth = three_groups(300, 4)
    model = neighbours.Neighbours(k=5, window=64).fit(vectors(spark, x, label=y))
    table = vectors(spark, q, at=np.arange(len(q))).cache()
    said = np.array([r["prediction"] for r in model.transform(table).orderBy("at").collect()])
    best = exact(x, y, q, 5)
    assert abs((said == truth).mean() - (best == truth).mean()) < 0.03 and (said == best).mean() > 0.9
    near = model.neighbours(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "id long, x array<double>"))
    assert near.count() <= 300 * 5 * 8 * 2  # never all pairs


def test_exact_neighbours_of_more_rows_than_a_window_holds(spark, monkeypatch):
    x, y = three_groups(3000, 3, 24)
    x[2000:2400], y[2000:2200] = x[:400], 2.0   # repeated rows, some with another label
    x[:50] += 1e6   # far away, so that products lose digits
    q = np.concatenate([three_groups(300, 4, 24)[0], x[:60]])
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 1 << 16)
    monkeypatch.setattr(neighbours, "PART_BYTES", 1 << 14)
    model = neighbours.Neighbours(k=5, exact=True).fit(vectors(spark, x, label=y))
    got = model.transform(vectors(spark, q, at=np.arange(len(q)))).orderBy("at").collect()
    assert [r["prediction"] for r in got] == exact(x, y, q, 5).tolist()


def test_neighbours_of_copies_and_of_nothing(spark):
    x = np.concatenate([np.zeros((900, 2)), np.random.default_rng(1).normal(size=(600, 2)) + 4])
    y = np.r_[np.zeros(900), np.ones(600)]
    model = neighbours.Neighbours(k=3).fit(vectors(spark, x, label=y))
    got = model.transform(vectors(spark, np.array([[0.0, 0.0], [4.0, 4.0]]), at=[0, 1])).orderBy("at").collect()
    assert [r["prediction"] for r in got] == [0, 1] and model.n == 601
    with pytest.raises(StepError):
        neighbours.Neighbours().fit(vectors(spark, x, label=y).limit(0))


# -- ordered target codes -----------------------------------------------------------


@pytest.mark.parametrize("rows_per_block", [100_000, 40])
def test_target_codes_see_earlier_rows_only(spark, rows_per_block):
    import hashlib

    rows = [(i, ["a", "b", None][i % 3] if i % 4 else "a", float(i % 5) if i % 7 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "i long, c string, y double").repartition(4)
    got = {r["i"]: r["c__target"] for r in target_codes.ordered(df, ["c"], "y", ["i"], rows_per_block=rows_per_block).collect()}
    known = [y for _, _, y in rows if y is not None]
    prior = sum(known) / len(known)
    order = sorted(rows, key=lambda r: int(hashlib.md5(f"42|{r[0]}".encode()).hexdigest()[:15], 16))
    seen = {}
    for i, c, y in order:
        total, n = seen.get(c, (0.0, 0))
        assert got[i] == pytest.approx((total + prior) / (n + 1))
        if y is not None:
            seen[c] = (total + y, n + 1)
    new = target_codes.fit(df, ["c"], "y").transform(spark.createDataFrame([("a",), ("new",), (None,)], "c string")).collect()
    assert [r["c__target"] for r in new] == pytest.approx([(seen["a"][0] + prior) / (seen["a"][1] + 1), prior, (seen[None][0] + prior) / (seen[None][1] + 1)])


def test_equal_rows_share_their_past(spark):
    df = spark.createDataFrame([("a", 1.0)] * 5 + [("a", 0.0)], "c string, y double")
    got = {(r["y"], round(r["c__target"], 9)) for r in target_codes.ordered(df, ["c"], "y").collect()}
    assert len(got) == 2


# -- radial kernel ------------------------------------------------------------------


def test_ring_needs_the_radial_kernel(spark):
    rng = np.random.default_rng(5)
    angle, far = rng.uniform(0, 2 * np.pi, 600), rng.integers(0, 2, 600)
    x = np.stack([np.cos(angle), np.sin(angle)], 1) * (0.6 + 1.4 * far)[:, None] + rng.normal(size=(600, 2)) * 0.15
    df = vectors(spark, x, label=far).cache()
    right = lambda m: m.transform(df).where("prediction = label").count() / 600
    assert right(fourier.KernelMachine(kernel="linear").fit(df)) < 0.7
    assert right(fourier.KernelMachine().fit(df)) > 0.97


# -- joining clusters -----------------------------------------------------------------


def plain_ward(x, k):
    clusters = [[i] for i in range(len(x))]
    while len(clusters) > k:
        cost = lambda a, b: len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
        i, j = min(((i, j) for i in range(len(clusters)) for j in range(i)), key=lambda p: cost(clusters[p[0]], clusters[p[1]]))
        clusters[j] += clusters.pop(i)
    return {frozenset(c) for c in clusters}


def test_joining_equals_plain_joining(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(70, 3))
    df = vectors(spark, x, at=np.arange(70))
    for k in (2, 3, 6):
        found = {}
        for r in agglomerate.JoinedClusters(k).fit(df).transform(df).collect():
            found.setdefault(r["prediction"], set()).add(int(r["at"]))
        assert {frozenset(v) for v in found.values()} == plain_ward(x, k)


def test_joining_many_rows(spark):
    rng = np.random.default_rng(7)
    centres = np.array([[0, 0], [9, 0], [0, 9.0], [9, 9]])
    group = rng.integers(0, 4, 5000)
    x = centres[group] + rng.normal(size=(5000, 2))
    df = vectors(spark, x, group=group)
    n, found = agglomerate.clustering_features(df.select(agglomerate.ba.dense(df, "features")), 64)
    assert n.sum() == 5000 and len(n) <= 64
    got = agglomerate.JoinedClusters(4, most=64).fit(df).transform(df).groupBy("group", "prediction").count().collect()
    assert sum(max(r["count"] for r in got if r["group"] == g) for g in range(4)) > 4950


# -- principal components ---------------------------------------------------------------


def test_components_equal_the_full_ones(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 30)) @ np.diag(0.7 ** np.arange(30)) @ np.linalg.qr(rng.normal(size=(30, 30)))[0] + 3
    df = vectors(spark, x).select(F.col("features").alias("f"))
    found, shares = range_finder.find(df, share=0.95)
    values, full = np.linalg.eigh(np.cov(x.T))
    values, full = values[::-1], full[:, ::-1]
    k = int(np.searchsorted(np.cumsum(values) / values.sum(), 0.95)) + 1
    assert found.shape == (30, k) and np.allclose(shares, values[:k] / values.sum(), atol=1e-5)
    assert np.linalg.svd(found.T @ full[:, :k])[1].min() > 0.999
    assert range_finder.find(df, k=2)[0].shape == (30, 2)


def test_components_of_wide_sparse_rows(spark):
    width, rng = 20_000, np.random.default_rng(9)
    rows = []
    for i in range(300):
        group = i % 3
        places = np.unique(np.r_[group * 50 + np.arange(8), rng.integers(0, width, 2)])
        rows.append((Vectors.sparse(width, places, np.ones(len(places)) * 2),) if i % 50 else (Vectors.dense(np.eye(1, width, group)[0]),))
    df = spark.createDataFrame(rows, ["scaled"]).repartition(4)
    model = range_finder.RangePCA(k=2).fit(df)
    x = np.zeros((300, width))
    for i, (v,) in enumerate(rows):
        x[i] = v.toArray()
    s = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(model.explainedVariance, (s[1] ** 2 / (s[1] ** 2).sum())[:2], atol=1e-4)
    assert np.linalg.svd(model.components.T @ s[2][:2].T)[1].min() > 0.99
    out = np.array([r["features"].toArray() for r in model.transform(spark.createDataFrame(rows, ["scaled"])).select("features").collect()])
    assert np.allclose(out, x @ model.components)


def test_array_features(spark):
    df = spark.createDataFrame([([0.0, 1.0],), ([1.0, 0.0],)], "x array<double>").select(array_to_vector("x").alias("features"))
    assert agglomerate.JoinedClusters(2).fit(df).transform(df).select("prediction").distinct().count() == 2


# -- what a fit reads and keeps ----------------------------------------------------


def test_kernel_training_reads_its_table_a_few_times_and_spreads_it(spark, monkeypatch):
    from brightloom.plans import training

    read, tasks = spark.sparkContext.accumulator(0), []

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    lifted = fourier._lifted
    monkeypatch.setattr(fourier, "TASK_BYTES", 1 << 19, raising=False)
    monkeypatch.setattr(fourier, "_lifted", lambda df, lift: tasks.append(df.rdd.getNumPartitions()) or lifted(df, lift))
    df = spark.range(0, 1500, 1, 1).selectExpr("cast(id % 37 as double) as a", "cast(id % 11 as double) as b", "id % 37 > 18 as y").mapInArrow(
        counted, "a double, b double, y boolean")
    found = training.train(df, "svm_classifier", "y").metrics
    assert found.where("metric = 'accuracy'").first()["value"] > 0.9
    assert read.value <= 4 * 1500 and tasks[0] >= 4


def test_clustering_keeps_a_bounded_part_of_the_rows_in_a_task(spark, monkeypatch):
    from brightloom.plans import training

    tasks, made = [], training._model

    def watched(*args):
        estimator = made(*args)
        fit = estimator.fit
        estimator.fit = lambda df: tasks.append(df.rdd.getNumPartitions()) or fit(df)
        return estimator

    monkeypatch.setattr(training, "_model", watched)
    monkeypatch.setattr(training, "TASK_BYTES", 1 << 16, raising=False)
    df = spark.range(0, 3000, 1, 1).selectExpr("cast(id % 3 * 100 + id % 7 as double) as a", "cast(id % 3 as string) as t")
    found = training.train(df, "kmeans").metrics
    assert sorted(r["value"] for r in found.where("metric = 'size'").collect()) == [1000, 1000, 1000]
    assert tasks[0] >= 3000 * 100 // (1 << 16)
