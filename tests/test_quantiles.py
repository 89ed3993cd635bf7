import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from brightloom.functions import quantiles as q

PROBS = [0.0, 0.001, 0.25, 0.5, 0.75, 0.999, 1.0]


def check(spark, frame, **limits):
    df = spark.createDataFrame(frame)
    found = q.exact_quantiles(df, list(frame.columns), PROBS, **limits)
    for c in frame:
        expected = frame[c].dropna().quantile(PROBS).tolist()
        assert found[c] == pytest.approx(expected), c


@pytest.fixture
def tight(monkeypatch):
    """Small limits, so that brackets are sampled, counted, moved and read out."""
    monkeypatch.setattr(q, "SAMPLE", 1000)
    monkeypatch.setattr(q, "READ_OUT", 3000)


def test_many_shapes(spark, tight):
    rng = np.random.default_rng(3)
    n = 20_000
    hot = rng.normal(size=n)
    hot[: n // 3] = 7.0                         # a third of all rows hold one value
    frame = pd.DataFrame({
        "uniform": rng.random(n), "hot": hot, "few": rng.integers(0, 5, n).astype(float),
        "same": np.ones(n), "heavy": rng.standard_cauchy(n),
        "two": np.where(rng.random(n) < 0.5, -1e9, 1e9),
    })
    check(spark, frame)


def test_gaps_are_skipped(spark, tight):
    rng = np.random.default_rng(4)
    values = pd.Series(rng.random(5000))
    values[::3] = None
    df = spark.createDataFrame([(None if pd.isna(v) else float(v),) for v in values], "x double")
    assert q.exact_quantiles(df, ["x"], [0.5])["x"][0] == pytest.approx(values.median())


def test_missed_brackets_are_moved(spark, monkeypatch):
    """A misleading sample costs scans, never the answer."""
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"x": rng.random(4000)})
    monkeypatch.setattr(q, "SAMPLE", 50)
    monkeypatch.setattr(q, "READ_OUT", 300)
    real = q._tighten
    calls = []

    def misled(values, slot, targets):
        size = real(values, slot, targets)
        if not calls:
            for t in targets:
                t.low, t.high = 0.9, 0.91       # wrong on purpose
                t.size = t.guess = 40
        calls.append(1)
        return size

    monkeypatch.setattr(q, "_tighten", misled)
    check(spark, frame)


def test_no_values(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert q.exact_quantiles(df, ["x"], [0.5]) == {"x": [None]}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60))
def test_small_tables(spark, values):
    check(spark, pd.DataFrame({"x": values}))
    check(spark, pd.DataFrame({"x": values}))


def test_approximate(spark):
    df = spark.range(10_001)
    assert q.approximate_quantiles(df, ["id"], [0.5])["id"][0] == pytest.approx(5000, abs=2)
