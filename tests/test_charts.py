import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brightloom.operators import charts, correlation


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1000, 1000), min_size=1, max_size=50), st.integers(2, 30))
def test_histogram_like_numpy(spark, values, bins):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    low, high = min(values), max(values)
    if low != high and (high - low) < 1e-9 * max(abs(low), abs(high)):
        return
    rows = charts.histogram(df, "x", bins).collect()
    counts, edges = np.histogram(values, bins=bins)
    assert [r["count"] for r in rows] == counts.tolist()
    assert [r["bin_start"] for r in rows] == [round(float(e), 3) for e in edges[:-1]]


def test_histogram_of_text_is_empty(people):
    assert charts.histogram(people, "name").count() == 0
    with pytest.raises(ValueError):
        charts.histogram(people, "age", 1)


def test_boxplot(people, people_frame):
    row = charts.boxplot(people, "salary", ["id"]).first()
    s = people_frame["salary"]
    assert row["median"] == round(s.median(), 3) and row["q1"] == round(s.quantile(0.25), 3)
    assert row["outliers_count"] == len(row["outliers_sample"]) >= 2
    assert charts.boxplot(people, "name").count() == 0


def test_missing_heatmap(spark):
    df = spark.range(200).select(
        F.col("id").alias("A"), F.when(F.col("id") % 2 == 0, 1).alias("B")).repartition(7)
    rows = charts.missing_heatmap(df, ["A"], 50).orderBy("row_index").collect()
    at = np.linspace(0, 199, 50).astype(int)
    assert [r["row_index"] for r in rows] == list(range(50))
    assert [r["B"] for r in rows] == [int(i % 2 == 1) for i in at]
    assert charts.missing_heatmap(df.limit(5)).count() == 5


def test_scatter(spark):
    df = spark.createDataFrame([(i, None if i == 3 else float(i)) for i in range(300)], "x int, y double")
    rows = charts.scatter(df, "x", "y", ["x"]).collect()
    assert len(rows) == 100 and rows[3]["y"] == 0.0


def test_correlation_like_pandas(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame(rng.normal(size=(300, 12)), columns=[f"c{i}" for i in range(12)])
    frame["c1"] = frame["c0"] * 2 + 1e8
    frame = frame.mask(rng.random(frame.shape) < 0.2)
    frame["flat"] = 5.0
    rows = [tuple(None if pd.isna(v) else float(v) for v in r) for r in frame.itertuples(index=False)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in frame)).repartition(5)
    found = correlation.matrix(df)
    expected = frame.corr()
    for (a, b), r in found.items():
        if "flat" in (a, b):
            assert r is None
        else:
            assert r == pytest.approx(expected.loc[a, b], abs=1e-6)
    pairs = correlation.high_pairs(df, 0.9).collect()
    assert [(r["column1"], r["column2"]) for r in pairs] == [("c0", "c1")]


def test_correlation_limits(spark):
    one = spark.createDataFrame([(1.0, "a")], "x double, k string")
    assert correlation.heatmap(one).count() == 0
    wide = spark.range(3).select(*[(F.col("id") * i).alias(f"c{i}") for i in range(305)])
    cells = correlation.matrix(wide)
    assert len(cells) == 305 * 305 and cells["c1", "c304"] == pytest.approx(1.0) and cells["c0", "c304"] is None
    assert correlation.warning(wide) is None and "skipped" in correlation.warning(wide, 300)


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "A int, B int")
    values = {(r["x"], r["y"]): r["value"] for r in correlation.heatmap(df).collect()}
    assert values["B", "A"] is None and values["A", "A"] == 1.0
    ranking = correlation.target_ranking(df, "A").collect()
    assert [(r["feature"], r["correlation"]) for r in ranking] == [("B", 0.0)]
