import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brightloom.errors import ColumnNotFound, InvalidDtype, StepError
from brightloom.operators import columns, duplicates, encoding, missing, outliers, scaling


# -- duplicates
def test_duplicates(people):
    row = duplicates.detect(people).first()
    assert (row["total_rows"], row["duplicate_rows"], row["duplicate_percent"]) == (100, 2, 2.0)
    assert duplicates.remove(people).count() == 98
    assert duplicates.remove(people, "none").count() == 97
    assert duplicates.detect(duplicates.remove(people)).first()["duplicate_rows"] == 0
    with pytest.raises(StepError):
        duplicates.remove(people, "some")


def test_detect_on_empty_table(spark):
    row = duplicates.detect(spark.createDataFrame([], "a int, b int, c int, d int, e int, f int, g int")).first()
    assert (row["total_rows"], row["duplicate_rows"], row["duplicate_percent"]) == (0, 0, 0.0)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from([0.0, -0.0, 1.5, None])),
                min_size=1, max_size=25))
def test_keep_like_a_data_frame(spark, pairs):
    frame = pd.DataFrame(pairs, columns=["k", "v"])
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "at long, k string, v double")
    for keep in ("first", "last", "none"):
        kept = frame.drop_duplicates(keep=False if keep == "none" else keep).index
        assert sorted(r["at"] for r in duplicates.remove(df, keep, ["at"]).collect()) == list(kept)
        gone = sorted(set(frame.index) - set(kept))
        row = duplicates.preview(df, keep, ["at"]).first()
        assert row["affected_rows"] == len(gone)
        assert [r["at"] for r in row["sample_before"]] == gone[:10]
        assert [r["at"] for r in row["sample_after"]] == list(kept)[:10]


@pytest.mark.parametrize("wide", [2, 99])
def test_hot_copies(spark, monkeypatch, wide):
    """A third of the rows are copies of one row, by hash first or by rows at once."""
    monkeypatch.setattr(duplicates, "WIDE_ROW", wide)
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("a"), F.lit("x").alias("k"))
    assert duplicates.detect(df).first()["duplicate_rows"] == 9_999
    monkeypatch.setattr(duplicates, "MOST_BROADCAST", 0)
    assert duplicates.detect(df).first()["duplicate_rows"] == 9_999


# -- missing
@pytest.mark.parametrize("strategy", ["mean", "median", "mode"])
def test_imputation(people, people_frame, strategy):
    filled = missing.impute(people, "age", strategy)
    assert filled.where("age is null").count() == 0
    value = getattr(people_frame["age"], strategy)()
    value = value[0] if strategy == "mode" else value
    assert filled.where("id = 11").first()["age"] == pytest.approx(value)
    assert filled.where("gender is null").count() == people.where("gender is null").count()


def test_constant_coercion(spark):
    df = spark.createDataFrame([(1, 1.0, True, "a"), (None, None, None, None)],
                               "i long, d double, b boolean, s string")
    assert missing.impute(df, "i", "constant", "3").where("i = 3").count() == 1
    with pytest.raises(StepError):
        missing.impute(df, "i", "constant", "2.5")
    with pytest.raises(StepError):
        missing.impute(df, "d", "constant", "abc")
    for word, value in (("yes", True), ("T", True), ("1", True), ("no", False), ("f", False)):
        assert missing.fill_value(df, "b", "constant", word) is value
    with pytest.raises(StepError):
        missing.fill_value(df, "b", "constant", "maybe")
    assert missing.fill_value(df, "s", "constant", 123) == "123"
    with pytest.raises(StepError):
        missing.fill_value(df, "s", "constant", None)
    with pytest.raises(StepError):
        missing.impute(df, "s", "mean")
    with pytest.raises(ColumnNotFound):
        missing.impute(df, "zzz", "mean")


def test_all_missing_mode_changes_nothing(spark):
    df = spark.createDataFrame([(None,)] * 3, "a string")
    assert missing.impute(df, "a", "mode").where("a is null").count() == 3


def test_mode_takes_the_smallest_of_ties(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "k string")
    assert missing.fill_value(df, "k", "mode") == "a"


def test_missing_preview(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 3.0)], "id int, A double")
    row = missing.preview(df, "A", "mean", order_by=["id"]).first()
    assert row["affected_rows"] == 1
    assert row["sample_before"][0]["A"] is None and row["sample_after"][0]["A"] == 2.0
    dropped = missing.preview(df, "A", "drop", order_by=["id"]).first()
    assert dropped["affected_rows"] == 1 and dropped["sample_after"] == []
    none = missing.preview(df, "id", "mean").first()
    assert none["affected_rows"] == 0 and none["sample_before"] == []


def test_missing_advice(spark):
    rows = [(None if i < 10 else 1.0, None if i < 30 else 1.0, None if i < 70 else 1.0,
             None if i < 30 else "a", None if i < 70 else "a", 1) for i in range(100)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d string, e string, f int")
    advice = {r["column"]: r["recommended"] for r in missing.recommend(df).collect()}
    assert advice == {"a": "median", "b": "mean", "c": "drop", "d": "mode", "e": "drop"}


@pytest.mark.parametrize("rows_per_stretch", [10**9, 40])
def test_forward_fill_with_a_hot_group(spark, rows_per_stretch):
    rng = np.random.default_rng(2)
    n = 600
    frame = pd.DataFrame({
        "at": np.arange(n), "k": np.where(rng.random(n) < 0.5, 0, rng.integers(1, 6, n)),
        "v": np.where(rng.random(n) < 0.7, np.nan, rng.random(n)),
    })
    df = spark.createDataFrame(
        [(int(a), int(k), None if np.isnan(v) else float(v)) for a, k, v in frame.itertuples(index=False)],
        "at long, k long, v double")
    got = missing.forward_fill(df, ["v"], ["at"], ["k"], rows_per_stretch).orderBy("at").toPandas()["v"]
    expected = frame.groupby("k")["v"].ffill()
    pd.testing.assert_series_equal(got.astype(float), expected, check_names=False)


# -- outliers
def test_salary_outliers(people):
    found = {r["column"]: r for r in outliers.detect(people).collect()}
    assert found["salary"]["outliers"] >= 2
    for action in ("remove", "cap"):
        treated = outliers.treat(people, "salary", "iqr", action)
        low, high = treated.agg(F.min("salary"), F.max("salary")).first()
        assert 0 < low and high < 150000
    assert outliers.treat(people, "salary", "iqr", "cap").count() == 100


def test_few_values_are_left_alone(spark):
    df = spark.createDataFrame([(float(i),) for i in (1, 2, 3, 400)], "A double")
    assert outliers.detect(df).count() == 0
    assert outliers.treat(df, "A", "iqr", "remove").count() == 4
    assert outliers.preview(df, "A").first()["affected_rows"] == 0


def test_constant_column_has_no_zscore_bounds(spark):
    df = spark.createDataFrame([(1.0,)] * 5, "A double")
    row = outliers.detect(df, "zscore").first()
    assert (row["outliers"], row["lower_bound"], row["upper_bound"]) == (0, None, None)


def test_keep_preview_is_identical(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 1.1, 1.2, 1.3, 100.0])], "i int, A double")
    row = outliers.preview(df, "A", "iqr", "keep", order_by=["i"]).first()
    assert row["affected_rows"] == 1 and row["sample_before"] == row["sample_after"]


def test_forest(spark, people):
    small = spark.createDataFrame([(v,) for v in (1.0, 1.1, 1.2, 1.3, 100.0)], "A double")
    capped = outliers.treat(small, "A", "iforest", "cap", contamination=0.2)
    assert capped.agg(F.max("A")).first()[0] < 100
    found = {r["column"]: r["outliers"] for r in outliers.detect(people, "iforest").collect()}
    assert 0 < found["salary"] <= 8
    kept = outliers.treat(people, "salary", "iforest", "remove")
    assert kept.count() == 100 - found["salary"]
    assert kept.agg(F.max("salary")).first()[0] < 200000


def test_forest_share(spark):
    df = spark.range(20_000).select(F.randn(7).alias("x"))
    row = outliers.detect(df, "iforest", contamination=0.05).first()
    assert 0.045 < row["outliers"] / 20_000 <= 0.0501
    low, high = df.agg(F.min("x"), F.max("x")).first()
    assert low < row["lower_bound"] < -1.5 and 1.5 < row["upper_bound"] < high


def test_forests_of_all_columns(spark):
    """The same whatever the layout and whichever columns are fitted together; copies count as often as they stand there."""
    df = spark.range(30_000).select(F.when(F.col("id") < 9000, 7.0).otherwise(F.randn(3)).alias("a"), (F.col("id") % 50).alias("b"), F.lit(None).cast("double").alias("c"))
    df = spark.createDataFrame(df.toArrow())
    present = {"a": 30_000, "b": 30_000, "c": 0}
    whole = outliers.forest.fit_all(df, ["a", "b", "c"], 0.05, present)
    assert whole["c"].bounds == (None, None)
    assert outliers.forest.fit_all(df.repartition(7, "b"), ["a", "b", "c"], 0.05, present) == whole
    hashes, drawn = outliers.forest.draw(0, np.array([1.0, 2.0, 3.0]), np.array([10_000, 60, 20_000]), 0.5)
    assert abs((drawn == 1).sum() - 5000) < 300 and abs((drawn == 3).sum() - 10_000) < 400 and 15 < (drawn == 2).sum() < 45 and hashes.max() < 0.5


def test_nulls_survive_removal(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 1.1, 1.2, 1.3, 100.0, None)], "A double")
    kept = [r["A"] for r in outliers.treat(df, "A", "iqr", "remove").collect()]
    assert None in kept and 100.0 not in kept and len(kept) == 5


def test_outlier_advice(spark):
    values = [1.0] * 47 + [100.0, -100.0, 50.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    row = outliers.recommend(df).first()
    assert (row["outliers"], row["recommended_action"]) == (3, "cap")


# -- encoding
def test_encoding(spark):
    df = spark.createDataFrame([("Male", 1), ("Female", 2), (None, 3), ("Male", 4)], "gender string, val int")
    codes = [r["gender"] for r in encoding.label_encode(df, "gender").orderBy("val").collect()]
    assert codes == [1, 0, None, 1]
    hot = encoding.onehot_encode(df, "gender")
    assert hot.columns == ["val", "gender_Female", "gender_Male"]
    assert [tuple(r)[1:] for r in hot.orderBy("val").collect()] == [(0, 1), (1, 0), (0, 0), (0, 1)]
    with pytest.raises(StepError):
        encoding.onehot_encode(df, "val", max_categories=2)


def test_label_codes_join_with_hot_values(spark, monkeypatch):
    """Large maps are joined by shuffle, hot values by broadcast; both give the same codes."""
    df = spark.range(5000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 11 == 0, None)
        .otherwise(F.concat(F.lit("v"), F.col("id").cast("string"))).alias("k"))
    small = encoding.label_encode(df, "k").orderBy("id").toPandas()
    monkeypatch.setattr(encoding, "BROADCAST_ROWS", 10)
    codes = encoding.code_map(df, "k")
    assert not codes.small and codes.hot.count() == 1
    large = encoding.label_encode(df, "k", codes).orderBy("id").toPandas()
    pd.testing.assert_frame_equal(small, large)
    texts = df.orderBy("id").toPandas()["k"]
    expected = texts.dropna().astype("category").cat.codes
    assert (large["k"].dropna().astype(int) == expected).all()


def test_number_text(spark):
    values = [1e-05, 0.0001, 0.00012345, 0.5, 1.0, 123456.0, 12345678.9, 1e15, 1e16, 1.5e20, -2.5e-7, 0.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    from brightloom.functions.columns import col, dtype_of, text_of

    texts = df.select("i", text_of(col("v"), dtype_of(df, "v")).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in texts] == [str(v) for v in values]


def test_unknown_values(spark):
    df = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "k string")
    codes = encoding.code_map(df.where("k < 'c'"), "k")
    assert [r["k"] for r in encoding.ordinal_encode(df, "k", codes).collect()] == [0, 1, -1, None]


def test_encoding_advice(spark):
    df = spark.createDataFrame([(f"v{i % 2}", f"Val_{i % 11}", 1) for i in range(50)], "low string, high string, n int")
    advice = {r["column"]: r["recommended"] for r in encoding.recommend(df).collect()}
    assert advice == {"low": "onehot", "high": "label"}


# -- scaling
def test_scaling(people, spark):
    scaled = scaling.scale(people, ["salary"], "standard").toPandas()["salary"]
    assert abs(scaled.mean()) < 1e-7 and abs(scaled.std(ddof=0) - 1) < 1e-7
    df = spark.createDataFrame([(float(v), 3.0, None) for v in (10, 20, 30, 40, 50)], "val double, c double, e double")
    pdf = scaling.scale(df, ["val", "c", "e"], "minmax").toPandas()
    assert pdf["val"].tolist() == [0, 0.25, 0.5, 0.75, 1] and pdf["c"].tolist() == [0] * 5
    robust = scaling.scale(df, ["val", "c"], "robust").toPandas()
    assert robust["val"].tolist() == [-1, -0.5, 0, 0.5, 1] and robust["c"].tolist() == [0] * 5
    with pytest.raises(StepError):
        scaling.scale(people, ["name"])
    preview = scaling.preview(people, ["salary"], "minmax", ["id"]).first()
    assert preview["affected_rows"] == 100 and len(preview["sample_after"]) == 10


# -- columns
def test_casts(spark):
    df = spark.createDataFrame([("1", "2.5", "x", "2026-01-05"), (None, "3", "y", None)],
                               "i string, f string, s string, d string")
    assert [r["i"] for r in columns.cast(df, "i", "int").collect()] == [1, None]
    assert [r["f"] for r in columns.cast(df, "f", "float").collect()] == [2.5, 3.0]
    assert columns.cast(df, "d", "datetime").schema["d"].dataType.typeName() == "timestamp"
    assert columns.cast(df, "d", "string", null_text="nan").collect()[1]["d"] == "nan"
    for column, target in (("s", "int"), ("s", "float"), ("s", "datetime"), ("f", "int"), ("s", "blob")):
        with pytest.raises(InvalidDtype):
            columns.cast(df, column, target)
    empty = spark.createDataFrame([(None,)], "a string")
    assert columns.cast_check(empty, "a", "int").first()["castable"]


def test_big_whole_numbers_keep_their_digits(spark):
    df = spark.createDataFrame([("9007199254740993",)], "n string")
    assert columns.cast(df, "n", "int").first()["n"] == 9007199254740993


def test_drop_and_rename(people):
    assert "age" not in columns.drop(people, ["age"]).columns
    with pytest.raises(ColumnNotFound):
        columns.drop(people, ["nope"])
    assert columns.rename(people, "age", "years.old").columns[2] == "years.old"
    with pytest.raises(StepError):
        columns.rename(people, "age", "salary")


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b")], "`a.b c` double, `x``y` string")
    assert missing.impute(df, "a.b c", "mean").where("`a.b c` is null").count() == 0
    assert encoding.label_encode(df, "x`y").columns == ["a.b c", "x`y"]
    assert duplicates.detect(df).first()["duplicate_rows"] == 0


@pytest.mark.parametrize("rows_per_stretch", [10**9, 30])
def test_lags_with_a_hot_group(spark, rows_per_stretch):
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({"at": np.arange(400), "k": np.where(rng.random(400) < 0.6, 0, rng.integers(1, 5, 400)),
                          "v": rng.random(400)})
    df = spark.createDataFrame(frame).withColumn("k", F.when(F.col("k") != 4, F.col("k")))
    got = missing.lags(df, "v", 3, ["at"], ["k"], rows_per_stretch).orderBy("at").toPandas()
    for i in (1, 2, 3):
        expected = frame.groupby("k")["v"].shift(i)
        pd.testing.assert_series_equal(got[f"lag_{i}"].astype(float), expected, check_names=False)


@pytest.mark.parametrize("rows_per_stretch", [1, 2, 7, 100])
def test_stretches_cut_ties(spark, rows_per_stretch):
    rows = [(1, "ab"[i % 2 and i > 30], i, float(i) if i % 3 == 0 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "day long, k string, i long, v double").repartition(4)
    placed = missing.in_stretches(df, ["day", "i"], ["k"], rows_per_stretch)
    assert placed.groupBy("_stretch").count().agg(F.max("count")).first()[0] <= rows_per_stretch
    frame = pd.DataFrame(rows, columns=["day", "k", "i", "v"]).sort_values(["k", "i"])
    filled = missing.forward_fill(df, ["v"], ["day", "i"], ["k"], rows_per_stretch).orderBy("k", "i").toPandas()
    want = frame.groupby("k")["v"].ffill()
    assert filled["v"].fillna(-1).tolist() == want.fillna(-1).tolist()
    got = missing.lags(df, "v", 3, ["day", "i"], ["k"], rows_per_stretch).orderBy("k", "i").toPandas()
    for n in (1, 2, 3):
        assert got[f"lag_{n}"].fillna(-1).tolist() == frame.groupby("k")["v"].shift(n).fillna(-1).tolist()
