import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brightloom.errors import ColumnNotFound
from brightloom.operators import profile, quality
from brightloom.operators.profile import TableStats


def as_dict(df, key="name"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_inspect(people):
    rows = as_dict(profile.inspect(people))
    assert profile.shape(people).first().asDict() == {"rows": 100, "columns": 6}
    assert rows["age"]["missing"] == 3 and rows["age"]["missing_percent"] == 3.0
    assert rows["id"]["unique"] == 98 and rows["id"]["cardinality"] == 0.98


def test_one_scan_distinct_counts_agree(people):
    assert TableStats(people).distinct == TableStats(people, one_scan=True).distinct


def test_column_search_and_classes(people):
    inspected = profile.inspect(people)
    assert [r["name"] for r in profile.find_columns(inspected, "NA").collect()] == ["name"]
    classes = {r["name"]: r["type_class"] for r in profile.with_display_class(inspected).collect()}
    assert classes == {"id": "numeric", "name": "categorical", "age": "numeric", "salary": "numeric",
                       "gender": "categorical", "date": "datetime"}


def test_first_rows(people):
    assert profile.first_rows(people, 15, ["id"]).count() == 15
    with pytest.raises(ValueError):
        profile.first_rows(people, 101)


def test_dates_in_text(spark):
    df = spark.createDataFrame(
        [("2026-01-01", 1, "5"), ("2026-02-01", 2, "USR_1"), ("2026-03-01", 3, "x"), (None, 4, None)],
        "date_str string, num_val int, other string")
    stats = TableStats(df)
    assert stats.datetime == ["date_str"] and stats.categorical == ["other"]


def test_target_candidates(spark):
    df = spark.range(200).select(
        F.col("id").alias("row_id"), (F.col("id") % 2).alias("churned"), F.rand(1).alias("salary"),
        F.rand(2).alias("price"))
    assert TableStats(df).target_candidates() == ["churned", "salary"]
    assert TableStats(df).target_candidates(strict=True) == ["churned"]


def test_skew_and_variance_match_pandas(people, people_frame):
    rows = as_dict(profile.skew_and_variance(people), "column")
    for c in ("age", "salary"):
        assert rows[c]["skewness"] == pytest.approx(people_frame[c].skew())
        assert rows[c]["variance"] == pytest.approx(people_frame[c].var())


def test_all_missing_column_has_no_skew(spark):
    df = spark.createDataFrame([(None,)] * 3, "A double")
    assert profile.skew_and_variance(df).first().asDict() == {"column": "A", "skewness": 0.0, "variance": 0.0}


def test_class_imbalance(spark, people):
    df = spark.createDataFrame([("A",)] * 8 + [("B",)] * 2, "t string")
    row = quality.class_imbalance(df, "t").first()
    assert row["ratio"] == "80:20" and row["imbalanced"]
    empty = spark.createDataFrame([(None,)] * 3, "t string")
    assert quality.class_imbalance(empty, "t").first()["ratio"] == "0:0"
    with pytest.raises(ColumnNotFound):
        quality.class_imbalance(people, "nope")


def test_quality_score(spark, people):
    empty = spark.createDataFrame([], "a int")
    assert quality.quality_score(empty).first()["score"] == 0
    row = quality.quality_score(people).first()
    assert "2 rows repeat others: -10" in row["warnings"]
    cats = spark.createDataFrame([(f"val_{i}", float(i)) for i in range(20)], "cat string, num double")
    warnings = quality.quality_score(cats).first()["warnings"]
    assert any("very many values" in w for w in warnings)


def test_report(people, tmp_path):
    report = quality.quality_report(people, "people", 2).first()
    assert report["summary"]["total_rows"] == 100 and report["summary"]["total_columns"] == 6
    assert report["duplicates"]["duplicate_rows"] == 2
    assert report["missing"]["columns_with_missing"] == 2
    path = quality.write_report(people, str(tmp_path / "report"))
    assert people.sparkSession.read.json(path).count() == 1


@pytest.mark.parametrize("target,expected", [("target", "classification"), ("amount", "regression"),
                                             (None, "clustering")])
def test_problem_type(spark, target, expected):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame({"feature": rng.normal(size=100), "kind": rng.choice(list("ABC"), 100),
                          "target": rng.integers(0, 2, 100), "amount": rng.normal(size=100)})
    row = profile.profile_row(spark.createDataFrame(frame), "s", target).first()
    assert row["problem_type"] == expected
    assert row["row_count"] == 100 and row["numeric_count"] == 3
    assert (row["class_balance"] is None) == (expected != "classification")


def test_profile_text(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (None, "a")], "x double, k string")
    text = profile.profile_row(df, "s", "k", goal="sort things").first()["feature_description"]
    assert text == (
        "Goal: sort things. Tabular dataset with 3 rows and 2 columns. Classification task targeting 'k'. "
        "50% numeric features, 50% categorical features. Moderate missing value ratio. Low outlier ratio. "
        "Balanced classes. Small dataset.")


def test_date_layouts(spark):
    texts = ["2026-01-05", "2026-01-05 10:11:12", "2026-01-05 10:11:12.123456", "2026-01-05T10:11:12",
             "2026-01-05T10:11:12.123456", "2026-01-05T10:11:12Z", "2026-01-05T10:11:12+02:00",
             "2026-01-05 10:11:12+02:00", "01/05/2026", "2026/01/05", "05-Jan-2026", "2026"]
    bad = ["5", "USR_1", "2026-13-01", "99/99/2026", "hello", ""]
    df = spark.createDataFrame([(t,) for t in texts + bad], "t string")
    parsed = {r["t"]: r["p"] for r in df.select("t", profile.parse_date(F.col("t")).alias("p")).collect()}
    assert [t for t in texts if parsed[t] is None] == [] and [t for t in bad if parsed[t] is not None] == []
    assert parsed["05-Jan-2026"] == parsed["01/05/2026"] == parsed["2026-01-05"]


def test_dates_after_many_gaps(spark):
    df = spark.range(0, 1000, 1, 4).select(
        F.when(F.col("id") > 700, "2026-01-01").alias("late"), F.when(F.col("id") > 700, "x").alias("text"),
        F.lit(None).cast("string").alias("never"))
    assert TableStats(df).datetime == ["late"]


def test_many_profiles_equal_single_ones(spark):
    from brightloom.operators import many_profiles

    tables = []
    for i in range(8):
        df = spark.range(30 + 17 * i).select(
            F.when(F.col("id") % 9 != 0, F.col("id") * F.col("id") % (7 + i)).alias("whole"), (F.col("id") / 3).alias("part"),
            F.concat(F.lit("2024-01-0"), F.col("id") % 9 + 1).alias("day"),
            F.concat(F.lit("x" * 40), F.col("id") % (i + 2)).alias("text"), F.lit(None).cast("string").alias("empty"), F.array("id").alias("list"))
        tables.append(df)
    requests = [{"table": df, "session_id": str(i), "target": [None, "whole", "text", "part"][i % 4]} for i, df in enumerate(tables)]
    many = profile.profile_many(requests).collect()
    for request, row in zip(requests[:4], many):
        assert row == profile.profile_row(**request).first()
    numbers = [["whole", "part"]] * 8
    present = [n for _, n, _ in many_profiles.counts(tables, profile.parse_date)]
    plain = many_profiles.quantiles(tables, numbers, present, (0.1, 0.5, 0.99))
    assert many_profiles.quantiles(tables, numbers, present, (0.1, 0.5, 0.99), sample=50, read_out=40) == plain
    frame = tables[7].toPandas()
    assert plain[7, 0] == pytest.approx(frame["whole"].dropna().quantile([0.1, 0.5, 0.99]).tolist())


def test_grouped_quantiles_of_hot_values(spark):
    from brightloom.operators import many_profiles

    df = spark.range(5000).select(F.when(F.col("id") < 4000, 7.0).otherwise(F.col("id").cast("double")).alias("v"))
    found = many_profiles.quantiles([df], [["v"]], [{"v": 5000}], (0.0, 0.5, 0.79, 0.9, 1.0), sample=60, read_out=30)
    assert found[0, 0] == pytest.approx([7, 7, 7, 4499.1, 4999])


def test_grouped_quantiles_read_the_tables_a_few_times(spark):
    from brightloom.operators import many_profiles

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    n = 200_000
    values = np.random.default_rng(2).lognormal(sigma=3, size=n)
    values[: n // 3] = -0.0
    df = spark.createDataFrame(pd.DataFrame({"v": values, "w": np.round(values, 1)})).mapInArrow(counted, "v double, w double")
    found = many_profiles.quantiles([df], [["v", "w"]], [{"v": n, "w": n}], (0.25, 0.5, 0.75), sample=1000, read_out=300)
    for c, name in enumerate("vw"):
        assert found[0, c] == pytest.approx(pd.Series(np.round(values, 1) if c else values).quantile([0.25, 0.5, 0.75]).tolist())
    assert read.value <= 6 * n


def test_classes_group_each_column_by_its_own_type(spark):
    from brightloom.operators import many_profiles

    df = spark.createDataFrame([(0.0, "a", True), (-0.0, "b" * 40, None), (float("nan"), "b" * 40, None), (float("nan"), None, None)],
                               "d double, s string, b boolean")
    assert many_profiles.classes([df, df.limit(0)]) == {(0, 0): (2, 2, 2), (0, 1): (2, 1, 2), (0, 2): (1, 1, 1)}
