import pytest
from pyspark.sql import functions as F

from brightloom import FittedRecipe, Recipe
from brightloom.errors import StepError
from brightloom.operators import encoding
from brightloom.plans import job
from brightloom.plans.blueprint import blueprint, groups
from brightloom.sources.tables import export_table, load_table
from brightloom.streaming.frozen import transform_stream


def recipe():
    return (
        Recipe().then("duplicates", keep="first").then("missing", column="age", strategy="median")
        .then("outliers", column="salary", method="iqr", action="cap")
        .then("column_encode", column="gender", method="onehot")
        .then("scaling", columns=["salary"], method="standard")
    )


def test_replay_and_undo(people):
    steps = recipe()
    cleaned = steps.apply(people)
    assert cleaned.count() == 98 and {"gender_Male", "gender_Female"} <= set(cleaned.columns)
    assert abs(cleaned.agg(F.stddev_pop("salary")).first()[0] - 1) < 1e-9
    for left in (4, 3, 2, 1, 0):
        steps = steps.undo()
        assert len(steps) == left
    assert steps.apply(people).exceptAll(people).count() == 0
    with pytest.raises(StepError):
        steps.undo()


def test_fifty_renames_are_one_projection(people):
    steps = Recipe()
    for i in range(50):
        steps = steps.then("column_rename", old_name="age" if i == 0 else f"age{i - 1}", new_name=f"age{i}")
    renamed = steps.apply(people)
    assert "age49" in renamed.columns
    assert renamed._jdf.queryExecution().analyzed().toString().count("Project") == 1


def test_refit_uses_the_table_at_hand(spark):
    df = spark.createDataFrame([(1.0,), (1.1,), (1.2,), (1.3,), (100.0,), (None,)], "A double")
    after = Recipe().then("outliers", column="A", method="iqr", action="remove").then(
        "missing", column="A", strategy="mean").apply(df)
    assert after.agg(F.max("A")).first()[0] == pytest.approx(1.3)


def test_errors_name_the_step(people):
    with pytest.raises(StepError, match="missing"):
        Recipe().then("missing", column="nope", strategy="mean").apply(people)
    with pytest.raises(StepError, match="unknown step type"):
        Recipe().then("dance")
    with pytest.raises(StepError, match="column_cast"):
        Recipe().then("column_cast", column="name", new_dtype="int").apply(people)


def test_files(tmp_path, spark, people):
    steps = recipe().then("missing", column="name", strategy="constant", constant_value="a: \"b\" #c")
    for name in ("r.json", "r.yaml"):
        loaded = Recipe.load(spark, steps.save(spark, str(tmp_path / name)))
        assert [(s.type, s.params) for s in loaded.steps] == [(s.type, s.params) for s in steps.steps]
    rows = steps.history(spark).collect()
    assert rows[0]["step"] == 1 and rows[1]["description"] == "gaps in 'age' filled by median"


def test_affected_rows(people):
    counts = {r["step"]: r["affected_rows"] for r in recipe().affected_rows(people).collect()}
    assert counts[1] == 2 and counts[2] == 3 and counts[3] >= 2 and counts[4] == counts[5] == 98


def test_job_and_cast(tmp_path, spark):
    df = spark.createDataFrame(
        [(1, "a", 25.0, 5e4), (2, "b", 30.0, 6e4), (3, "c", None, 5.5e4), (4, "d", 40.0, 8e4), (5, "e", 35.0, 12e4)],
        "id int, name string, age double, salary double")
    source = export_table(df, str(tmp_path / "in.parquet"))
    steps = Recipe().then("column_drop", columns=["name"]).then(
        "missing", column="age", strategy="median").then("scaling", columns=["salary"], method="minmax")
    path = steps.save(spark, str(tmp_path / "steps.yaml"))
    out = load_table(spark, job.run(spark, path, source, str(tmp_path / "out.parquet")))
    assert "name" not in out.columns and out.where("age is null").count() == 0


def test_frozen_recipe(tmp_path, spark, people, monkeypatch):
    steps = Recipe().then("missing", column="age", strategy="mean").then(
        "column_encode", column="name", method="label").then("scaling", columns=["salary"], method="robust")
    fitted = steps.fit(people)
    again = FittedRecipe.load(spark, fitted.save(spark, str(tmp_path / "frozen")))
    expected = fitted.transform(people).orderBy("id").collect()
    assert again.transform(people).orderBy("id").collect() == expected
    monkeypatch.setattr(encoding, "FEW_VALUES", 5)
    stored = FittedRecipe.load(spark, steps.fit(people).save(spark, str(tmp_path / "frozen2")))
    assert stored.transform(people).orderBy("id").collect() == expected


def test_long_recipes_are_cut(people):
    steps = Recipe()
    for _ in range(9):
        steps = steps.then("scaling", columns=["salary"], method="minmax")
    plan = steps.apply(people)._jdf.queryExecution().analyzed().toString()
    assert "parquet" in plan


def test_stream(tmp_path, spark, people):
    fitted = Recipe().then("missing", column="age", strategy="median").then(
        "column_drop", columns=["name"]).fit(people)
    folder = export_table(people, str(tmp_path / "stream.parquet"))
    stream = spark.readStream.schema(people.schema).parquet(folder)
    query = transform_stream(stream, fitted).writeStream.format("memory").queryName("cleaned").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("select * from cleaned where age is null").count() == 0
    assert spark.sql("select * from cleaned").count() == 100
    bad = Recipe().then("missing", column="age", strategy="ffill", order_by=["id"]).fit(people)
    with pytest.raises(StepError):
        transform_stream(stream, bad)


def test_blueprint(people):
    steps = recipe().then("column_drop", columns=["date"]).then("column_encode", column="name", method="label")
    assert groups(steps)["numeric_impute"] == {"age": "median"} and groups(steps)["scaled"] == {"salary": "standard"}
    base = people.where("gender is not null")
    result = blueprint(steps).fit(base).transform(base)
    assert {"age_imputed", "salary_scaled", "gender_onehot", "name_code"} <= set(result.columns)
