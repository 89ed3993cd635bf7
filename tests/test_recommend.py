import json

import pytest
from pyspark.sql import functions as F

from brightloom.errors import StepError
from brightloom.operators.profile import profile_row
from brightloom.plans import knowledge as kb
from brightloom.plans import recommend, training

FACTS = ("session_id string, row_count long, column_count long, problem_type string, class_balance double, "
         "dimensionality_ratio double, categorical_ratio double, high_cardinality_columns array<string>, "
         "missing_ratio double, outlier_ratio double, categorical_count long, feature_description string")


def profile(spark, **changes):
    facts = {"session_id": "s", "row_count": 15, "column_count": 10, "problem_type": "classification",
             "class_balance": 0.1, "dimensionality_ratio": 0.666667, "categorical_ratio": 0.5,
             "high_cardinality_columns": [], "missing_ratio": 0.0, "outlier_ratio": 0.0,
             "categorical_count": 5, "feature_description": "test", **changes}
    return spark.createDataFrame([tuple(facts.values())], FACTS)


def three(spark):
    keep = {"logistic_regression": (10, None, True), "linear_regression": (5, 100, False),
            "catboost_classifier": (20, None, True)}
    rows = kb.algorithms(spark).where(F.col("id").isin(*keep))
    for column, at in (("min_samples", 0), ("max_features", 1)):
        case = F.lit(None).cast("long")
        for k, v in keep.items():
            case = F.when(F.col("id") == k, F.lit(v[at]).cast("long")).otherwise(case)
        rows = rows.withColumn(column, case)
    return rows


def ids(df):
    return {r["id"] for r in df.collect()}


def test_candidates(spark):
    assert ids(recommend.candidates(profile(spark), three(spark))) == {"logistic_regression"}
    assert ids(recommend.candidates(profile(spark, row_count=50), three(spark))) == {
        "logistic_regression", "catboost_classifier"}
    assert ids(recommend.candidates(profile(spark, problem_type="riddle", row_count=50), three(spark))) == {
        "logistic_regression", "linear_regression", "catboost_classifier"}
    lost = recommend.without_candidates(profile(spark, row_count=1))
    assert [r["session_id"] for r in lost.collect()] == ["s"]
    with pytest.raises(StepError):
        recommend.checked(profile(spark, row_count=1))


def test_filter_scores(spark):
    rows = recommend.candidates(profile(spark, problem_type=None, row_count=5000)).select(
        "id", recommend.imbalance_change().alias("i"), recommend.dimensionality_change().alias("d"),
        recommend.categorical_change().alias("c"))
    scores = {r["id"]: (r["i"], r["d"], r["c"]) for r in rows.collect()}
    assert len(scores) == 37
    assert scores["knn_classifier"] == (0.0, -0.12, -0.10)
    assert scores["lightgbm_classifier"] == (0.0, 0.10, 0.15)
    typed = recommend.candidates(profile(spark, row_count=5000)).select(
        "id", "handles_imbalance", recommend.imbalance_change().alias("i")).collect()
    assert all(r["i"] == (0.15 if r["handles_imbalance"] else -0.10) for r in typed)
    high = recommend.candidates(profile(spark, row_count=5000, high_cardinality_columns=["x"])).select(
        "id", recommend.categorical_change().alias("c")).collect()
    assert {r["id"]: r["c"] for r in high}["logistic_regression"] == pytest.approx(-0.15)


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [2.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 3.0], 0.0),
                                ([0.0, 0.0], [1.0, 1.0], 0.0)], "a array<double>, b array<double>, r double")
    assert df.select(recommend.cosine(F.col("a"), F.col("b")) == F.col("r")).distinct().collect() == [(True,)]


def test_ranking_by_similarity(spark):
    facts = profile(spark, row_count=50, class_balance=None, dimensionality_ratio=0.1, categorical_ratio=0.0)
    similarity = spark.createDataFrame([("s", "catboost_classifier", 1.0)], "session_id string, id string, similarity double")
    top = recommend.ranked(recommend.with_scores(recommend.candidates(facts, three(spark)), similarity)).collect()
    assert [(r["id"], round(r["combined_score"], 6)) for r in sorted(top, key=lambda r: r["rank"])] == [
        ("catboost_classifier", 0.85), ("logistic_regression", 0.15)]
    silent = recommend.candidates(profile(spark, row_count=50, feature_description=" "), three(spark))
    scores = {r["id"]: r for r in recommend.with_scores(silent, similarity).collect()}
    assert scores["logistic_regression"]["combined_score"] == pytest.approx(0.5 + 0.15 - 0.10)


def rankings(spark):
    rows = [("s", 1, "rf", "RF", "c", 0.9, 0.5, "medium", "high", "medium"),
            ("s", 2, "lr", "LR", "c", 0.8, 0.5, "fast", "medium", "high")]
    return spark.createDataFrame(
        rows, "session_id string, rank int, id string, name string, category string, combined_score double, "
              "similarity_score double, speed string, accuracy_potential string, interpretability string"
    ).withColumn("strengths", F.array().cast("array<string>")).withColumn(
        "weaknesses", F.array().cast("array<string>")).withColumn("explainability", F.lit(None).cast("string"))


def test_roles(spark):
    rows = {r["role"]: (r["id"], r["reasoning"]) for r in recommend.roles(rankings(spark)).collect()}
    assert set(rows) == {"recommended", "fastest"}
    assert rows["recommended"] == (
        "rf", "RF leads the ranking with 0.900 points for likeness to this table and for what the checks left.")
    assert rows["fastest"][0] == "lr"


def test_proposed_assignments(spark):
    body = json.dumps({"assignments": [
        {"id": "nope", "role": "recommended"}, {"id": "lr", "role": "king"},
        {"id": "lr", "role": "recommended", "reasoning": "good"}, {"id": "rf", "role": "recommended"}]})
    texts = [body, f"Sure!\n```json\n{body}\n```", f"I think {body} is right", "no idea", None]
    answers = spark.createDataFrame([("s", t) for t in texts], "session_id string, response string")
    read = recommend.extract_assignments(answers)
    assert read.where("size(assignments) = 4").count() == 3
    assert read.where("assignments is null").count() == 2
    valid = recommend.valid_assignments(read.limit(1), rankings(spark)).collect()
    assert [(r["id"], r["role"], r["reasoning"]) for r in valid] == [("lr", "recommended", "good")]
    mixed = recommend.assignments(rankings(spark), read.limit(1))
    final = {r["id"]: r["role"] for r in recommend.recommendations(rankings(spark), mixed).collect()}
    assert final == {"lr": "recommended", "rf": "candidate"}
    unread = recommend.assignments(rankings(spark), read.where("assignments is null").limit(1))
    assert {r["role"] for r in unread.collect()} == {"recommended", "fastest"}


def test_knowledge(spark):
    rows = kb.algorithms(spark).collect()
    assert len(rows) == 37 and len({r["id"] for r in rows}) == 37
    names = {r["id"] for r in rows}
    for r in rows:
        assert r["speed"] in ("fast", "medium", "slow") and r["description"] and r["name"]
        assert r["accuracy_potential"] in ("low", "medium", "high", "very_high")
        assert r["interpretability"] in ("high", "medium", "low") and r["family"] in kb.FAMILIES
    assert {t[0] for t in kb.TEMPLATES} == {t[0] for t in kb.RELATIONS} == names
    assert set(kb.GRIDS) <= names
    assert {x for t in kb.RELATIONS for x in t[1:] if x} <= names
    assert kb.templates(spark).count() == kb.relations(spark).count() == kb.grids(spark).count() == 37


def test_steps_for_every_algorithm(spark):
    chosen = kb.algorithms(spark).select(F.lit("s").alias("session_id"), "id", F.lit(0.1).alias("missing_ratio"),
                                         F.lit(1).alias("categorical_count"))
    extra = spark.createDataFrame([("s", "new_one", 0.1, 1)], "session_id string, id string, missing_ratio double, categorical_count int")
    steps = {}
    for r in recommend.preprocessing_steps(chosen.unionByName(extra)).orderBy("id", "position").collect():
        steps.setdefault(r["id"], []).append(r["component"])
    assert steps["svm_classifier"] == ["SimpleImputer", "OneHotEncoder", "StandardScaler", "PCA"]
    assert steps["lstm"] == ["Forward Fill (df.ffill())", "LabelEncoder / OrdinalEncoder", "MinMaxScaler"]
    assert steps["new_one"] == ["SimpleImputer", "OneHotEncoder", "StandardScaler"]
    assert "catboost_classifier" not in steps and len(steps) == 36
    assert recommend.related(chosen).where("id = 'kmeans'").first()["upgrade_name"] == "Gaussian Mixture"


def test_whole_recommendation(spark, people):
    rows = recommend.recommend(profile_row(people, "people", "gender")).orderBy("rank").collect()
    assert 1 <= len(rows) <= 8 and [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    assert sum(r["is_primary"] for r in rows) == 1 and rows[0]["role"] == "recommended"
    confidence = recommend.preprocessing_confidence(profile(spark, missing_ratio=0.5, outlier_ratio=0.2)).first()
    assert confidence["preprocessing_confidence"] == pytest.approx(0.89)


def test_questions(people):
    assert recommend.topic_of("Which MODEL should I use?") == "model"
    assert recommend.topic_of("health of my data") == "quality"
    assert recommend.topic_of("hello") == "summary"
    assert recommend.answer(people, "null cells").count() == 2
    assert recommend.answer(people, "any iqr?").columns[0] == "column"
    assert recommend.answer(people, "quality").first()["score"] <= 90
    assert recommend.answer(people, "hi").first()["rows"] == 100


@pytest.mark.parametrize("algorithm", [a for a in training.TRAINABLE])
def test_every_trainable_algorithm(spark, algorithm):
    df = spark.range(240).select(
        F.col("id").alias("at"), (F.rand(1) * 10).alias("x"), F.randn(2).alias("z"),
        F.when(F.col("id") % 7 != 0, F.rand(3)).alias("gap"),
        F.element_at(F.array(*[F.lit(c) for c in "abc"]), (F.col("id") % 3 + 1).cast("int")).alias("kind"),
    ).withColumn("y", F.col("x") * 2 + F.col("z") + 1.5).withColumn("label2", (F.col("x") > 5).cast("string"))
    category = training.CATEGORY[algorithm]
    target = {"classification": "label2", "regression": "y", "time_series": "y", "survival_analysis": "y"}.get(category)
    data = df.drop("label2") if category != "classification" else df.drop("y")
    if category == "survival_analysis":
        data = data.where("y > 0")
    order = ["at"] if category == "time_series" else None
    trained = training.train(data.drop("at") if order is None else data, algorithm, target, rounds=3, trees=3, order_by=order)
    metrics = {(r["metric"], r["class"]): r["value"] for r in trained.metrics.collect()}
    if category == "classification":
        assert metrics["accuracy", None] > 0.7
    elif category == "regression":
        assert metrics["r2", None] > 0.3
    else:
        assert metrics


def test_untrainable(spark, people):
    with pytest.raises(StepError):
        training.train(people, "tsne")
    with pytest.raises(StepError):
        training.train(people, "linear_regression")


def test_split_is_stable(people):
    train, test = training.split(people)
    assert train.count() + test.count() == 100 and 5 <= test.count() <= 35
    assert training.split(people.repartition(5))[1].exceptAll(test).count() == 0


def test_parameter_grid(spark):
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier

    assert len(training.parameter_grid("logistic_regression", LogisticRegression())) == 4
    assert len(training.parameter_grid("random_forest_classifier", RandomForestClassifier())) == 27


def test_tuning(spark):
    df = spark.range(120).select((F.rand(1) * 10).alias("x"), F.randn(2).alias("z")).withColumn(
        "label", (F.col("x") > 5).cast("double"))
    ready = training.preparation(df.drop("label"), "logistic_regression").fit(df).transform(df)
    best = training.tune(ready, "logistic_regression", folds=2)
    assert len(best.avgMetrics) == 4 and max(best.avgMetrics) > 0.8


def test_texts_are_encoded_as_the_template_says(spark):
    rows = [(float(i), f"value {i:04d}", "ab"[i % 2]) for i in range(600)]
    df = spark.createDataFrame(rows, "x double, many string, few string")
    asked = spark.createDataFrame([(1.0, "value 0007", "b"), (1.0, "new", None)], df.schema)
    flags = training.preparation(df, "ridge_regression").fit(df)
    seen = [r["features"] for r in flags.transform(df).select("features").collect()]
    assert {v.size for v in seen} == {603} and len({tuple(v.toArray()[1:601]) for v in seen}) == 600
    known, unknown = [r["features"] for r in flags.transform(asked).orderBy(F.col("few").asc_nulls_last()).collect()]
    assert known[1 + 7] == known[602] == 1 and known.toArray()[1:].sum() == 2 and unknown.toArray()[1:].sum() == 0
    codes = training.preparation(df, "random_forest_classifier").fit(df)
    assert sorted(r["features"][1] for r in codes.transform(df).collect()) == list(range(600))
    assert sorted(list(r["features"])[1:] for r in codes.transform(asked).collect()) == [[-1, -1], [7, 1]]
    hashed = training.preparation(df, "ridge_regression", text_slots=64).fit(df).transform(df).first()["features"]
    assert hashed.size == 65


def test_any_number_of_classes(spark):
    df = spark.range(20_010).select((F.col("id") % 10_005).cast("string").alias("y"), F.rand(1).alias("x"), F.col("id").alias("i"))
    with pytest.raises(StepError, match="more than 10000"):
        training.train(df, "naive_bayes", "y", most_classes=10_000)
    trained = training.train(df, "naive_bayes", "y")
    place = {y: i for i, y in enumerate(sorted(str(i) for i in range(10_005)))}
    found = trained.predictions.select("y", "label").distinct().collect()
    assert len(found) > 1000 and all(place[r["y"]] == r["label"] for r in found)


def test_labels_keep_their_text_order(spark):
    df = spark.createDataFrame([("cab"[i % 3], float(i % 3), float(i)) for i in range(90)], "y string, x double, i double")
    found = training.train(df, "decision_tree_classifier", "y").predictions.select("y", "label", "prediction").distinct().collect()
    assert sorted((r["y"], r["label"], r["prediction"]) for r in found) == [("a", 0, 0), ("b", 1, 1), ("c", 2, 2)]


def test_json_inside_texts():
    from brightloom.functions.json_text import find_object

    plain = '{"assignments": [{"reasoning": "ends ]} {not} \\" here"}]}'
    wanted = [{"reasoning": 'ends ]} {not} " here'}]
    for text in (plain, f"```json\n{plain}\n```", f"so {{x}} and {{\"a\": 1}} then {plain} {{", f'{{"answer": [{{"deep": {plain}}}]}}', f"}}{plain}]"):
        assert json.loads(find_object(text, "assignments"))["assignments"] == wanted
    for text in ("", "none", '{"assignments": 3}', '{"assignments": [', "{" * 3000, '"assignments"'):
        assert find_object(text, "assignments") is None
