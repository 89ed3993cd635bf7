"""Train a recommended algorithm: preprocessing from its template, split, fit, evaluate.

Models without an exact counterpart run the nearest Spark one (see STAND_INS). An id
with no counterpart at all is refused by name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml import classification as cl
from pyspark.ml import clustering as cu
from pyspark.ml import evaluation as ev
from pyspark.ml import feature as fe
from pyspark.ml import regression as rg
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.errors import StepError
from brightloom.functions.columns import col, is_numeric, is_text, require
from brightloom.functions.runtime import materialise
from brightloom.models import target_codes
from brightloom.models.agglomerate import JoinedClusters
from brightloom.models.fourier import KernelMachine
from brightloom.models.neighbours import Neighbours
from brightloom.models.range_finder import RangePCA
from brightloom.models.survival import CoxHazards
from brightloom.operators.encoding import code_map
from brightloom.operators.missing import forward_fill
from brightloom.operators.missing import lags as lags_of
from brightloom.plans import knowledge as kb

SEED = 42
TASK_BYTES = 32 << 20   # of prepared rows that a task of an iterative fit keeps, about
TRAIN_SHARE = 0.8
KEPT_VARIANCE = 0.95

CATEGORY = {a[0]: a[1] for a in kb.ALGORITHMS}
TEMPLATE = {t[0]: t[1:] for t in kb.TEMPLATES}

STAND_INS = {
    "xgboost_classifier": "gradient-boosted trees", "lightgbm_classifier": "gradient-boosted trees",
    "catboost_classifier": "gradient-boosted trees on ordered target codes", "xgboost_regressor": "gradient-boosted trees",
    "lightgbm_regressor": "gradient-boosted trees", "catboost_regressor": "gradient-boosted trees on ordered target codes",
    "xgboost_timeseries": "gradient-boosted trees on lags",
}


def _model(algorithm: str, width: int, classes: int, rounds: int, trees: int):
    """The estimator with the fixed default settings of each algorithm."""
    binary = classes <= 2
    boosted_c = cl.GBTClassifier(maxIter=rounds, seed=SEED)
    boosted_r = rg.GBTRegressor(maxIter=rounds, seed=SEED)
    makers = {
        "logistic_regression": lambda: cl.LogisticRegression(maxIter=1000, regParam=0.0),
        "decision_tree_classifier": lambda: cl.DecisionTreeClassifier(seed=SEED),
        "random_forest_classifier": lambda: cl.RandomForestClassifier(numTrees=trees, seed=SEED),
        "xgboost_classifier": lambda: boosted_c if binary else _one_vs_rest(boosted_c),
        "lightgbm_classifier": lambda: boosted_c if binary else _one_vs_rest(boosted_c),
        "catboost_classifier": lambda: boosted_c if binary else _one_vs_rest(boosted_c),
        "gradient_boosting_classifier": lambda: boosted_c if binary else _one_vs_rest(boosted_c),
        "svm_classifier": lambda: KernelMachine(),
        "knn_classifier": lambda: Neighbours(k=5),
        "naive_bayes": lambda: cl.NaiveBayes(modelType="gaussian"),
        "mlp_classifier": lambda: cl.MultilayerPerceptronClassifier(
            layers=[width, 100, max(classes, 2)], maxIter=500, seed=SEED),
        "linear_regression": lambda: rg.LinearRegression(),
        "ridge_regression": lambda: rg.LinearRegression(regParam=1.0, elasticNetParam=0.0),
        "lasso_regression": lambda: rg.LinearRegression(regParam=1.0, elasticNetParam=1.0),
        "elasticnet_regression": lambda: rg.LinearRegression(regParam=1.0, elasticNetParam=0.5),
        "random_forest_regressor": lambda: rg.RandomForestRegressor(numTrees=trees, seed=SEED),
        "xgboost_regressor": lambda: boosted_r,
        "lightgbm_regressor": lambda: boosted_r,
        "catboost_regressor": lambda: boosted_r,
        "decision_tree_regressor": lambda: rg.DecisionTreeRegressor(seed=SEED),
        "gradient_boosting_regressor": lambda: boosted_r,
        "xgboost_timeseries": lambda: boosted_r,
        "kmeans": lambda: cu.KMeans(k=3, seed=SEED),
        "hierarchical_clustering": lambda: JoinedClusters(k=3),
        "gaussian_mixture": lambda: cu.GaussianMixture(k=3, seed=SEED),
        "pca": lambda: RangePCA(k=min(2, width), inputCol="features", outputCol="components"),
        "cox_ph": lambda: CoxHazards(),
    }
    if algorithm not in makers:
        raise StepError("train", f"'{algorithm}' has no Spark counterpart")
    return makers[algorithm]()


def _one_vs_rest(base):
    return cl.OneVsRest(classifier=base)


TRAINABLE = tuple(
    a[0] for a in kb.ALGORITHMS
    if a[0] not in ("extra_trees_classifier", "adaboost_classifier", "svr", "dbscan",
                    "umap", "tsne", "arima", "prophet", "lstm", "random_survival_forest")
)


@dataclass
class Trained:
    algorithm: str
    preparation: PipelineModel
    model: object
    metrics: DataFrame
    predictions: DataFrame


class TextCodes(Estimator):
    """Codes of text columns in text order, numbered in Spark on the rows of the fit; as flags, a sparse vector each.

    A value that the fit has not seen, and NULL, gets the code -1 or no flag.
    """

    def __init__(self, texts: list[str], flags: bool):
        super().__init__()
        self.texts, self.flags = texts, flags

    def _fit(self, df: DataFrame) -> Model:
        maps = {c: code_map(df, c) for c in self.texts}
        encoder = None
        if self.flags:
            # Its last category, for codes beyond the map, is dropped: such a value has no flag.
            last = df.sparkSession.createDataFrame(
                [tuple(float(max(m.rows, 1) - 1) for m in maps.values())],
                ", ".join(f"`{_code(i)}` double" for i in range(len(maps))))
            encoder = fe.OneHotEncoder(
                inputCols=last.columns, outputCols=encoded(self.texts, True), handleInvalid="keep").fit(last)
        return TextCodesModel(maps, encoder)


class TextCodesModel(Model):
    def __init__(self, maps: dict, encoder):
        super().__init__()
        self.maps, self.encoder = maps, encoder

    def _transform(self, df: DataFrame) -> DataFrame:
        for i, (c, codes) in enumerate(self.maps.items()):
            missing = -1 if self.encoder is None else max(codes.rows, 1)
            df = codes.apply(df, c, "_code")
            df = df.withColumn(_code(i), F.coalesce("_code", F.lit(missing)).cast("double")).drop("_code")
        return df if self.encoder is None else self.encoder.transform(df)


def _code(i: int) -> str:
    return f"text{i}__code"


def encoded(texts: list[str], flags: bool) -> list[str]:
    return [f"text{i}__flags" if flags else _code(i) for i in range(len(texts))]


def preparation(df: DataFrame, algorithm: str, skip: tuple[str, ...] = (), text_slots: int | None = None) -> Pipeline:
    """Imputation, encoding, scaling and PCA stages of the algorithm's template.

    The result column is ``features``. Text columns are encoded as the template says, by codes of the training rows.
    Flags are not scaled, so they stay sparse; codes are scaled like numbers. With ``text_slots`` the values of all text
    columns are hashed, with their column, to so many flags instead: nothing is fitted, and values may share a flag.
    """
    scaling, encoding, imputer, selection = TEMPLATE[algorithm]
    numbers = [f.name for f in df.schema if is_numeric(f.dataType) and f.name not in skip]
    texts = [f.name for f in df.schema if is_text(f.dataType) and f.name not in skip]
    stages, parts, flags = [], list(numbers), []
    if numbers and imputer in ("median", "mean"):
        filled = [f"{c}__filled" for c in numbers]
        stages.append(fe.Imputer(strategy=imputer, inputCols=numbers, outputCols=filled))
        parts = filled
    if texts and text_slots is not None:
        stages.append(fe.FeatureHasher(
            inputCols=texts, categoricalCols=texts, outputCol="texts__flags", numFeatures=text_slots))
        flags = ["texts__flags"]
    elif texts:
        stages.append(TextCodes(texts, encoding == "onehot"))
        if encoding == "onehot":
            flags = encoded(texts, True)
        else:
            parts = [*parts, *encoded(texts, False)]
    if not parts and not flags:
        raise StepError("train", "the table has no usable feature column")
    result = "features" if selection is None else "scaled"
    if scaling is not None and parts:
        stages.append(fe.VectorAssembler(inputCols=parts, outputCol="assembled", handleInvalid="keep"))
        if scaling == "standard":
            stages.append(fe.StandardScaler(inputCol="assembled", outputCol="numbers__scaled", withMean=True))
        else:
            stages.append(fe.MinMaxScaler(inputCol="assembled", outputCol="numbers__scaled"))
        parts = ["numbers__scaled"]
    stages.append(fe.VectorAssembler(inputCols=[*parts, *flags], outputCol=result, handleInvalid="keep"))
    return Pipeline(stages=stages)


class TargetCodesModel(Model):
    """Text columns replaced by what the target was for them on the training rows; one code a column, or one a class."""

    def __init__(self, texts: list[str], goals: list[tuple[str, object]], codes: list):
        super().__init__()
        self.texts, self.goals, self.codes = texts, goals, codes

    @staticmethod
    def fitted(rows: DataFrame, texts: list[str], classes: int) -> TargetCodesModel:
        """``classes`` of the column label, 0 for a number."""
        label = F.col("label")
        goals = [(f"__{k}", (label == k).cast("double")) for k in range(classes)] if classes > 2 else [("", label)]
        return TargetCodesModel(texts, goals, [target_codes.fit(rows.withColumn("_goal", g), texts, "_goal") for _, g in goals])

    def _named(self, df: DataFrame, suffix: str) -> DataFrame:
        return df.withColumnsRenamed({f"{c}__target": f"{c}__target{suffix}" for c in self.texts})

    def training(self, df: DataFrame) -> DataFrame:
        """The training rows, each coded by the rows before it."""
        keys = df.columns
        for (suffix, goal), codes in zip(self.goals, self.codes):
            df = self._named(target_codes.ordered(df.withColumn("_goal", goal), self.texts, "_goal", keys, codes), suffix).drop("_goal")
        return df.drop(*self.texts)

    def _transform(self, df: DataFrame) -> DataFrame:
        for (suffix, _), codes in zip(self.goals, self.codes):
            df = self._named(codes.transform(df), suffix)
        return df.drop(*self.texts)


def _typed(df: DataFrame, algorithm: str, skip) -> DataFrame:
    """Numbers as doubles; without an imputer a missing number becomes 0 for MLlib."""
    imputed = TEMPLATE[algorithm][2] in ("median", "mean")
    kept = []
    for f in df.schema:
        if f.name in skip:
            kept.append(col(f.name))
        elif is_numeric(f.dataType):
            value = col(f.name).cast("double")
            kept.append((value if imputed else F.coalesce(value, F.lit(0.0))).alias(f.name))
        elif is_text(f.dataType):
            kept.append(col(f.name))
    return df.select(*kept)


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """80/20 split by a seeded hash of the whole row: it does not move when tasks are rerun.

    Equal rows land on the same side, so no test row was seen in training.
    """
    place = F.pmod(F.xxhash64(F.lit(SEED), *[col(c) for c in df.columns]), F.lit(1000))
    cut = F.lit(int(TRAIN_SHARE * 1000))
    return df.where(place < cut), df.where(place >= cut)


def train(df: DataFrame, algorithm: str, target: str | None = None, rounds: int = 100,
          trees: int = 100, order_by: list[str] | None = None, partition_by: list[str] | None = None,
          censor: str | None = None, lags: int = 3, text_slots: int | None = None,
          most_classes: int | None = None) -> Trained:
    """Prepare, split, fit and evaluate one algorithm; returns models, metrics, predictions."""
    if algorithm not in CATEGORY:
        raise StepError("train", f"unknown algorithm '{algorithm}'")
    if algorithm not in TRAINABLE:
        raise StepError("train", f"'{algorithm}' has no Spark counterpart")
    category = CATEGORY[algorithm]
    if category in ("classification", "regression", "time_series", "survival_analysis"):
        if target is None:
            raise StepError("train", f"'{algorithm}' needs a target column")
        require(df, [target])
        df = df.where(col(target).isNotNull())
    if category == "time_series":
        df = _lag_features(df, target, order_by or [], partition_by or [], lags)

    skip, label = [], None
    if category == "classification":
        text = df.withColumn(target, col(target).cast("string"))
        label = code_map(text, target)
        if most_classes is not None and label.rows > most_classes:
            raise StepError("train", f"'{target}' has more than {most_classes} classes")
        known = {"ml_attr": {"type": "nominal", "name": "label", "num_vals": label.rows}}
        df = label.apply(text, target, "_code").withColumn("label", F.col("_code").cast("double")).drop("_code")
        df, skip = df.withMetadata("label", known), [target, "label"]
    elif target is not None and category != "clustering":
        df, skip = df.withColumn("label", col(target).cast("double")), [target, "label"]
    if category == "survival_analysis":
        require(df, [censor] if censor else [])
        df = df.withColumn("censor", col(censor).cast("double") if censor else F.lit(1.0))
        df = df.where(F.col("label") > 0)
        skip += ["censor"] + ([censor] if censor else [])
    skip += [c for c in (order_by or []) if c not in skip]

    ready = materialise(_typed(df, algorithm, skip), "ready")   # read by every fit of the preparation and by the evaluation
    supervised = category not in ("clustering", "dimensionality_reduction")
    train_rows, test_rows = split(ready) if supervised else (ready, ready)
    classes = label.rows if label is not None else 0
    texts = [f.name for f in ready.schema if is_text(f.dataType) and f.name not in skip]
    coded = None
    if algorithm.startswith("catboost") and texts and text_slots is None:
        coded = TargetCodesModel.fitted(train_rows, texts, classes)
        train_rows, test_rows = coded.training(train_rows), coded.transform(test_rows)
    prep = preparation(train_rows, algorithm, tuple(skip), text_slots).fit(train_rows)
    train_set, test_set = prep.transform(train_rows), prep.transform(test_rows)
    if TEMPLATE[algorithm][3] == "pca":
        pca = RangePCA(share=KEPT_VARIANCE).fit(train_set)
        prep = PipelineModel([*prep.stages, pca])
        train_set, test_set = pca.transform(train_set), pca.transform(test_set)
    prep = PipelineModel([coded, *prep.stages]) if coded else prep
    width = len(train_set.select("features").first()[0])
    estimator = _model(algorithm, width, classes, rounds, trees)
    model = estimator.fit(_spread(train_set, len(ready.columns)))
    predictions = model.transform(test_set)
    return Trained(algorithm, prep, model, _metrics(category, model, predictions, algorithm), predictions)


def _spread(rows: DataFrame, columns: int) -> DataFrame:
    """The rows in so many tasks that each holds a bounded part of them, as fits keep what their tasks have read.

    A vector holds at most about as many values as there were columns, as flags are sparse.
    """
    tasks = -(-rows.count() * (128 + 16 * columns) // TASK_BYTES)
    return rows.repartition(tasks) if tasks > rows.rdd.getNumPartitions() else rows


def _lag_features(df, target, order_by, partition_by, lags):
    if not order_by:
        raise StepError("train", "a time series needs order_by")
    filled = forward_fill(df, [target], order_by, partition_by)
    kept = filled.select(*[col(c) for c in dict.fromkeys([*order_by, *partition_by, target])])
    shifted = lags_of(kept, target, lags, order_by, partition_by)
    return shifted.where(F.col(f"lag_{lags}").isNotNull())


def _metrics(category: str, model, predictions: DataFrame, algorithm: str) -> DataFrame:
    spark = predictions.sparkSession
    rows: list[tuple[str, str | None, float]] = []
    if category == "classification":
        return _class_metrics(predictions, algorithm)
    elif category == "survival_analysis":
        rows.append(("log_likelihood", None, model.logLikelihood))
        rows += [("coefficient", str(i), float(b)) for i, b in enumerate(model.coefficients)]
    elif category in ("regression", "time_series"):
        for name in ("r2", "rmse"):
            evaluator = ev.RegressionEvaluator(metricName=name)
            rows.append((name, None, evaluator.evaluate(predictions)))
    elif category == "clustering":
        sizes = predictions.groupBy("prediction").agg(F.count(F.lit(1)).alias("n")).collect()
        rows += [("size", str(r["prediction"]), float(r["n"])) for r in sizes]
        if len(sizes) > 1:
            rows.append(("silhouette", None, ev.ClusteringEvaluator().evaluate(predictions)))
    else:
        for i, part in enumerate(model.explainedVariance):
            rows.append(("explained_variance", str(i), float(part)))
    rows = [(algorithm, m, c, None if math.isnan(v) else float(v)) for m, c, v in rows]
    return spark.createDataFrame(rows, "algorithm string, metric string, class string, value double")


def _class_metrics(predictions: DataFrame, algorithm: str) -> DataFrame:
    """Accuracy, and precision, recall, f1 and support of each class, however many there are."""
    hit = (F.col("label") == F.col("prediction")).cast("long")
    true = predictions.groupBy("label").agg(F.count("*").alias("support"), F.coalesce(F.sum(hit), F.lit(0)).alias("hits"))
    said = predictions.groupBy(F.col("prediction").alias("label")).agg(F.count("*").alias("said"))
    each = materialise(true.join(said, "label", "left"), "classes")
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    precision, recall = share(F.col("hits"), F.coalesce("said", F.lit(0))), share(F.col("hits"), F.col("support"))
    f1 = share(2 * precision * recall, precision + recall)
    kinds = {"precision": precision, "recall": recall, "f1": f1, "support": F.col("support").cast("double")}
    found = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in kinds.items()]))
    rows = each.select(F.col("label").cast("long").cast("string").alias("class"), found.alias("m")).select("m.metric", "class", "m.value")
    total = each.agg(F.lit("accuracy").alias("metric"), F.lit(None).cast("string").alias("class"), share(F.sum("hits"), F.sum("support")).alias("value"))
    return total.unionByName(rows).select(F.lit(algorithm).alias("algorithm"), "metric", "class", "value")


# Grid names and the Spark parameters they set.
PARAMETERS = {
    "C": ("regParam", lambda v: 1.0 / v), "alpha": ("regParam", lambda v: v),
    "max_depth": ("maxDepth", lambda v: 30 if v is None else min(v, 30)),
    "depth": ("maxDepth", lambda v: v), "min_samples_split": ("minInstancesPerNode", lambda v: max(1, v // 2)),
    "n_estimators": (None, lambda v: v), "iterations": ("maxIter", lambda v: v),
    "learning_rate": ("stepSize", lambda v: v),
    "num_leaves": ("maxDepth", lambda v: int(math.log2(v + 1))), "n_neighbors": ("k", lambda v: v),
}


def parameter_grid(algorithm: str, estimator) -> list[dict]:
    """The algorithm's tuning grid on a Spark estimator; values without a counterpart are left out."""
    builder = ParamGridBuilder()
    for name, values in kb.GRIDS.get(algorithm, {}).items():
        target, convert = PARAMETERS.get(name, (None, None))
        if estimator.hasParam(name):
            target, convert = name, lambda v: v
        if name == "n_estimators":
            target = "numTrees" if estimator.hasParam("numTrees") else "maxIter"
        if target and estimator.hasParam(target):
            builder = builder.addGrid(estimator.getParam(target), [convert(v) for v in values])
    return builder.build()


def tune(train_set: DataFrame, algorithm: str, folds: int = 3, grid: list[dict] | None = None):
    """Cross-validate the grid on a prepared table with ``features`` and ``label``."""
    classes = train_set.agg(F.count_distinct("label")).first()[0] if \
        CATEGORY[algorithm] == "classification" else 0
    width = len(train_set.select("features").first()[0])
    estimator = _model(algorithm, width, classes, 100, 100)
    evaluator = (
        ev.MulticlassClassificationEvaluator(metricName="accuracy")
        if CATEGORY[algorithm] == "classification" else ev.RegressionEvaluator(metricName="rmse")
    )
    grid = parameter_grid(algorithm, estimator) if grid is None else grid
    return CrossValidator(
        estimator=estimator, estimatorParamMaps=grid, evaluator=evaluator, numFolds=folds, seed=SEED
    ).fit(train_set)
