"""Suggest algorithms for dataset profiles: candidates, scores, ranking, roles, steps.

Every function takes and gives tables, so one run serves any number of profiles. The
knowledge table has 37 rows; it is always the broadcast side.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brightloom.errors import StepError
from brightloom.functions.json_text import object_with
from brightloom.functions.values import broadcast_if_small
from brightloom.operators import missing, outliers, quality
from brightloom.operators.profile import as_stats
from brightloom.plans import knowledge as kb

# Thresholds, score changes, weights.
IMBALANCE_BELOW, IMBALANCE_BOOST, IMBALANCE_PENALTY = 0.3, 0.15, -0.10
MANY_COLUMNS_ABOVE, MANY_COLUMNS_PENALTY, MANY_COLUMNS_BOOST = 0.5, -0.12, 0.10
CATEGORICAL_ABOVE = 0.4
NATIVE_BOOST, TREE_BOOST, ENCODED_PENALTY, HIGH_CARDINALITY_PENALTY = 0.15, 0.08, -0.10, -0.05
SIMILARITY_WEIGHT, FILTER_WEIGHT = 0.7, 0.3
TOP = 8
ROLES = ("recommended", "fastest", "best_accuracy_boost", "most_interpretable")
SPEED = {"fast": 3, "medium": 2, "slow": 1}
ACCURACY = {"very_high": 4, "high": 3, "medium": 2}
INTERPRETABILITY = {"high": 3, "medium": 2, "low": 1}

PROFILE_FACTS = (
    "session_id", "row_count", "column_count", "problem_type", "class_balance",
    "dimensionality_ratio", "categorical_ratio", "high_cardinality_columns", "missing_ratio",
    "outlier_ratio", "categorical_count", "feature_description",
)


# -- candidates ------------------------------------------------------------------
def candidates(profiles: DataFrame, algorithms: DataFrame | None = None) -> DataFrame:
    """Profile facts x algorithms that fit its problem type and size."""
    algorithms = kb.algorithms(profiles.sparkSession) if algorithms is None else algorithms
    known = F.col("problem_type").isin(*kb.CATEGORIES)
    every = F.array(*[F.lit(c) for c in kb.CATEGORIES])
    allowed = F.when(known, F.array("problem_type")).otherwise(every)
    facts = profiles.select(*PROFILE_FACTS, F.explode(allowed).alias("_category"))
    joined = facts.join(broadcast_if_small(algorithms), F.col("_category") == F.col("category"))
    fits = (F.col("min_samples") <= F.col("row_count")) & (
        F.col("max_features").isNull() | (F.col("max_features") >= F.col("column_count"))
    )
    return joined.where(fits).drop("_category")


def without_candidates(profiles: DataFrame, algorithms: DataFrame | None = None) -> DataFrame:
    """Profiles that no algorithm fits."""
    return profiles.join(
        candidates(profiles, algorithms).select("session_id").distinct(), "session_id", "left_anti"
    ).select("session_id", "problem_type", "row_count", "column_count")


# -- scores ----------------------------------------------------------------------
def imbalance_change() -> Column:
    return F.when(
        (F.col("problem_type") == "classification") & (F.col("class_balance") < IMBALANCE_BELOW),
        F.when(F.col("handles_imbalance"), IMBALANCE_BOOST).otherwise(IMBALANCE_PENALTY),
    ).otherwise(0.0)


def dimensionality_change() -> Column:
    return F.when(
        F.col("dimensionality_ratio") > MANY_COLUMNS_ABOVE,
        F.when(F.col("id").isin(*kb.MANY_COLUMNS_WEAK), MANY_COLUMNS_PENALTY)
        .when(F.col("id").isin(*kb.MANY_COLUMNS_STRONG), MANY_COLUMNS_BOOST)
        .otherwise(0.0),
    ).otherwise(0.0)


def categorical_change() -> Column:
    high = F.size("high_cardinality_columns") > 0
    return F.when(
        (F.col("categorical_ratio") > CATEGORICAL_ABOVE) | high,
        F.when(F.col("id").isin(*kb.CATEGORICAL_NATIVE), NATIVE_BOOST)
        .when(F.col("id").isin(*kb.CATEGORICAL_TREES), TREE_BOOST)
        .when(
            F.col("id").isin(*kb.CATEGORICAL_WEAK),
            F.when(high, ENCODED_PENALTY + HIGH_CARDINALITY_PENALTY).otherwise(ENCODED_PENALTY),
        )
        .otherwise(0.0),
    ).otherwise(0.0)


def with_filter_score(candidate_rows: DataFrame) -> DataFrame:
    return candidate_rows.withColumn(
        "filter_score", imbalance_change() + dimensionality_change() + categorical_change()
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two number arrays; 0 when one has no length."""
    def dot(x, y):
        pairs = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(pairs, F.lit(0.0), lambda total, p: total + p)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def _words(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, word, n) word counts of a text column."""
    words = F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit("([a-z0-9]+)"), 1))
    return df.select(F.col(key), words.alias("word")).groupBy(key, "word").agg(
        F.count(F.lit(1)).alias("n")
    )


def text_similarity(profiles: DataFrame, algorithms: DataFrame | None = None) -> DataFrame:
    """session_id, id, similarity: cosine of tf-idf word vectors, pairs sharing a word.

    Word weights come from the algorithm descriptions, so they do not depend on the
    profiles. The join is on the word; the broadcast side is the knowledge table.
    """
    algorithms = kb.algorithms(profiles.sparkSession) if algorithms is None else algorithms
    total = algorithms.count()
    entries = _words(algorithms, "id", "description")
    weights = entries.groupBy("word").agg(
        (F.log((F.lit(float(total)) + 1) / (F.count(F.lit(1)) + 1)) + 1).alias("idf")
    )
    unseen = math.log(total + 1) + 1
    entry = entries.join(weights, "word").select("id", "word", (F.col("n") * F.col("idf")).alias("w"))
    entry_size = entry.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("entry_size"))
    said = _words(profiles, "session_id", "feature_description").join(
        broadcast_if_small(weights), "word", "left"
    ).select("session_id", "word", (F.col("n") * F.coalesce("idf", F.lit(unseen))).alias("v"))
    said_size = said.groupBy("session_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("said_size"))
    dots = said.join(broadcast_if_small(entry), "word").groupBy("session_id", "id").agg(
        F.sum(F.col("v") * F.col("w")).alias("dot")
    )
    return dots.join(said_size, "session_id").join(broadcast_if_small(entry_size), "id").select(
        "session_id", "id",
        F.coalesce(
            F.try_divide(F.col("dot"), F.col("said_size") * F.col("entry_size")), F.lit(0.0)
        ).alias("similarity"),
    )


def with_scores(candidate_rows: DataFrame, similarity: DataFrame | None = None) -> DataFrame:
    """similarity_score and combined_score; an id without a vector has similarity 0.

    A profile without a description is ranked by its filter score alone.
    """
    scored = with_filter_score(candidate_rows)
    if similarity is None:
        profiles = candidate_rows.select("session_id", "feature_description").distinct()
        similarity = text_similarity(profiles)
    found = similarity.select("session_id", "id", F.col("similarity").alias("_similarity"))
    joined = scored.join(found, ["session_id", "id"], "left")
    silent = F.trim(F.coalesce("feature_description", F.lit(""))) == ""
    similar = F.when(silent, 0.5).otherwise(F.coalesce("_similarity", F.lit(0.0)))
    combined = F.when(silent, F.lit(0.5) + F.col("filter_score")).otherwise(
        SIMILARITY_WEIGHT * similar + FILTER_WEIGHT * (F.lit(0.5) + F.col("filter_score"))
    )
    return joined.withColumn("similarity_score", similar).withColumn(
        "combined_score", combined
    ).drop("_similarity")


def ranked(scored: DataFrame, top: int = TOP) -> DataFrame:
    """The best ``top`` algorithms per profile with their rank; ties keep table order."""
    best = W.partitionBy("session_id").orderBy(F.col("combined_score").desc(), "position")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


# -- roles -----------------------------------------------------------------------
def _order(column: Column, values: dict[str, int]) -> Column:
    return reduce(lambda e, kv: e.when(column == kv[0], kv[1]), list(values.items())[1:],
                  F.when(column == next(iter(values)), next(iter(values.values())))).otherwise(0)


def _preference(key: str | None):
    """Sort key: the strongest in ``key``, then the higher score, then the earlier rank."""
    def preference(x):
        strength = F.lit(0) if key is None else -x[key]
        return F.struct(strength.alias("k"), (-x["score"]).alias("s"), x["rank"].alias("rank"))
    return preference


def roles(rankings: DataFrame) -> DataFrame:
    """session_id, id, role, reasoning: one algorithm per role, each used once.

    A profile has at most eight ranked rows, so its choice is made inside one row of
    arrays rather than by four rounds of joins.
    """
    item = F.struct(
        F.col("rank"), F.col("id"), F.col("name"), F.col("combined_score").alias("score"),
        F.col("speed"), F.col("accuracy_potential").alias("accuracy"), F.col("interpretability"),
        _order(F.col("speed"), SPEED).alias("by_speed"),
        _order(F.col("accuracy_potential"), ACCURACY).alias("by_accuracy"),
        _order(F.col("interpretability"), INTERPRETABILITY).alias("by_clarity"),
    )
    chosen = rankings.groupBy("session_id").agg(F.array_sort(F.collect_list(item)).alias("left"))
    for role, key in zip(ROLES, (None, "by_speed", "by_accuracy", "by_clarity")):
        order = F.transform("left", _preference(key))
        chosen = chosen.withColumn("_best", F.array_min(order)["rank"])
        pick = F.get(F.filter("left", lambda x: x["rank"] == F.col("_best")), F.lit(0))
        chosen = chosen.withColumn(role, pick).withColumn(
            "left", F.filter("left", lambda x: x["rank"] != F.col("_best"))
        )
    text = {
        "recommended": lambda x: F.concat(
            x["name"], F.lit(" leads the ranking with "), F.format_string("%.3f", x["score"]),
            F.lit(" points for likeness to this table and for what the checks left.")),
        "fastest": lambda x: F.concat(
            F.lit("Of the others "), x["name"], F.lit(" trains quickest; its speed is "), x["speed"], F.lit(".")),
        "best_accuracy_boost": lambda x: F.concat(
            F.lit("If precision matters most, "), x["name"], F.lit(" may reach further: "), x["accuracy"], F.lit(".")),
        "most_interpretable": lambda x: F.concat(
            F.lit("How "), x["name"], F.lit(" decides can be followed; clarity is "), x["interpretability"], F.lit(".")),
    }
    assigned = F.array(*[
        F.struct(F.lit(r).alias("role"), F.col(r)["id"].alias("id"), text[r](F.col(r)).alias("reasoning"))
        for r in ROLES
    ])
    return chosen.select("session_id", F.explode(assigned).alias("a")).where(
        F.col("a.id").isNotNull()
    ).select("session_id", "a.id", "a.role", "a.reasoning")


ASSIGNMENT = T.ArrayType(T.StructType([
    T.StructField("id", T.StringType()), T.StructField("role", T.StringType()),
    T.StructField("reasoning", T.StringType()),
]))
ANSWER = T.StructType([T.StructField("assignments", ASSIGNMENT)])


def extract_assignments(answers: DataFrame, text: str = "response") -> DataFrame:
    """Read {"assignments": [...]} out of answer texts: bare, fenced, or embedded.

    Gives the input columns plus ``assignments``, NULL where nothing can be read.
    """
    found = object_with(F.col(text), "assignments")
    return answers.withColumn("assignments", F.from_json(found, ANSWER)["assignments"])


def valid_assignments(answers: DataFrame, rankings: DataFrame, places: bool = False) -> DataFrame:
    """Proposed roles that name a ranked algorithm and a known role, the first per role.

    ``places`` adds ``at``, the place in the answer, which decides between roles of one id.
    """
    rows = answers.select("session_id", F.posexplode("assignments").alias("at", "a")).select(
        "session_id", "at", "a.id", "a.role", F.coalesce("a.reasoning", F.lit("")).alias("reasoning")
    ).where(F.col("role").isin(*ROLES))
    known = rows.join(rankings.select("session_id", "id"), ["session_id", "id"], "left_semi")
    first = W.partitionBy("session_id", "role").orderBy("at")
    return known.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(
        "session_id", "id", "role", "reasoning", *(["at"] if places else [])
    )


def assignments(rankings: DataFrame, proposed: DataFrame | None = None) -> DataFrame:
    """Valid proposed roles; a profile without any gets the rule-based ones."""
    ruled = roles(rankings)
    if proposed is None:
        return ruled
    valid = valid_assignments(proposed, rankings, places=True)
    ruled = ruled.withColumn("at", _role_place())
    return valid.unionByName(ruled.join(valid, "session_id", "left_anti"))


def _role_place():
    return F.array_position(F.array(*[F.lit(r) for r in ROLES]), F.col("role")).cast("int")


def one_role(assigned: DataFrame) -> DataFrame:
    """One role per algorithm: of several the last in the answer, or the last of the rules."""
    place = F.col("at") if "at" in assigned.columns else _role_place()
    last = W.partitionBy("session_id", "id").orderBy(F.col("_place").desc(), _role_place().desc())
    return assigned.withColumn("_place", place).withColumn("_n", F.row_number().over(last)).where("_n = 1").select(
        "session_id", "id", "role", "reasoning")


# -- results -----------------------------------------------------------------------
def recommendations(rankings: DataFrame, assigned: DataFrame) -> DataFrame:
    """All ranked algorithms with role (default 'candidate'), reasoning and is_primary."""
    single = one_role(assigned)
    joined = rankings.join(single, ["session_id", "id"], "left")
    lead = W.partitionBy("session_id").orderBy(
        F.when(F.col("role") == "recommended", 0).otherwise(1), "rank"
    )
    return joined.withColumn("is_primary", F.row_number().over(lead) == 1).select(
        "session_id", "rank", "id", "name", "category",
        F.when(F.col("is_primary"), "recommended").otherwise(
            F.coalesce("role", F.lit("candidate"))).alias("role"),
        F.round("combined_score", 4).alias("confidence"),
        F.round("similarity_score", 4).alias("similarity_score"),
        F.coalesce("reasoning", F.lit("")).alias("reasoning"),
        "strengths", "weaknesses", "explainability", "is_primary",
    )


def _capitalised(column: Column) -> Column:
    return F.concat(F.upper(F.substring(column, 1, 1)), F.lower(F.substring(column, 2, 1000)))


def alternatives(rankings: DataFrame, assigned: DataFrame) -> DataFrame:
    """algorithm, role, speed, accuracy, interpretability, ..., confidence per ranked row."""
    joined = rankings.join(
        one_role(assigned).select("session_id", "id", "role"), ["session_id", "id"], "left"
    )
    return joined.select(
        "session_id", "rank", F.col("name").alias("algorithm"),
        F.coalesce("role", F.lit("candidate")).alias("role"),
        _capitalised(F.col("speed")).alias("speed"),
        _capitalised(F.replace("accuracy_potential", F.lit("_"), F.lit(" "))).alias("accuracy"),
        _capitalised(F.col("interpretability")).alias("interpretability"),
        "handles_categorical", "handles_imbalance",
        F.round("combined_score", 4).alias("confidence"),
    )


def preprocessing_confidence(profiles: DataFrame) -> DataFrame:
    score = F.round(
        F.lit(0.95) - F.col("missing_ratio") * 0.1 - F.col("outlier_ratio") * 0.05, 2
    )
    return profiles.select(
        "session_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("preprocessing_confidence")
    )


def preprocessing_steps(chosen: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """session_id, id, position, step, component, parameters (JSON) in running order.

    ``chosen`` needs session_id, id, missing_ratio and categorical_count. An id without
    a template gets the default steps.
    """
    templates = kb.templates(chosen.sparkSession) if templates is None else templates
    known = templates.withColumn("_known", F.lit(True))
    rows = chosen.select("session_id", "id", "missing_ratio", "categorical_count").join(
        broadcast_if_small(known), "id", "left"
    )

    def step(condition, name, component, parameters):
        return F.when(condition, F.struct(
            F.lit(name).alias("step"), F.lit(component).alias("component"),
            parameters.alias("parameters"),
        ))

    default = F.col("_known").isNull()
    onehot = F.lit('{"handle_unknown": "ignore", "sparse_output": false}')
    ordinal = F.lit('{"handle_unknown": "use_encoded_value", "unknown_value": -1}')
    none = F.lit("{}")
    imputer = F.coalesce("imputer", F.when(default & (F.col("missing_ratio") > 0), "median"))
    encoding = F.coalesce("encoding", F.when(default & (F.col("categorical_count") > 0), "onehot"))
    scaling = F.coalesce("scaling", F.when(default, "standard"))
    # The names of the steps' components, as they stand in exported blueprints.
    steps = F.array(
        step(imputer == "ffill", "imputation", "Forward Fill (df.ffill())", F.lit('{"method": "ffill"}')),
        step(imputer != "ffill", "imputation", "SimpleImputer",
             F.concat(F.lit('{"strategy": "'), imputer, F.lit('"}'))),
        step(encoding == "onehot", "encoding", "OneHotEncoder", onehot),
        step(encoding == "label", "encoding", "LabelEncoder / OrdinalEncoder", ordinal),
        step(scaling == "standard", "scaling", "StandardScaler", none),
        step(scaling == "minmax", "scaling", "MinMaxScaler", none),
        step(F.col("feature_selection") == "pca", "feature_selection", "PCA",
             F.lit('{"n_components": 0.95}')),
    )
    return rows.select(
        "session_id", "id", F.posexplode(F.array_compact(steps)).alias("position", "s")
    ).select("session_id", "id", "position", "s.step", "s.component", "s.parameters")


def related(chosen: DataFrame) -> DataFrame:
    """Upgrade, fast, interpretable and ensemble partners of each row's ``id``, by name."""
    spark = chosen.sparkSession
    names = kb.algorithms(spark).select("id", "name")
    rows = chosen.join(F.broadcast(kb.relations(spark)), "id", "left")
    for relation in ("upgrade", "fast_alternative", "interpretable_alternative", "ensemble_partner"):
        other = names.select(F.col("id").alias(relation), F.col("name").alias(f"{relation}_name"))
        rows = rows.join(F.broadcast(other), relation, "left")
    return rows


def recommend(profiles: DataFrame, proposed: DataFrame | None = None,
              similarity: DataFrame | None = None) -> DataFrame:
    """Ranked recommendations for every profile, from candidates to roles."""
    rankings = ranked(with_scores(candidates(profiles), similarity))
    return recommendations(rankings, assignments(rankings, proposed))


# -- questions ---------------------------------------------------------------------
# The words that lead to a topic, in order.
TOPICS = {
    "model": ("model", "algorithm", "train", "machine learning", "ml", "predict"),
    "quality": ("quality", "score", "issues", "problem", "warnings", "health"),
    "missing": ("missing", "null", "nan", "impute"),
    "outliers": ("outlier", "iqr", "zscore", "isolation"),
}


def topic_of(question: str) -> str:
    lowered = question.lower()
    for topic, words in TOPICS.items():
        if any(w in lowered for w in words):
            return topic
    return "summary"


def answer(table, question: str) -> DataFrame:
    """The table that answers a question about a table, chosen by its words."""
    stats = as_stats(table)
    topic = topic_of(question)
    if topic == "quality":
        return quality.quality_score(stats)
    if topic == "missing":
        return missing.recommend(stats)
    if topic == "outliers":
        return outliers.recommend(stats)
    targets = stats.target_candidates()
    spark = stats.df.sparkSession
    if topic == "model":
        if not targets:
            task, models = "clustering", ["kmeans"]
        elif stats.distinct[targets[0]] <= 10:
            task = "classification"
            models = ["random_forest_classifier", "xgboost_classifier", "logistic_regression"]
        else:
            task = "regression"
            models = ["random_forest_regressor", "xgboost_regressor", "ridge_regression"]
        target = targets[0] if targets else None
        return spark.createDataFrame(
            [(i, target, task, m) for i, m in enumerate(models, 1)],
            "position int, target string, task string, algorithm string",
        )
    score = quality.quality_score(stats).first()["score"]
    return spark.createDataFrame(
        [(stats.rows, len(stats.columns), len(stats.numeric), len(stats.categorical), score, targets)],
        "rows long, columns long, numerical long, categorical long, score int, targets array<string>",
    )


def checked(profiles: DataFrame) -> DataFrame:
    """The profiles, or an error naming the ones without any candidate."""
    lost = [r["session_id"] for r in without_candidates(profiles).limit(10).collect()]
    if lost:
        raise StepError("recommend", f"no algorithm fits the profiles {lost}")
    return profiles
