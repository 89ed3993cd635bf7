"""The table of modelling algorithms, with preprocessing, grids and relations."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

# Id, category, family, speed, accuracy potential, interpretability,
# fewest rows, most columns (None: any), handles imbalance, handles categorical values.
ALGORITHMS = (
    ("logistic_regression", "classification", "linear", "fast", "medium", "high", 50, None, True, False),
    ("decision_tree_classifier", "classification", "tree_ensemble", "fast", "medium", "high", 30, None, False, True),
    ("random_forest_classifier", "classification", "tree_ensemble", "medium", "high", "medium", 100, None, True, True),
    ("extra_trees_classifier", "classification", "tree_ensemble", "fast", "high", "medium", 100, None, True, True),
    ("xgboost_classifier", "classification", "boosting", "medium", "very_high", "low", 200, None, True, False),
    ("lightgbm_classifier", "classification", "boosting", "fast", "very_high", "low", 500, None, True, True),
    ("catboost_classifier", "classification", "boosting", "medium", "very_high", "low", 200, None, True, True),
    ("svm_classifier", "classification", "kernel", "slow", "high", "low", 50, 500, True, False),
    ("knn_classifier", "classification", "distance_based", "slow", "medium", "medium", 50, 100, False, False),
    ("naive_bayes", "classification", "bayesian", "fast", "low", "high", 20, None, False, True),
    ("mlp_classifier", "classification", "neural", "slow", "high", "low", 1000, None, False, False),
    ("adaboost_classifier", "classification", "boosting", "medium", "high", "medium", 100, None, False, False),
    ("gradient_boosting_classifier", "classification", "boosting", "slow", "high", "medium", 200, None, False, False),
    ("linear_regression", "regression", "linear", "fast", "low", "high", 30, 200, False, False),
    ("ridge_regression", "regression", "linear", "fast", "medium", "high", 30, None, False, False),
    ("lasso_regression", "regression", "linear", "fast", "medium", "high", 30, None, False, False),
    ("elasticnet_regression", "regression", "linear", "fast", "medium", "high", 30, None, False, False),
    ("random_forest_regressor", "regression", "tree_ensemble", "medium", "high", "medium", 100, None, False, True),
    ("xgboost_regressor", "regression", "boosting", "medium", "very_high", "low", 200, None, False, False),
    ("lightgbm_regressor", "regression", "boosting", "fast", "very_high", "low", 500, None, False, True),
    ("catboost_regressor", "regression", "boosting", "medium", "very_high", "low", 200, None, False, True),
    ("svr", "regression", "kernel", "slow", "high", "low", 50, 500, False, False),
    ("decision_tree_regressor", "regression", "tree_ensemble", "fast", "medium", "high", 30, None, False, True),
    ("gradient_boosting_regressor", "regression", "boosting", "slow", "high", "medium", 200, None, False, False),
    ("kmeans", "clustering", "distance_based", "fast", "medium", "medium", 50, None, False, False),
    ("dbscan", "clustering", "distance_based", "medium", "medium", "medium", 50, 50, False, False),
    ("hierarchical_clustering", "clustering", "distance_based", "slow", "medium", "high", 20, 100, False, False),
    ("gaussian_mixture", "clustering", "bayesian", "medium", "high", "medium", 100, 100, False, False),
    ("pca", "dimensionality_reduction", "linear", "fast", "medium", "medium", 20, None, False, False),
    ("umap", "dimensionality_reduction", "distance_based", "medium", "high", "low", 100, None, False, False),
    ("tsne", "dimensionality_reduction", "distance_based", "slow", "high", "low", 50, 500, False, False),
    ("arima", "time_series", "time_series", "medium", "medium", "high", 50, 10, False, False),
    ("prophet", "time_series", "time_series", "fast", "high", "high", 100, 20, False, False),
    ("xgboost_timeseries", "time_series", "boosting", "medium", "very_high", "low", 200, None, False, False),
    ("lstm", "time_series", "neural", "slow", "very_high", "low", 1000, None, False, False),
    ("cox_ph", "survival_analysis", "survival", "fast", "medium", "high", 50, 100, False, False),
    ("random_survival_forest", "survival_analysis", "survival", "medium", "high", "medium", 200, None, False, False),
)

# Display names that do not follow from the id.
NAMES = {
    "xgboost_classifier": "XGBoost Classifier", "lightgbm_classifier": "LightGBM Classifier",
    "catboost_classifier": "CatBoost Classifier", "svm_classifier": "Support Vector Classifier",
    "knn_classifier": "K-Nearest Neighbors Classifier", "mlp_classifier": "Multilayer Perceptron Classifier",
    "adaboost_classifier": "AdaBoost Classifier", "elasticnet_regression": "Elastic Net Regression",
    "xgboost_regressor": "XGBoost Regressor", "lightgbm_regressor": "LightGBM Regressor",
    "catboost_regressor": "CatBoost Regressor", "svr": "Support Vector Regression",
    "kmeans": "K-Means Clustering", "dbscan": "DBSCAN", "pca": "Principal Component Analysis",
    "umap": "UMAP", "tsne": "t-SNE", "arima": "ARIMA", "lstm": "LSTM Network",
    "xgboost_timeseries": "XGBoost on Lag Features", "cox_ph": "Cox Proportional Hazards",
}

# What each family is good and bad at, and how its models can be explained:
# Shapley values, feature importance, coefficients, partial dependence, permutation
# importance, local surrogates.
FAMILIES = {
    "linear": (["fast to train", "coefficients can be read"], ["misses nonlinear patterns"], (1, 0, 1, 1, 1, 1)),
    "tree_ensemble": (["nonlinear patterns", "no scaling needed"], ["large models", "can overfit"], (1, 1, 0, 1, 1, 1)),
    "boosting": (["very accurate on tables", "handles mixed features"], ["needs tuning", "hard to read"], (1, 1, 0, 1, 1, 1)),
    "distance_based": (["few assumptions", "simple idea"], ["sensitive to scaling", "weak in many dimensions"], (0, 0, 0, 0, 1, 1)),
    "kernel": (["strong on small clean data", "flexible borders"], ["slow on many rows", "needs scaling"], (0, 0, 0, 1, 1, 1)),
    "bayesian": (["probabilities", "works with few rows"], ["strong assumptions"], (0, 0, 0, 1, 1, 1)),
    "neural": (["complex patterns", "flexible"], ["needs many rows", "hard to read"], (1, 0, 0, 1, 1, 1)),
    "time_series": (["trend and season", "forecast intervals"], ["one series at a time"], (0, 0, 1, 0, 0, 0)),
    "survival": (["censored durations", "hazard estimates"], ["needs event times"], (0, 1, 1, 1, 1, 0)),
}

# One sentence per algorithm; the dataset description is compared with it.
DESCRIPTIONS = {
    "logistic_regression": "Linear classification model for numeric features on a small or medium-sized dataset with balanced or imbalanced classes.",
    "decision_tree_classifier": "Readable classification rules on mixed numeric and categorical features of a small dataset.",
    "random_forest_classifier": "Robust classification by many trees on a medium-sized or large tabular dataset with outlier and missing value noise.",
    "extra_trees_classifier": "Fast classification by random trees on a tabular dataset with noisy numeric features.",
    "xgboost_classifier": "Accurate boosted classification on a large tabular dataset with imbalanced classes and missing value gaps.",
    "lightgbm_classifier": "Fast boosted classification on a large dataset with many rows and high cardinality columns.",
    "catboost_classifier": "Boosted classification for categorical features and high cardinality columns without encoding.",
    "svm_classifier": "Margin classification on a small clean dataset with numeric features and a low outlier ratio.",
    "knn_classifier": "Classification by nearest neighbours on a small dataset with few scaled numeric features.",
    "naive_bayes": "Simple probabilistic classification for categorical features on a small dataset.",
    "mlp_classifier": "Neural classification of nonlinear numeric features on a large dataset with balanced classes.",
    "adaboost_classifier": "Boosted weak classification trees on a clean dataset with a low outlier ratio and balanced classes.",
    "gradient_boosting_classifier": "Boosted classification trees on a medium-sized tabular dataset.",
    "linear_regression": "Linear regression of a numeric target on few numeric features of a small dataset.",
    "ridge_regression": "Regularised linear regression for correlated numeric features.",
    "lasso_regression": "Sparse linear regression that selects among many numeric features.",
    "elasticnet_regression": "Mixed penalty linear regression for many correlated numeric features.",
    "random_forest_regressor": "Robust regression by many trees on a tabular dataset with outlier noise.",
    "xgboost_regressor": "Accurate boosted regression on a large tabular dataset with missing value gaps.",
    "lightgbm_regressor": "Fast boosted regression on a large dataset with many rows and high cardinality columns.",
    "catboost_regressor": "Boosted regression for categorical features and high cardinality columns without encoding.",
    "svr": "Margin regression on a small clean dataset with numeric features and a low outlier ratio.",
    "decision_tree_regressor": "Readable regression rules on mixed numeric and categorical features of a small dataset.",
    "gradient_boosting_regressor": "Boosted regression trees on a medium-sized tabular dataset.",
    "kmeans": "Clustering task for round groups of numeric features on a large dataset.",
    "dbscan": "Density clustering task for irregular groups with a high outlier ratio.",
    "hierarchical_clustering": "Clustering task with a tree of groups on a small dataset.",
    "gaussian_mixture": "Soft clustering task for overlapping groups on a medium-sized dataset.",
    "pca": "Linear dimensionality reduction of many correlated numeric features.",
    "umap": "Nonlinear dimensionality reduction that keeps neighbourhoods of a large dataset.",
    "tsne": "Dimensionality reduction to draw a small dataset in two dimensions.",
    "arima": "Time series forecast of one stationary numeric column.",
    "prophet": "Time series forecast with trend, season and missing value gaps.",
    "xgboost_timeseries": "Boosted time series forecast on lag features of a large dataset.",
    "lstm": "Neural time series forecast of long sequences on a large dataset.",
    "cox_ph": "Survival analysis task with proportional hazards on a small dataset.",
    "random_survival_forest": "Survival analysis task by many trees on a medium-sized dataset.",
}

# Id, scaling, encoding, imputation, feature selection.
TEMPLATES = (
    ("logistic_regression", "standard", "onehot", "median", None),
    ("decision_tree_classifier", None, "label", "median", None),
    ("random_forest_classifier", None, "label", "median", None),
    ("extra_trees_classifier", None, "label", "median", None),
    ("xgboost_classifier", None, "label", None, None),
    ("lightgbm_classifier", None, "label", None, None),
    ("catboost_classifier", None, None, None, None),
    ("svm_classifier", "standard", "onehot", "median", "pca"),
    ("knn_classifier", "standard", "onehot", "median", None),
    ("naive_bayes", None, "onehot", "median", None),
    ("mlp_classifier", "standard", "onehot", "median", None),
    ("adaboost_classifier", None, "label", "median", None),
    ("gradient_boosting_classifier", None, "label", "median", None),
    ("linear_regression", "standard", "onehot", "median", None),
    ("ridge_regression", "standard", "onehot", "median", None),
    ("lasso_regression", "standard", "onehot", "median", None),
    ("elasticnet_regression", "standard", "onehot", "median", None),
    ("random_forest_regressor", None, "label", "median", None),
    ("xgboost_regressor", None, "label", None, None),
    ("lightgbm_regressor", None, "label", None, None),
    ("catboost_regressor", None, None, None, None),
    ("svr", "standard", "onehot", "median", "pca"),
    ("decision_tree_regressor", None, "label", "median", None),
    ("gradient_boosting_regressor", None, "label", "median", None),
    ("kmeans", "standard", "onehot", "median", None),
    ("dbscan", "standard", "onehot", "median", "pca"),
    ("hierarchical_clustering", "standard", "onehot", "median", None),
    ("gaussian_mixture", "standard", "onehot", "median", None),
    ("pca", "standard", "onehot", "median", None),
    ("umap", "standard", "onehot", "median", None),
    ("tsne", "standard", "onehot", "median", "pca"),
    ("arima", None, None, "ffill", None),
    ("prophet", None, None, "ffill", None),
    ("xgboost_timeseries", None, "label", "ffill", None),
    ("lstm", "minmax", "label", "ffill", None),
    ("cox_ph", "standard", "onehot", "median", None),
    ("random_survival_forest", None, "label", "median", None),
)

# Id, upgrade, fast alternative, interpretable alternative, ensemble partner.
RELATIONS = (
    ("logistic_regression", "xgboost_classifier", "naive_bayes", None, "random_forest_classifier"),
    ("decision_tree_classifier", "random_forest_classifier", "naive_bayes", "logistic_regression", "adaboost_classifier"),
    ("random_forest_classifier", "xgboost_classifier", "extra_trees_classifier", "decision_tree_classifier", "logistic_regression"),
    ("extra_trees_classifier", "xgboost_classifier", None, "decision_tree_classifier", "logistic_regression"),
    ("xgboost_classifier", "lightgbm_classifier", "extra_trees_classifier", "random_forest_classifier", "logistic_regression"),
    ("lightgbm_classifier", "catboost_classifier", "xgboost_classifier", "random_forest_classifier", "logistic_regression"),
    ("catboost_classifier", None, "lightgbm_classifier", "random_forest_classifier", "logistic_regression"),
    ("svm_classifier", "xgboost_classifier", "logistic_regression", "decision_tree_classifier", "random_forest_classifier"),
    ("knn_classifier", "random_forest_classifier", "naive_bayes", "decision_tree_classifier", "logistic_regression"),
    ("naive_bayes", "logistic_regression", None, None, "random_forest_classifier"),
    ("mlp_classifier", "xgboost_classifier", "random_forest_classifier", "logistic_regression", "random_forest_classifier"),
    ("adaboost_classifier", "xgboost_classifier", "random_forest_classifier", "decision_tree_classifier", "logistic_regression"),
    ("gradient_boosting_classifier", "xgboost_classifier", "random_forest_classifier", "decision_tree_classifier", "logistic_regression"),
    ("linear_regression", "ridge_regression", None, None, "random_forest_regressor"),
    ("ridge_regression", "elasticnet_regression", "linear_regression", "linear_regression", "random_forest_regressor"),
    ("lasso_regression", "elasticnet_regression", "linear_regression", "linear_regression", "random_forest_regressor"),
    ("elasticnet_regression", "xgboost_regressor", "ridge_regression", "lasso_regression", "random_forest_regressor"),
    ("random_forest_regressor", "xgboost_regressor", "decision_tree_regressor", "decision_tree_regressor", "linear_regression"),
    ("xgboost_regressor", "lightgbm_regressor", "random_forest_regressor", "decision_tree_regressor", "linear_regression"),
    ("lightgbm_regressor", "catboost_regressor", "xgboost_regressor", "random_forest_regressor", "linear_regression"),
    ("catboost_regressor", None, "lightgbm_regressor", "random_forest_regressor", "linear_regression"),
    ("svr", "xgboost_regressor", "ridge_regression", "linear_regression", "random_forest_regressor"),
    ("decision_tree_regressor", "random_forest_regressor", "linear_regression", None, "linear_regression"),
    ("gradient_boosting_regressor", "xgboost_regressor", "random_forest_regressor", "decision_tree_regressor", "linear_regression"),
    ("kmeans", "gaussian_mixture", None, None, None),
    ("dbscan", "gaussian_mixture", "kmeans", "kmeans", None),
    ("hierarchical_clustering", "gaussian_mixture", "kmeans", "kmeans", None),
    ("gaussian_mixture", None, "kmeans", "kmeans", None),
    ("pca", "umap", None, None, None),
    ("umap", None, "pca", "pca", None),
    ("tsne", "umap", "pca", "pca", None),
    ("arima", "prophet", None, None, "xgboost_timeseries"),
    ("prophet", "xgboost_timeseries", "arima", "arima", None),
    ("xgboost_timeseries", "lstm", "prophet", "arima", None),
    ("lstm", None, "xgboost_timeseries", "arima", None),
    ("cox_ph", "random_survival_forest", None, None, None),
    ("random_survival_forest", None, "cox_ph", "cox_ph", None),
)

# The tuning grids; an id without an entry has none.
FOREST_GRID = {"n_estimators": [100, 300, 500], "max_depth": [5, 10, 20], "min_samples_split": [2, 5, 10]}
TREE_GRID = {"max_depth": [3, 5, 10, None], "min_samples_split": [2, 5, 10]}
XGBOOST_GRID = {"n_estimators": [100, 200], "learning_rate": [0.01, 0.05, 0.1], "max_depth": [3, 6, 9]}
LIGHTGBM_GRID = {"n_estimators": [100, 200], "learning_rate": [0.01, 0.05, 0.1], "num_leaves": [31, 63]}
CATBOOST_GRID = {"iterations": [100, 200], "learning_rate": [0.01, 0.05, 0.1], "depth": [4, 6, 8]}
MARGIN_GRID = {"C": [0.1, 1.0, 10.0], "kernel": ["rbf", "linear"]}
PENALTY_GRID = {"alpha": [0.01, 0.1, 1.0, 10.0]}
GRIDS = {
    "logistic_regression": {"C": [0.01, 0.1, 1.0, 10.0], "penalty": ["l2"], "solver": ["lbfgs", "liblinear"]},
    "decision_tree_classifier": TREE_GRID,
    "random_forest_classifier": FOREST_GRID,
    "extra_trees_classifier": FOREST_GRID,
    "xgboost_classifier": XGBOOST_GRID,
    "lightgbm_classifier": LIGHTGBM_GRID,
    "catboost_classifier": CATBOOST_GRID,
    "svm_classifier": MARGIN_GRID,
    "knn_classifier": {"n_neighbors": [3, 5, 7, 11], "weights": ["uniform", "distance"]},
    "ridge_regression": PENALTY_GRID,
    "lasso_regression": PENALTY_GRID,
    "elasticnet_regression": PENALTY_GRID,
    "random_forest_regressor": FOREST_GRID,
    "xgboost_regressor": XGBOOST_GRID,
    "lightgbm_regressor": LIGHTGBM_GRID,
    "catboost_regressor": CATBOOST_GRID,
    "svr": MARGIN_GRID,
    "decision_tree_regressor": TREE_GRID,
    "xgboost_timeseries": XGBOOST_GRID,
}

# Groups of ids whose score the table's shape moves.
MANY_COLUMNS_WEAK = ("knn_classifier", "svm_classifier", "svr", "dbscan", "hierarchical_clustering", "tsne")
MANY_COLUMNS_STRONG = (
    "lasso_regression", "elasticnet_regression", "pca", "umap",
    "random_forest_classifier", "random_forest_regressor", "xgboost_classifier", "xgboost_regressor",
    "lightgbm_classifier", "lightgbm_regressor",
)
CATEGORICAL_WEAK = (
    "svm_classifier", "svr", "knn_classifier", "mlp_classifier", "logistic_regression",
    "linear_regression", "ridge_regression", "lasso_regression", "elasticnet_regression",
)
CATEGORICAL_NATIVE = (
    "catboost_classifier", "catboost_regressor", "lightgbm_classifier", "lightgbm_regressor", "naive_bayes",
)
CATEGORICAL_TREES = (
    "decision_tree_classifier", "decision_tree_regressor", "random_forest_classifier",
    "random_forest_regressor", "extra_trees_classifier", "xgboost_classifier", "xgboost_regressor",
    "gradient_boosting_classifier", "gradient_boosting_regressor", "adaboost_classifier",
)
CATEGORIES = (
    "classification", "regression", "clustering", "dimensionality_reduction", "time_series",
    "survival_analysis",
)


def display_name(algorithm: str) -> str:
    return NAMES.get(algorithm, algorithm.replace("_", " ").title())


def algorithms(spark: SparkSession) -> DataFrame:
    """The 37 algorithms, one row each; ``position`` is their order."""
    rows = [
        (i, a[0], display_name(a[0]), a[1], a[2], DESCRIPTIONS[a[0]], *a[3:],
         FAMILIES[a[2]][0], FAMILIES[a[2]][1], tuple(bool(x) for x in FAMILIES[a[2]][2]))
        for i, a in enumerate(ALGORITHMS)
    ]
    return spark.createDataFrame(
        rows,
        "position int, id string, name string, category string, family string, description string, "
        "speed string, accuracy_potential string, interpretability string, min_samples long, "
        "max_features long, handles_imbalance boolean, handles_categorical boolean, "
        "strengths array<string>, weaknesses array<string>, explainability struct<"
        "shap_support: boolean, feature_importance: boolean, coefficients: boolean, "
        "supports_partial_dependence: boolean, supports_permutation_importance: boolean, "
        "supports_lime: boolean>",
    )


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(TEMPLATES), "id string, scaling string, encoding string, imputer string, feature_selection string"
    )


def relations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(RELATIONS),
        "id string, upgrade string, fast_alternative string, interpretable_alternative string, "
        "ensemble_partner string",
    )


def grids(spark: SparkSession) -> DataFrame:
    rows = [(a[0], json.dumps(GRIDS.get(a[0], {}))) for a in ALGORITHMS]
    return spark.createDataFrame(rows, "id string, grid string")
