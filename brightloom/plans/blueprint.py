"""A Spark ML pipeline with the same grouping as a recipe's recorded steps."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml import feature as fe

from brightloom.plans.recipe import Recipe


def groups(recipe: Recipe) -> dict[str, dict | list]:
    """Which columns the recipe drops, imputes, scales and encodes, and how."""
    found: dict[str, dict | list] = {
        "dropped": [], "numeric_impute": {}, "categorical_impute": {}, "scaled": {},
        "onehot": [], "label": [],
    }
    for step in recipe.steps:
        p = step.params
        if step.type == "column_drop":
            found["dropped"] += p["columns"]
        elif step.type == "missing" and p["strategy"] in ("mean", "median"):
            found["numeric_impute"][p["column"]] = p["strategy"]
        elif step.type == "missing" and p["strategy"] in ("mode", "constant"):
            found["categorical_impute"][p["column"]] = p["strategy"]
        elif step.type == "scaling":
            found["scaled"].update({c: p.get("method", "standard") for c in p["columns"]})
        elif step.type == "column_encode":
            found["onehot" if p["method"] == "onehot" else "label"].append(p["column"])
    return found


SCALERS = {
    "standard": lambda i, o: fe.StandardScaler(inputCol=i, outputCol=o, withMean=True),
    "minmax": lambda i, o: fe.MinMaxScaler(inputCol=i, outputCol=o),
    "robust": lambda i, o: fe.RobustScaler(inputCol=i, outputCol=o, withCentering=True),
}


def blueprint(recipe: Recipe) -> Pipeline:
    """Impute, scale and encode each column the way the recipe recorded it.

    Results land in ``<column>_imputed``, ``_scaled``, ``_code`` and ``_onehot``; the
    input columns stay, and numeric inputs must be doubles.
    """
    found = groups(recipe)
    dropped = set(found["dropped"])
    stages, current = [], {}
    for strategy in ("mean", "median"):
        names = [c for c, s in found["numeric_impute"].items() if s == strategy and c not in dropped]
        if names:
            results = [f"{c}_imputed" for c in names]
            stages.append(fe.Imputer(strategy=strategy, inputCols=names, outputCols=results))
            current.update(zip(names, results))
    for c, method in found["scaled"].items():
        if c not in dropped:
            stages.append(fe.VectorAssembler(
                inputCols=[current.get(c, c)], outputCol=f"{c}_vector", handleInvalid="keep"))
            stages.append(SCALERS[method](f"{c}_vector", f"{c}_scaled"))
    texts = [c for c in [*found["label"], *found["onehot"]] if c not in dropped]
    if texts:
        stages.append(fe.StringIndexer(
            inputCols=texts, outputCols=[f"{c}_code" for c in texts],
            stringOrderType="alphabetAsc", handleInvalid="keep"))
    onehot = [c for c in found["onehot"] if c not in dropped]
    if onehot:
        stages.append(fe.OneHotEncoder(
            inputCols=[f"{c}_code" for c in onehot], outputCols=[f"{c}_onehot" for c in onehot],
            dropLast=False, handleInvalid="keep"))
    return Pipeline(stages=stages)
