"""Recipes: recorded steps that can be replayed, undone, frozen, saved and loaded.

``Recipe.apply`` refits every step on the table as it stands after the steps before
it. ``Recipe.fit`` freezes the fitted values for use on other tables or streams.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brightloom.errors import BrightloomError, StepError
from brightloom.functions.columns import col, require
from brightloom.functions.runtime import materialise, read_text, write_text
from brightloom.operators import columns, duplicates, encoding, missing, outliers, scaling

FITS_BEFORE_CUT = 8     # fitted steps after which the plan is cut once


@dataclass
class Step:
    """One recorded operation."""

    type: str
    params: dict = field(default_factory=dict)
    description: str = ""
    created_at: str = ""

    def __post_init__(self):
        self.description = self.description or describe(self.type, self.params)
        self.created_at = self.created_at or datetime.now(timezone.utc).isoformat()

    def fit(self, df: DataFrame) -> FittedStep:
        kind = _kind(self.type)
        return FittedStep(self.type, kind.fit(df, **self.params))

    def affected(self, df: DataFrame) -> int:
        """Rows the step touches (for column steps: all rows)."""
        return _kind(self.type).affected(df, **self.params)

    def as_dict(self) -> dict:
        return {"type": self.type, "params": self.params, "description": self.description,
                "created_at": self.created_at}


@dataclass
class FittedStep:
    """A step with everything it learnt from the table it was fitted on."""

    type: str
    state: dict

    def transform(self, df: DataFrame) -> DataFrame:
        return _kind(self.type).transform(df, self.state)


@dataclass(frozen=True)
class _Kind:
    fit: Callable
    transform: Callable
    affected: Callable
    runs_job: bool = True


def _all_rows(df, **_):
    return df.count()


# -- duplicates
def _dup_fit(df, keep="first", order_by=None):
    require(df, order_by or [])
    if keep not in duplicates.KEEP:
        raise StepError("duplicates", f"keep must be one of {duplicates.KEEP}")
    return {"keep": keep, "order_by": order_by}


def _dup_affected(df, keep="first", order_by=None):
    counts = duplicates.detect(df, order_by).first()
    if keep != "none":
        return counts["duplicate_rows"]
    return counts["total_rows"] - duplicates.remove(df, "none", order_by).count()


# -- missing values
def _missing_fit(df, column, strategy, constant_value=None, order_by=None, partition_by=()):
    require(df, [column])
    if strategy == "ffill":
        return {"column": column, "strategy": strategy, "value": None,
                "order_by": list(order_by or []), "partition_by": list(partition_by)}
    value = missing.fill_value(df, column, strategy, constant_value)
    return {"column": column, "strategy": strategy, "value": value}


def _missing_transform(df, state):
    require(df, [state["column"]])
    if state["strategy"] == "ffill":
        return missing.forward_fill(df, [state["column"]], state["order_by"], state["partition_by"])
    if state["strategy"] == "drop":
        return missing.drop_missing(df, state["column"])
    return missing.fill(df, state["column"], state["value"])


def _missing_affected(df, column, **_):
    return df.where(col(column).isNull()).count()


# -- outliers
def _outlier_affected(df, column, method="iqr", action="remove", **rest):
    state = outliers.fit(df, column, method, "cap", **rest)
    return df.where(outliers.outlier_mask(state)).count()


# -- columns
def _cast_fit(df, column, new_dtype, null_text=None):
    if new_dtype.lower() != "string":
        columns.require_castable(df, column, new_dtype)
    return {"column": column, "new_dtype": new_dtype, "null_text": null_text}


def _encode_fit(df, column, method, max_categories=None):
    if method == "onehot":
        return {"column": column, "method": method,
                "values": encoding.onehot_values(df, column, max_categories)}
    if method not in ("label", "ordinal"):
        raise StepError("encoding", f"unknown method '{method}'")
    codes = encoding.code_map(df, column)
    plain = codes.as_dict()
    return {"column": column, "method": method, "codes": codes if plain is None else plain}


def _encode_transform(df, state):
    require(df, [state["column"]])
    if state["method"] == "onehot":
        return encoding.onehot_encode(df, state["column"], state["values"])
    codes = state["codes"]
    if isinstance(codes, dict):
        codes = encoding.CodeMap.of(df.sparkSession, codes)
    apply = encoding.label_encode if state["method"] == "label" else encoding.ordinal_encode
    return apply(df, state["column"], codes)


KINDS: dict[str, _Kind] = {
    "duplicates": _Kind(
        _dup_fit, lambda df, s: duplicates.remove(df, s["keep"], s["order_by"]), _dup_affected, False
    ),
    "missing": _Kind(_missing_fit, _missing_transform, _missing_affected),
    "outliers": _Kind(outliers.fit, outliers.transform, _outlier_affected),
    "column_drop": _Kind(
        lambda df, columns: require(df, columns) or {"columns": list(columns)},
        lambda df, s: columns.drop(df, s["columns"]), _all_rows, False,
    ),
    "column_rename": _Kind(
        lambda df, old_name, new_name: {"old_name": old_name, "new_name": new_name},
        lambda df, s: columns.rename(df, s["old_name"], s["new_name"]), _all_rows, False,
    ),
    "column_cast": _Kind(
        _cast_fit,
        lambda df, s: columns.cast_unchecked(df, s["column"], s["new_dtype"], s["null_text"]),
        _all_rows,
    ),
    "column_encode": _Kind(_encode_fit, _encode_transform, _all_rows),
    "scaling": _Kind(scaling.fit, scaling.transform, _all_rows),
}


def _kind(name: str) -> _Kind:
    if name not in KINDS:
        raise StepError(name, "unknown step type")
    return KINDS[name]


def describe(step_type: str, params: dict) -> str:
    p = params
    names = ", ".join(p.get("columns", []))
    if step_type == "missing" and p.get("strategy") == "drop":
        return f"rows without '{p.get('column')}' removed"
    texts = {
        "duplicates": lambda: f"duplicate rows removed, {p.get('keep', 'first')} kept",
        "missing": lambda: f"gaps in '{p.get('column')}' filled by {p.get('strategy')}",
        "outliers": lambda: f"outliers of '{p.get('column')}' by {p.get('method', 'iqr')}: {p.get('action', 'remove')}",
        "column_drop": lambda: f"without {names}",
        "column_rename": lambda: f"'{p.get('old_name')}' is now '{p.get('new_name')}'",
        "column_cast": lambda: f"'{p.get('column')}' as {p.get('new_dtype')}",
        "column_encode": lambda: f"'{p.get('column')}' encoded by {p.get('method')}",
        "scaling": lambda: f"{p.get('method', 'standard')} scaling of {names}",
    }
    if step_type in texts:
        return texts[step_type]()
    return step_type


class Recipe:
    """An ordered list of steps. Recipes are values: every change makes a new one."""

    def __init__(self, steps: list[Step] | None = None):
        self.steps = list(steps or [])

    def then(self, step_type: str, **params) -> Recipe:
        _kind(step_type)
        return Recipe([*self.steps, Step(step_type, params)])

    def undo(self) -> Recipe:
        """The recipe without its last step."""
        if not self.steps:
            raise StepError("undo", "there is no step to undo")
        return Recipe(self.steps[:-1])

    # -- running
    def fit(self, df: DataFrame) -> FittedRecipe:
        return FittedRecipe([fitted for fitted, _ in self._run(df)])

    def apply(self, df: DataFrame) -> DataFrame:
        """Replay all steps on the original table, each refitted on what it meets."""
        for _, df in self._run(df):  # noqa: B020
            pass
        return df

    def _run(self, df: DataFrame, count: bool = False):
        """(fitted step, table after it) for each step; ``count``: every step's table is scanned once more."""
        fits = 0
        pending: list[Step] = []
        for i, step in enumerate(self.steps):
            if step.type == "column_rename":
                pending.append(step)
                continue
            yield from _renamed(df, pending)
            df, pending = _after_renames(df, pending), []
            try:
                fitted = step.fit(df)
                df = fitted.transform(df)
            except (BrightloomError, TypeError) as error:
                raise StepError(step.type, f"{step.params}: {error}") from error
            fits += _kind(step.type).runs_job
            # A step that shuffles the whole table is written once when later steps
            # scan its result for their fits; so is a long chain of fitted steps.
            scans = sum(_kind(s.type).runs_job + count for s in self.steps[i + 1:])
            if (_shuffles(step) and scans >= 2) or (fits >= FITS_BEFORE_CUT and scans):
                df, fits = materialise(df, "recipe"), 0
            yield fitted, df
        yield from _renamed(df, pending)

    def affected_rows(self, df: DataFrame) -> DataFrame:
        """step, type, affected_rows: how many rows each step touched.

        Each table is fitted once, and written where later steps would repeat a shuffle.
        """
        rows, before = [], df
        for i, (step, (_, after)) in enumerate(zip(self.steps, self._run(df, count=True)), 1):
            rows.append((i, step.type, step.affected(before)))
            before = after
        return df.sparkSession.createDataFrame(rows, "step int, type string, affected_rows long")

    # -- as data
    def history(self, spark: SparkSession) -> DataFrame:
        rows = [
            (i, s.type, json.dumps(s.params, sort_keys=True), s.description, s.created_at)
            for i, s in enumerate(self.steps, 1)
        ]
        return spark.createDataFrame(
            rows, "step int, type string, params string, description string, created_at string"
        ).withColumn("created_at", F.to_timestamp("created_at"))

    def to_json(self) -> str:
        return json.dumps({"version": 1, "steps": [s.as_dict() for s in self.steps]}, indent=2)

    @staticmethod
    def from_json(text: str) -> Recipe:
        return Recipe([Step(**s) for s in json.loads(text)["steps"]])

    def to_yaml(self) -> str:
        """YAML with one JSON value per parameter, so that it can be read back."""
        lines = ["version: 1", "steps:" if self.steps else "steps: []"]
        for i, s in enumerate(self.steps, 1):
            lines += [f"  - step: {i}", f"    type: {s.type}"]
            lines.append("    parameters:" if s.params else "    parameters: {}")
            lines += [f"      {json.dumps(k)}: {json.dumps(v)}" for k, v in s.params.items()]
        return "\n".join(lines) + "\n"

    @staticmethod
    def from_yaml(text: str) -> Recipe:
        """Read what ``to_yaml`` writes."""
        steps: list[Step] = []
        decode = json.JSONDecoder().raw_decode
        for line in text.splitlines():
            if line.startswith("    type: "):
                steps.append(Step(line.split(": ", 1)[1].strip()))
            elif line.startswith("      "):
                name, end = decode(line, 6)
                steps[-1].params[name] = json.loads(line[end:].lstrip(": "))
        return Recipe([Step(s.type, s.params) for s in steps])

    def save(self, spark: SparkSession, path: str) -> str:
        """Write the recipe to a folder ``path`` of any file system that Spark reaches."""
        return write_text(spark, path, self.to_yaml() if path.endswith((".yaml", ".yml")) else self.to_json())

    @staticmethod
    def load(spark: SparkSession, path: str) -> Recipe:
        text = read_text(spark, path)
        return Recipe.from_yaml(text) if path.endswith((".yaml", ".yml")) else Recipe.from_json(text)

    def __len__(self) -> int:
        return len(self.steps)


def _shuffles(step: Step) -> bool:
    return step.type == "duplicates" or step.params.get("strategy") == "ffill"


def _pairs(steps):
    return [(s.params["old_name"], s.params["new_name"]) for s in steps]


def _after_renames(df, steps):
    if not steps:
        return df
    try:
        return columns.rename_all(df, _pairs(steps))
    except BrightloomError as error:
        raise StepError("column_rename", str(error)) from error


def _renamed(df, steps):
    """Neighbouring renames run as one projection, however many there are."""
    if steps:
        after = _after_renames(df, steps)
        for step in steps:
            yield step.fit(df), after


class FittedRecipe:
    """A recipe with frozen values: no statistic is recomputed on new data."""

    def __init__(self, steps: list[FittedStep]):
        self.steps = steps

    def transform(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step.transform(df)
        return df

    def save(self, spark: SparkSession, folder: str) -> str:
        """The steps as JSON, and one Parquet table per code map too large for it."""
        folder, plain = folder.rstrip("/"), []
        for i, step in enumerate(self.steps):
            state = dict(step.state)
            if isinstance(state.get("codes"), encoding.CodeMap):
                codes = state["codes"]
                codes.table.write.mode("overwrite").parquet(f"{folder}/codes_{i}")
                state["codes"] = {"_table": f"codes_{i}", "rows": codes.rows,
                                  "chars": codes.chars, "total": codes.total}
            plain.append({"type": step.type, "state": state})
        write_text(spark, f"{folder}/steps.json", json.dumps(plain, default=str))
        return folder

    @staticmethod
    def load(spark: SparkSession, folder: str) -> FittedRecipe:
        folder = folder.rstrip("/")
        plain = json.loads(read_text(spark, f"{folder}/steps.json"))
        steps = []
        for entry in plain:
            codes = entry["state"].get("codes")
            if isinstance(codes, dict) and "_table" in codes:
                table = spark.read.parquet(f"{folder}/{codes['_table']}")
                entry["state"]["codes"] = encoding.CodeMap(
                    table, codes["rows"], codes["chars"], codes["total"]
                )
            steps.append(FittedStep(entry["type"], entry["state"]))
        return FittedRecipe(steps)
