"""A frozen recipe on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from brightloom.errors import StepError
from brightloom.plans.recipe import FittedRecipe

ROW_WISE = ("missing", "outliers", "column_drop", "column_rename", "column_cast",
            "column_encode", "scaling")


def transform_stream(stream: DataFrame, fitted: FittedRecipe, event_time: str | None = None,
                     delay: str = "10 minutes") -> DataFrame:
    """Apply frozen steps to a streaming table.

    All steps but two work row by row. Duplicate removal keeps the first copy within
    ``delay`` of ``event_time``; forward fill needs a finished order and is refused.
    """
    df = stream
    for step in fitted.steps:
        if step.type == "duplicates":
            if event_time is None or step.state["keep"] != "first":
                raise StepError("duplicates", "a stream needs event_time and keep='first'")
            names = [c for c in df.columns if c not in set(step.state["order_by"] or [])]
            df = df.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(names)
        elif step.type in ROW_WISE and step.state.get("strategy") != "ffill":
            df = step.transform(df)
        else:
            raise StepError(step.type, "not available on a stream")
    return df
