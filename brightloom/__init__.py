"""Brightloom: table quality checks, preparation recipes and model suggestions on Spark.

Every statistic is a distributed aggregate, every change to a table is a lazy
DataFrame expression, and only small results (bounds, fill values, bin edges)
reach the driver.
"""

from brightloom.errors import (
    BrightloomError,
    ColumnNotFound,
    EmptyDataset,
    InvalidDtype,
    StepError,
    UnsupportedFileType,
)
from brightloom.plans.recipe import FittedRecipe, Recipe, Step

__all__ = [
    "BrightloomError",
    "ColumnNotFound",
    "EmptyDataset",
    "FittedRecipe",
    "InvalidDtype",
    "Recipe",
    "Step",
    "StepError",
    "UnsupportedFileType",
]
