"""Column names that do not clash with a caller's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it while ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def own(df: DataFrame) -> list:
    """The columns of ``df`` as they are, dots and backticks in names included."""
    return [F.col(quoted(c)) for c in df.columns]
