"""Errors raised before or while a step runs."""

from __future__ import annotations


class BrightloomError(Exception):
    """Base class of all errors raised here."""


class ColumnNotFound(BrightloomError):
    def __init__(self, column: str):
        self.column = column
        super().__init__(f"Column '{column}' is not in the table.")


class InvalidDtype(BrightloomError):
    def __init__(self, column: str, target: str, detail: str):
        self.column, self.target = column, target
        super().__init__(f"Column '{column}' cannot become '{target}': {detail}")


class EmptyDataset(BrightloomError):
    def __init__(self, what: str = "The table"):
        super().__init__(f"{what} has no rows.")


class StepError(BrightloomError):
    def __init__(self, step: str, detail: str):
        self.step = step
        super().__init__(f"Step '{step}' failed: {detail}")


class UnsupportedFileType(BrightloomError):
    def __init__(self, path: str, allowed):
        super().__init__(f"'{path}' is not one of the supported types {sorted(allowed)}.")
