"""A JSON object inside a longer text."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from brightloom.functions.runtime import ship_by_value

ship_by_value(__name__)


def _holder(value, key: str):
    """The first object in a parsed value, itself included, whose ``key`` is a list."""
    waiting = [value]
    while waiting:
        at = waiting.pop()
        if isinstance(at, dict):
            if isinstance(at.get(key), list):
                return at
            waiting += reversed(list(at.values()))
        elif isinstance(at, list):
            waiting += reversed(at)
    return None


def find_object(text: str, key: str) -> str | None:
    """The first complete JSON object in ``text``, however deep, that has a list as ``key``.

    Read brace by brace with strings and escapes minded, so braces or ``]}`` inside a value end nothing. A brace that opens no
    JSON is passed over.
    """
    reader, at = json.JSONDecoder(), 0
    while (brace := re.compile("[{]").search(text, at)) is not None:
        try:
            value, at = reader.raw_decode(text, brace.start())
        except (ValueError, RecursionError):
            at = brace.end()
            continue
        found = _holder(value, key)
        if found is not None:
            return json.dumps(found)
    return None


def object_with(text: Column, key: str) -> Column:
    """``find_object`` for a column; texts that do not name the key are not read."""
    mark = json.dumps(key)

    @F.arrow_udf("string")
    def found(texts: pa.Array) -> pa.Array:
        return pa.array([find_object(t, key) if t is not None else None for t in texts.to_pylist()], pa.string())

    return found(F.when(text.contains(mark), text))
