"""Tasks that leave no memory behind in their Python worker, which later tasks and stages use again."""

from __future__ import annotations

import ctypes
import functools

import pyarrow as pa

from brightloom.functions.runtime import ship_by_value

ship_by_value(__name__)


def give_back() -> None:
    """Return freed memory to the system: Arrow's buffers, and the C library's where it can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):   # another C library
        pass


def lean(task):
    """A task (a generator function over batches) that gives its memory back when it ends."""

    @functools.wraps(task)
    def run(batches):
        try:
            yield from task(batches)
        finally:
            give_back()

    return run
