"""What Python workers hold between tasks."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def trim() -> None:
    """Give freed memory back to the system, as far as Arrow's pool and the C library can."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def trimmed(run: Run) -> Run:
    """``run``, after which the worker holds what is still in use only.

    Spark keeps a worker for later tasks, of any stage, and allocators keep what a task has freed: beside the JVM, an idle
    worker would otherwise count with the peak of the heaviest task that it ever had.
    """

    @functools.wraps(run)
    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return then
