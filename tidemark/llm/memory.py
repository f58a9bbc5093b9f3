"""Memory of Python workers: a worker outlives its task, and keeps what the task once took. And of the driver, which keeps what jobs left until it collects its garbage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

from pyspark.sql import SparkSession


def give_back() -> None:
    """Return freed memory of this process to the system (a no-op where the C library cannot)."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def tidy(rows: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``rows`` over batches, with what it freed given back when a task ends."""

    @wraps(rows)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from rows(batches)
        finally:
            give_back()

    return run


def release(spark: SparkSession) -> None:
    """Let the driver drop what no table refers to any more: plans, and broadcasts and shuffles of jobs that are done.

    Spark's cleaner waits for a collection of the driver's garbage, which comes late where a
    method runs many small jobs; until then the heap grows.
    """
    give_back()
    spark.sparkContext._jvm.System.gc()
