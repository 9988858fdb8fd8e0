"""Sending the package to executors that do not have it installed."""

from __future__ import annotations

import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parents[1]
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the job's Python files, once per Spark application.

    Functions then travel by name, so a reused Python worker keeps its caches
    (word memos, loaded vocabularies) from task to task.
    """
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    name = Path(tempfile.mkdtemp(prefix="llm-ship-")) / f"{PACKAGE.name}.zip"
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(PACKAGE.rglob("*.py")):
            out.write(source, source.relative_to(PACKAGE.parent))
    spark.sparkContext.addPyFile(str(name))
    _sent.add(app)


def release() -> None:
    """Give memory that a Python worker no longer needs back to the machine.

    Workers are reused, and what their allocators keep after a task would count
    against the next one's executor.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc only
        trim(0)


def worker(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over a task's batches that leaves no spare memory behind."""

    def tidy(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return tidy
