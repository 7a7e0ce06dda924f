"""Helpers shared by the corpus operators: table access, durable cuts of lineage."""

from __future__ import annotations

import ctypes
import threading
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.storage import frozen, shared_folder, stored  # noqa: F401

#: The word separators of the contracts: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Seconds without a task after which a worker drops what it remembers.
IDLE = 15.0

_held: tuple = (None, None)
_timer: threading.Timer | None = None


def remembered(name: str, make: Callable):
    """What a Python worker remembers from task to task, of one operator at a time.

    Workers outlive queries. When another operator asks, what the last one kept is dropped, so
    the operators of a pipeline do not add up in a worker's memory; ``tidied`` drops it from workers that
    a stage without Python leaves idle.
    """
    global _held
    if _timer is not None:
        _timer.cancel()
    held, value = _held  # read at once: the timer may run out meanwhile
    if held != name:
        _held = (None, None)
        tidy()
        _held = name, value = name, make()
    return value


def _forget() -> None:
    global _held
    _held = (None, None)
    tidy()


def rest() -> None:
    """Ends a task: memory is given back, and the clock runs until the next one."""
    global _timer
    tidy()
    if _timer is not None:
        _timer.cancel()
    _timer = threading.Timer(IDLE, _forget)
    _timer.daemon = True
    _timer.start()


def tidy() -> None:
    """Gives memory that is free back to the system, where the allocators allow it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def tidied(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``work``, with its task's memory given back at the end, and what is ``remembered`` when no task follows soon."""

    def run(batches):
        yield from work(batches)
        rest()

    return run


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def crc_of_id(column: str = "doc_id"):
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
