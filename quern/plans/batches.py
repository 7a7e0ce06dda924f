"""Rows of unlike sizes as Arrow batches of bounded bytes."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a batch, and bytes of its payload, at most (a larger row is a batch of its own).
ROWS, BYTES = 8192, 4 << 20


def batches(rows: Iterable[tuple], names: list[str], kinds: list[pa.DataType], payload: int) -> Iterator[pa.RecordBatch]:
    """``rows`` as batches; column number ``payload`` holds bytes or null."""
    held, size = [], 0
    for r in rows:
        n = len(r[payload] or b"")
        if held and (size + n > BYTES or len(held) >= ROWS):
            yield _batch(held, names, kinds)
            held, size = [], 0
        held.append(r)
        size += n
    if held:
        yield _batch(held, names, kinds)


def _batch(rows, names, kinds) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def cuts(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """[a, z) of the runs of neighbours that make batches."""
    a = total = 0
    for k, n in enumerate(sizes):
        if k > a and (total + n > BYTES or k - a >= ROWS):
            yield a, k
            a, total = k, 0
        total += n
    if sizes:
        yield a, len(sizes)


def pulled_longs(df: DataFrame) -> Iterator[int]:
    """The values of a one-column table of whole numbers, in its order, pulled to the driver partition by partition.

    Differences of neighbours travel, packed: of sorted keys a small part of what rows take. Nulls are left out.
    """

    def work(found):
        for b in found:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.diff(b.column(0).to_numpy(zero_copy_only=False), prepend=np.int64(0)).tobytes(), 1)], pa.binary())], ["packed"])

    own = F.col(f"`{df.columns[0]}`").cast("long")
    for r in df.where(own.isNotNull()).select(own).mapInArrow(work, "packed binary").toLocalIterator():
        yield from np.cumsum(np.frombuffer(zlib.decompress(r[0]), np.int64)).tolist()
