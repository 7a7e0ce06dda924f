"""Prefix sums that no single task has to hold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quern.plans.storage import frozen


def _runs(keys: pa.Array) -> np.ndarray:
    """Where a run of equal keys begins, first row included; nulls are equal."""
    if pa.types.is_dictionary(keys.type):
        keys = keys.dictionary_decode()
    a, b = keys[1:], keys[:-1]
    same = pc.if_else(pc.and_(pc.is_null(a), pc.is_null(b)), True, pc.fill_null(pc.equal(a, b), False))
    return np.concatenate(([0], np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1)) if len(keys) else np.empty(0, np.int64)


def _running(key: int, value: int, names: list[str]):
    """Adds the sum over the rows before, within the partition and its run of equal keys."""

    def work(found):
        last, total = None, 0
        for b in found:
            if not b.num_rows:
                continue
            keys, n = b.column(key), b.column(value).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.cumsum(n) - n
            starts = _runs(keys)
            base = np.repeat(before[starts], np.diff(np.append(starts, len(n))))
            out = before - base
            if last is not None and (last[0].equals(keys[0]) or not last[0].is_valid and not keys[0].is_valid):
                out[: starts[1] if len(starts) > 1 else len(n)] += total
            last, total = (keys[-1],), int(out[-1] + n[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names)

    return work


def prefix_sum(df: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    """Adds ``out``: for each row the sum of ``value`` over the key's rows before it.

    Rows are dealt out in ranges of (key, order), written, and summed within a partition. Of each
    partition at most two keys go on in others, so what is broadcast has two rows for
    each partition at most, however sparse or dense the order is, and a key with most of all rows is not one task's. Null
    orders come first; rows with the same order have some fixed order.
    """
    part, base = "_part_" + out, "_base_" + out
    fields = [*df.schema.fields, StructField(out, LongType())]
    rows = df.repartitionByRange(key, order).sortWithinPartitions(key, order)
    rows = rows.mapInArrow(_running(df.columns.index(key), df.columns.index(value), [f.name for f in fields]), StructType(fields))
    rows = frozen(rows.withColumn(part, F.spark_partition_id()))
    ends = rows.groupBy(F.col(key).alias("_key"), F.col(part).alias("_part")).agg(F.sum(value).alias("_n"))
    spread = ends.selectExpr("*", "count(*) over (partition by _key) as _parts").where("_parts > 1")
    spread = spread.selectExpr("_key", "_part", f"coalesce(sum(_n) over (partition by _key order by _part rows between unbounded preceding and 1 preceding), 0L) as {base}")
    both = rows.join(F.broadcast(spread), F.col(key).eqNullSafe(F.col("_key")) & (F.col(part) == F.col("_part")), "left")
    return both.select(*df.columns, (F.col(out) + F.coalesce(F.col(base), F.lit(0))).alias(out))
