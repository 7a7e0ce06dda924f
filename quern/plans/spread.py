"""Enough partitions for work that costs more than moving its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Input that a scan's own partitions keep a core busy with.
PER_CORE = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out over all cores, if it is so small that its scan would leave some idle.

    A small file is often one row group, which one task reads. Beyond ``PER_CORE`` bytes
    for each core, by the optimizer's estimate, the scan's partitions stay and nothing is moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(4 * cores) if int(str(size)) < cores * PER_CORE else df
