"""Micro-batches in and out of bzip2. Every batch adds complete streams, so no state is carried."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from quern.functions.columns import decompress
from quern.sources.bzip2 import write_files


def write_stream(df: DataFrame, path: str, checkpoint: str, level: int = 9, line_end: str = "\n") -> DataStreamWriter:
    """A sink that writes each micro-batch of a one-column stream under ``path/batch=<id>``.

    A batch that is run again replaces its own folder, so nothing is written twice.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        write_files(batch, f"{path}/batch={batch_id}", level, "overwrite", line_end)

    return df.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 16, mode: str = "FAILFAST") -> DataFrame:
    """``path, data`` of each file that arrives, decoded; for files that fit into a row."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.bz2").load(path)
    return raw.select("path", decompress(F.col("content"), mode=mode).alias("data"))
