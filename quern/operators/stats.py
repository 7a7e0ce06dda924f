"""Statistics of encoding and decoding as aggregates, or observed while a query runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quern.functions.columns import ratio


def encoder_stats(encoded: DataFrame, elapsed: float | None = None) -> DataFrame:
    """One row: ``total_in, total_out, blocks_completed, compression_ratio`` (out by in) and, with
    seconds, ``compression_rate``. ``total_out`` counts the blocks' bits in whole bytes."""
    d = encoded.agg(F.coalesce(F.sum("raw_len"), F.lit(0)).alias("total_in"), F.coalesce(F.ceil(F.sum("bit_len") / 8), F.lit(0)).alias("total_out"), F.count("*").alias("blocks_completed"))
    d = d.withColumn("compression_ratio", ratio(F.col("total_out"), F.col("total_in")))
    return d if elapsed is None else d.withColumn("elapsed", F.lit(float(elapsed))).withColumn("compression_rate", ratio(F.col("total_in"), F.col("elapsed")))


def decoder_stats(results: DataFrame, streams: DataFrame, elapsed: float | None = None) -> DataFrame:
    """One row: ``blocks_total, blocks_completed, blocks_failed, streams_total, bytes_out,
    bits_consumed, progress`` and, with seconds, ``decompression_rate``.

    ``blocks_total`` counts markers, false ones too; merged blocks count once as completed,
    so ``progress`` is completed and failed by rows of the result. ``bits_consumed`` is the end of the last
    valid block, of all files together.
    """
    r = results.groupBy("file").agg(F.count("*").alias("n"), F.count_if("crc_valid").alias("good"), F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).alias("bytes_out"), F.coalesce(F.max(F.when(F.col("crc_valid"), F.col("end_bit"))), F.lit(0)).alias("bits"))
    s = streams.groupBy("file").agg(F.sum("n_ranges").alias("ranges"), F.count("*").alias("streams"))
    none = lambda kind: F.lit(0).cast("long").alias(kind)
    both = r.select("n", "good", "bytes_out", "bits", none("ranges"), none("streams")).unionByName(s.select(*map(none, ("n", "good", "bytes_out", "bits")), "ranges", "streams"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    d = both.agg(total("ranges").alias("blocks_total"), total("streams").alias("streams_total"), total("good").alias("blocks_completed"), total(F.col("n") - F.col("good")).alias("blocks_failed"), total("bytes_out").alias("bytes_out"), total("bits").alias("bits_consumed"), ratio(total("good"), total("n")).alias("progress"))
    return d if elapsed is None else d.withColumn("elapsed", F.lit(float(elapsed))).withColumn("decompression_rate", ratio(F.col("bytes_out"), F.col("elapsed")))


def observed(results: DataFrame, name: str = "decode") -> tuple[DataFrame, Observation]:
    """The same rows, and counts that are there once an action has read them all."""
    o = Observation(name)
    return results.observe(o, F.count("*").alias("blocks"), F.expr("count_if(not crc_valid)").alias("failed"), F.sum(F.octet_length("data")).alias("bytes_out")), o
