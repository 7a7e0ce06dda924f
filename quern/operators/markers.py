"""Markers, streams and block ranges: the metadata of files as tables.

Only markers (some 30 bytes for each 80 to 900 kB of input) are exchanged between
tasks here, never payload.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import kernels as K
from quern.operators.schemas import MARKER
from quern.plans.batches import ROWS

#: Bytes of a file scanned by one task.
PART = 32 << 20


def marker_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32())
    cols = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["file", "bit_offset", "kind", "crc", "next_level"])


def marker_rows(file: str, data: bytes, base: int = 0, owned: int | None = None) -> list[tuple]:
    """Marker rows of a part of a file; the part at 0 also tells the file's header."""
    rows = []
    if not base:
        try:
            rows.append((file, 0, "H", 0, K.parse_header(data)))
        except K.InvalidFormat:
            pass
    return rows + [(file, m.bit_offset, m.kind, m.crc, m.next_level) for m in K.scan(data, base, owned)]


def markers(df: DataFrame, key: str = "file", data: str = "content") -> DataFrame:
    """Marker rows of a binary column, for values that fit into a row. ``key`` must tell rows apart."""

    def work(batches):
        for b in batches:
            rows = []
            for k, v in zip(b.column(0).to_pylist(), b.column(1)):
                if v.is_valid:
                    rows += marker_rows(k, v.as_py())
                if len(rows) >= ROWS:
                    yield marker_batch(rows)
                    rows = []
            yield marker_batch(rows)

    return df.select(F.col(key).cast("string"), F.col(data)).mapInArrow(work, MARKER)


def file_markers(spark: SparkSession, path: str, part_bytes: int = PART) -> DataFrame:
    """Marker rows of a file or folder, each part of a file scanned by a task of its own.

    A part owns the markers whose first bit it holds and reads a few bytes past its end, so parts
    need no exchange and give no duplicates.
    """
    from quern.sources.bzip2 import register

    return spark.read.format(register(spark)).option("partBytes", part_bytes).load(path)


def true_markers(m: DataFrame) -> DataFrame:
    """Without ends of stream that merely look like one: a header follows a true end, or it is the last."""
    last = F.expr("max(if(kind = 'E', bit_offset, null)) over (partition by file)")
    return m.withColumn("_last", last).where("kind <> 'E' or next_level is not null or bit_offset = _last").drop("_last")


def streams(m: DataFrame) -> DataFrame:
    """``file, stream_idx, level, header_byte, eos_bit, stored_stream_crc, n_ranges``."""
    t = true_markers(m).withColumn("blocks", F.expr("count_if(kind = 'B') over (partition by file order by bit_offset)")).where("kind <> 'B'")
    w = "over (partition by file order by bit_offset)"
    ends = t.selectExpr("file", "kind", f"count_if(kind = 'E') {w} - 1 as stream_idx", f"lag(next_level) {w} as level", f"coalesce(lag(if(kind = 'H', 0L, (bit_offset + 87) div 8)) {w}, 0L) as header_byte", "bit_offset as eos_bit", "crc as stored_stream_crc", f"blocks - coalesce(lag(blocks) {w}, 0L) as n_ranges")
    return ends.where("kind = 'E'").selectExpr("file", "cast(stream_idx as int) as stream_idx", "level", "header_byte", "eos_bit", "stored_stream_crc", "n_ranges")


def block_ranges(m: DataFrame) -> DataFrame:
    """``file, stream_idx, block_idx, level, start_bit, end_bit, crc``.

    A range ends where the next marker begins. It is a block, unless a marker that merely looks like one
    splits it: see ``decode.true_ranges``.
    """
    w = "over (partition by file order by bit_offset"
    t = true_markers(m).selectExpr("file", "kind", "bit_offset", "crc", f"cast(coalesce(count_if(kind = 'E') {w} rows between unbounded preceding and 1 preceding), 0) as int) as stream_idx", f"last(next_level, true) {w} rows between unbounded preceding and 1 preceding) as level", f"lead(bit_offset) {w}) as end_bit")
    t = t.where("kind = 'B' and end_bit is not null").selectExpr("file", "stream_idx", "level", "bit_offset as start_bit", "end_bit", "crc")
    return dense(t)


def dense(ranges: DataFrame) -> DataFrame:
    """Numbers the ranges of each stream from 0. The window sees markers, never payload."""
    idx = F.expr("cast(row_number() over (partition by file, stream_idx order by start_bit) - 1 as int)")
    return ranges.select("file", "stream_idx", idx.alias("block_idx"), "level", "start_bit", "end_bit", "crc")


def format_errors(m: DataFrame, files: DataFrame) -> DataFrame:
    """``file, error`` for the files (column ``file``) that are no sequence of streams."""
    per = m.groupBy("file").agg(F.expr("max(if(kind = 'E', bit_offset, null))").alias("e"), F.expr("max(if(kind = 'B', bit_offset, null))").alias("b"), F.expr("count_if(kind = 'H')").alias("h"))
    error = F.expr("case when e is null then 'no streams' when b > e then 'blocks after the last stream' when h = 0 then 'no bzip2 header' end")
    return files.select("file").distinct().join(per, "file", "left").select("file", error.alias("error")).where("error is not null")
