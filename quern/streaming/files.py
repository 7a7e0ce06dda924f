"""File-like encoder and decoder for programs that push and pull bytes. Spark does the work on blocks."""

from __future__ import annotations

import io
import time
import uuid
import zlib
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import kernels as K
from quern.operators import decode, markers
from quern.plans.storage import fresh_folder, frozen
from quern.sources.files import write_bytes

#: A value of up to so many bytes goes to the executors as a broadcast; a larger one as a file in the shared folder.
BROADCAST = 64 << 20


@contextmanager
def _in_pool(spark: SparkSession | None, pool: str | None):
    """Jobs started inside run in a scheduler pool."""
    if spark is None or pool is None:
        yield
        return
    before = spark.sparkContext.getLocalProperty("spark.scheduler.pool")
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", pool)
    try:
        yield
    finally:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", before)


@dataclass(frozen=True)
class EncoderStats:
    total_in: int = 0
    total_out: int = 0
    blocks_completed: int = 0
    batches_completed: int = 0
    elapsed: float = 0.0

    @property
    def compression_ratio(self) -> float:
        return self.total_out / self.total_in if self.total_in else 0.0

    @property
    def compression_rate(self) -> float:
        return self.total_in / self.elapsed if self.elapsed else 0.0


@dataclass(frozen=True)
class EncoderOptions:
    """How to encode. ``replace`` gives a copy with changes; ``build`` an encoder.

    ``min_blocks`` set by hand goes before the session's parallelism, which goes before 1. ``pool`` names a Spark scheduler pool.
    """

    level: int = 9
    min_blocks: int | None = None
    pool: str | None = None
    on_progress: Callable[[EncoderStats], None] | None = None

    def replace(self, **changes) -> "EncoderOptions":
        return replace(self, **changes)

    def batch_blocks(self, spark: SparkSession | None) -> int:
        return max(1, self.min_blocks if self.min_blocks is not None else spark.sparkContext.defaultParallelism if spark else 1)

    def build(self, out, spark: SparkSession | None = None) -> "Encoder":
        return Encoder(out, spark=spark, options=self)


class Encoder:
    """Writes one stream to a binary file object.

    Blocks are encoded in batches of at least ``min_blocks``: with a session as a Spark job, whose result, a
    batch of encoded blocks, comes back here; else
    here. The output does not depend on how the input was cut into writes, or on batches.
    ``on_progress`` gets the statistics after each batch, the last included. Leaving the
    ``with`` statement by an exception leaves the stream unfinished. Settings given one by one go before those in ``options``.
    """

    def __init__(self, out, level: int | None = None, spark: SparkSession | None = None, min_blocks: int | None = None, on_progress: Callable[[EncoderStats], None] | None = None, options: EncoderOptions = EncoderOptions()):
        given = {k: v for k, v in (("level", level), ("min_blocks", min_blocks), ("on_progress", on_progress)) if v is not None}
        self.options = options.replace(**given)
        self.out, self.level, self.spark, self.on_progress = out, K.checked_level(self.options.level), spark, self.options.on_progress
        self.min_blocks = self.options.batch_blocks(spark)
        self._bits, self._pending, self._crc, self._began, self.finished = K.BitWriter(), bytearray(), 0, time.monotonic(), False
        self._stats, self._total_in = EncoderStats(), 0
        self._bits.write_bytes(b"BZh%d" % self.level)

    @property
    def stats(self) -> EncoderStats:
        return replace(self._stats, total_in=self._total_in, elapsed=time.monotonic() - self._began)

    def write(self, data: bytes) -> int:
        if self.finished:
            raise ValueError("write after finish")
        self._pending += data
        if data:
            self._total_in += len(data)
            full = len(self._pending) // K.max_block_bytes(self.level)
            if full >= self.min_blocks:
                self._batch(full * K.max_block_bytes(self.level))
        return len(data)

    def _encoded(self, blocks: list[bytes]):
        if self.spark is None or len(blocks) < 2:
            return [K.encode_block(b, self.level) for b in blocks]
        level = self.level
        with _in_pool(self.spark, self.options.pool):  # one stage, nothing exchanged: a batch may be as small as two blocks
            return self.spark.sparkContext.parallelize(blocks, len(blocks)).map(lambda b: K.encode_block(b, level)).collect()

    def _batch(self, size: int) -> None:
        blocks = K.split(bytes(self._pending[:size]), self.level)
        for bits, n, crc in self._encoded(blocks):
            self._bits.copy_bits(bits, 0, n)
            self._crc = K.fold_crc(self._crc, crc)
        del self._pending[:size]
        self._put()
        self._stats = replace(self._stats, blocks_completed=self._stats.blocks_completed + len(blocks), batches_completed=self._stats.batches_completed + 1)
        if self.on_progress:
            self.on_progress(self.stats)

    def _put(self) -> None:
        data = self._bits.take_whole()
        self.out.write(data)
        self._stats = replace(self._stats, total_out=self._stats.total_out + len(data))

    def flush(self) -> None:
        """Passes on whole bytes; does not end a block."""
        self._put()
        if hasattr(self.out, "flush"):
            self.out.flush()

    def finish(self):
        """Ends the stream and returns the file object; a second call does nothing."""
        if not self.finished:
            if self._pending:
                self._batch(len(self._pending))
            self._bits.write_bits(K.EOS_MAGIC, 48)
            self._bits.write_bits(self._crc, 32)
            self._bits.pad()
            self._put()
            self.finished = True
        return self.out

    def __enter__(self):
        return self

    def __exit__(self, kind, *_):
        if kind is None:
            self.finish()


@dataclass(frozen=True)
class DecoderStats:
    blocks_total: int = 0
    streams_total: int = 0
    blocks_completed: int = 0
    streams_completed: int = 0
    bytes_out: int = 0
    bits_consumed: int = 0
    elapsed: float = 0.0

    @property
    def progress(self) -> float:
        return self.blocks_completed / self.blocks_total if self.blocks_total else 0.0

    @property
    def decompression_rate(self) -> float:
        return self.bytes_out / self.elapsed if self.elapsed else 0.0


@dataclass(frozen=True)
class DecoderOptions:
    """How to decode. ``replace`` gives a copy with changes; ``open`` and ``from_bytes`` a decoder.

    ``blocks_per_partition`` blocks are decoded by a task and pulled at once, while one more partition is
    prefetched: this bounds what is decoded ahead of the reader.
    """

    verify_stream_crc: bool = True
    blocks_per_partition: int = 8
    part_bytes: int = markers.PART
    pool: str | None = None
    on_progress: Callable[[DecoderStats], None] | None = None

    def replace(self, **changes) -> "DecoderOptions":
        return replace(self, **changes)

    def open(self, spark: SparkSession, path: str) -> "Decoder":
        return Decoder.open(spark, path, options=self)

    def from_bytes(self, spark: SparkSession, data: bytes) -> "Decoder":
        return Decoder.from_bytes(spark, data, options=self)


class Decoder(io.RawIOBase):
    """Reads the streams of one file in order.

    Opening scans and checks the format. Reading pulls partitions of blocks, decoded by
    Spark and packed for the way to the driver, and the table of streams in step with them. Blocks before a bad one are delivered, then the error is raised.
    Closing cancels the jobs that run ahead. Settings given one by one go before those in ``options``.
    """

    def __init__(self, m: DataFrame, blocks: Callable[[DataFrame], DataFrame], settle: Callable[[DataFrame], DataFrame], files: DataFrame, options: DecoderOptions):
        super().__init__()
        self._began, self.options, self.verify, self.on_progress = time.monotonic(), options, options.verify_stream_crc, options.on_progress
        self._context, self._tag = m.sparkSession.sparkContext, f"quern-{uuid.uuid4().hex}"
        with _in_pool(m.sparkSession, options.pool):
            m = frozen(m)
            if bad := decode.format_errors(m, files).first():
                raise K.InvalidFormat(bad["error"])
            table = frozen(markers.streams(m).select("stream_idx", "n_ranges", "stored_stream_crc"))
            n = table.agg(F.count("*").alias("streams"), F.sum("n_ranges").alias("blocks")).first()
            order = ["stream_idx", "block_idx"]
            ranges = settle(m)
            ranges = ranges.repartitionByRange(max(1, n["blocks"] // max(1, options.blocks_per_partition)), *order).sortWithinPartitions(*order)
            self._context.addJobTag(self._tag)
            try:
                self._streams = table.orderBy("stream_idx").toLocalIterator()
                self._blocks = blocks(ranges).toLocalIterator(prefetchPartitions=True)
            finally:
                self._context.removeJobTag(self._tag)
        self._stats = DecoderStats(blocks_total=n["blocks"], streams_total=n["streams"])
        self._crc, self._left, self._error = 0, b"", None
        self._current = self._last = next(self._streams)

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: DecoderOptions = DecoderOptions(), **given) -> "Decoder":
        options = options.replace(**given)
        files = spark.createDataFrame([(path,)], "file string")
        return cls(markers.file_markers(spark, path, options.part_bytes), decode.packed_files, lambda m: decode.file_ranges(m)[0], files, options)

    @classmethod
    def from_bytes(cls, spark: SparkSession, data: bytes, options: DecoderOptions = DecoderOptions(), **given) -> "Decoder":
        options = options.replace(**given)
        if len(data) > BROADCAST:
            path = fresh_folder(spark, "value") + ".bz2"
            write_bytes(path, data)
            return cls.open(spark, path, options)
        df = spark.createDataFrame([("bytes", bytearray(data))], "file string, content binary")
        shared = spark.sparkContext.broadcast(data)
        return cls(markers.markers(df), lambda r: decode.decoded_ranges(r, lambda _: lambda a, z: (shared.value[a:z], a), True), lambda m: decode.value_ranges(m, df)[0], df, options)

    def close(self) -> None:
        if not self.closed and hasattr(self, "_tag"):
            self._blocks = self._streams = iter(())
            self._context.cancelJobsWithTag(self._tag)
        super().close()

    @property
    def stats(self) -> DecoderStats:
        return replace(self._stats, elapsed=time.monotonic() - self._began)

    @property
    def stream_crc(self) -> int:
        """Folded checksum of the current stream so far."""
        return self._crc

    @property
    def stored_stream_crc(self) -> int:
        """The current stream's checksum as the file has it."""
        return self._last["stored_stream_crc"]

    def readable(self) -> bool:
        return True

    def _end_stream(self) -> None:
        if self.verify and self._crc != self.stored_stream_crc:
            raise K.CrcMismatch(f"stream {self._last['stream_idx']}: stored {self.stored_stream_crc:08x}, computed {self._crc:08x}")
        self._current, self._crc = next(self._streams, None), 0
        self._last = self._current or self._last
        self._stats = replace(self._stats, streams_completed=self._stats.streams_completed + 1)

    def _pull(self) -> bool:
        r = next(self._blocks, None)
        while self._current is not None and (r is None or self._current["stream_idx"] < r["stream_idx"]):
            self._end_stream()
        if r is None:
            return False
        if not r["crc_valid"]:
            raise (K.CrcMismatch if r["data"] is not None else K.DecompressionFailed)(f"block at bit {r['start_bit']}: {r['error']}")
        self._crc, self._left = K.fold_crc(self._crc, r["stored_crc"]), zlib.decompress(r["data"])
        s = self._stats
        self._stats = replace(s, blocks_completed=s.blocks_completed + 1, bytes_out=s.bytes_out + len(self._left), bits_consumed=r["end_bit"])
        if self.on_progress:
            self.on_progress(self.stats)
        return True

    def readinto(self, buffer) -> int:
        if self.closed:
            raise ValueError("read of a closed decoder")
        if self._error:
            raise self._error
        while len(buffer) and not self._left:
            try:
                if not self._pull():
                    return 0
            except ValueError as e:
                self._error = e
                raise
        n = min(len(buffer), len(self._left))
        buffer[:n], self._left = self._left[:n], self._left[n:]
        return n
