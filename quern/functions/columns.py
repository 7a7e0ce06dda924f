"""Column functions: whole-value codec, checksums, bits, ratios. Python sees Arrow batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from quern.functions import kernels as K


def _values(values: pa.Array, get, kind: pa.DataType) -> pa.Array:
    """``get`` of each value's bytes; null stays null."""
    return pa.array([get(v.as_buffer()) if v.is_valid else None for v in values], kind)


@F.arrow_udf(LongType())
def block_crc(data: pa.Array) -> pa.Array:
    """The format's CRC-32 of a binary column; null stays null."""
    return _values(data, K.crc32, pa.int64())


@F.arrow_udf(LongType())
def continued_crc(crc: pa.Array, data: pa.Array) -> pa.Array:
    """The CRC-32 of earlier bytes, whose checksum is ``crc``, and ``data`` together; null if either is."""
    return pa.array([K.crc32(v.as_buffer(), c) if v.is_valid and c is not None else None for c, v in zip(crc.to_pylist(), data)], pa.int64())


def read_u32(data: Column, bit: int) -> Column:
    """32 bits of each value from bit ``bit`` on; zeros past its end."""

    @F.arrow_udf(LongType())
    def one(values: pa.Array) -> pa.Array:
        return _values(values, lambda v: K.read_u32(bytes(v), bit), pa.int64())

    return one(data)


def extract_bits(data: Column, start: int, end: int) -> Column:
    """Bits [start, end) of each value, the last byte filled with zeros."""

    @F.arrow_udf(BinaryType())
    def one(values: pa.Array) -> pa.Array:
        return _values(values, lambda v: K.extract_bits(bytes(v), start, end), pa.binary())

    return one(data)


def compress(data: Column, level: int = 9) -> Column:
    """Each value as a complete stream, many blocks if it needs them. For values that fit into a row."""
    K.checked_level(level)

    @F.arrow_udf(BinaryType())
    def one(values: pa.Array) -> pa.Array:
        return _values(values, lambda v: K.compress(v, level), pa.binary())

    return one(data)


def decompress(data: Column, verify_stream_crc: bool = True, mode: str = "FAILFAST") -> Column:
    """Each value's streams decoded and put together. In mode PERMISSIVE a bad value gives null."""
    if mode not in ("FAILFAST", "PERMISSIVE"):
        raise ValueError(f"mode must be FAILFAST or PERMISSIVE, not {mode}")

    def get(v):
        try:
            return K.decompress(v, verify_stream_crc)
        except (K.InvalidFormat, K.DecompressionFailed, K.CrcMismatch):
            if mode == "FAILFAST":
                raise
            return None

    @F.arrow_udf(BinaryType())
    def one(values: pa.Array) -> pa.Array:
        return _values(values, get, pa.binary())

    return one(data)


def max_block_bytes(level: Column) -> Column:
    """Input bytes of a full block of each level, in SQL."""
    return F.floor((level.cast("long") * 100_000 - 19) * 4 / 5).cast("long")


def rotated(crc: Column, by: Column) -> Column:
    """Rotation of 32-bit values to the left by 0 to 31."""
    return F.call_function("shiftleft", crc, by.cast("int")).bitwiseOR(F.call_function("shiftright", crc, (F.lit(32) - by).cast("int"))).bitwiseAND(F.lit(K.MASK32).cast("long"))


def fold_crc(crc: Column, index: Column, count: Column) -> Column:
    """Aggregate: a stream's checksum from the checksums of its ``count`` blocks, in any order.

    Rotation is linear over exclusive or, so the ordered fold is the exclusive or of each
    checksum rotated by the number of blocks after it. Partial aggregation applies.
    """
    return F.coalesce(F.bit_xor(rotated(crc, (count - 1 - index) % 32)), F.lit(0).cast("long"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """A rate or ratio; 0.0 where there is nothing to divide by."""
    return F.when(F.coalesce(denominator, F.lit(0)) == 0, 0.0).otherwise(numerator / denominator).cast("double")
