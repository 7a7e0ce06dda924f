"""Encoding: values or ordered rows are cut into blocks, encoded as rows, and put together."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import kernels as K
from quern.functions.columns import fold_crc
from quern.operators.schemas import ENCODED
from quern.plans.batches import cuts
from quern.plans.prefix import prefix_sum


def split_blocks(df: DataFrame, key: str, data: str, level: int = 9) -> DataFrame:
    """``key, block_idx, offset, data``: each binary value in blocks of a level's size; empty values give none."""
    n = K.max_block_bytes(level)
    cut = F.expr(f"explode(if(octet_length(_v) > 0, sequence(0L, (octet_length(_v) - 1L) div {n}), cast(array() as array<bigint>)))")
    rows = df.select(F.col(key), F.col(data).cast("binary").alias("_v")).where("_v is not null").select(key, "_v", cut.alias("_i"))
    return rows.select(key, F.col("_i").cast("int").alias("block_idx"), (F.col("_i") * n).alias("offset"), F.expr(f"substring(_v, cast(_i * {n} + 1 as int), {n})").alias("data"))


def tile_rows(df: DataFrame, key: str, order: str, data: str, level: int = 9) -> DataFrame:
    """``key, block_idx, data``: the values of a key's rows, in order, as one run of bytes in blocks.

    A row's place is a prefix sum over sizes; then each row is cut where blocks
    end, and only pieces of the same block meet in a task. Null orders come first; rows of a key with
    the same order keep no particular order among them. Null and empty values add nothing.
    """
    n = K.max_block_bytes(level)
    rows = df.select(F.col(key).alias("_k"), F.col(order).cast("long").alias("_o"), F.col(data).cast("binary").alias("_v")).where("octet_length(_v) > 0")
    rows = prefix_sum(rows.withColumn("_n", F.octet_length("_v").cast("long")), "_k", "_o", "_n", "_at")
    pieces = rows.select("_k", "_v", "_at", F.expr(f"explode(sequence(_at div {n}, (_at + octet_length(_v) - 1) div {n}))").alias("_b"))
    begin = f"greatest(_b * {n} - _at, 0L)"
    pieces = pieces.select("_k", "_at", "_b", F.expr(f"substring(_v, cast({begin} + 1 as int), cast(least(_at + octet_length(_v), (_b + 1) * {n}) - _at - {begin} as int))").alias("_p"))
    blocks = pieces.groupBy("_k", "_b").agg(F.expr("listagg(_p) within group (order by _at)").alias("data"))
    return blocks.select(F.col("_k").alias(key), F.col("_b").cast("int").alias("block_idx"), "data")


def encode_blocks(blocks: DataFrame, level: int = 9, data: str = "data") -> DataFrame:
    """The other columns, then ``raw_len, bits, bit_len, block_crc`` of each block."""
    K.checked_level(level)
    keep = [c for c in blocks.columns if c != data]

    def work(found):
        for b in found:
            values, others = b.column(b.schema.get_field_index(data)), b.select(keep)
            # A batch is passed on in parts of bounded bytes, by the length of what goes in.
            for a, z in cuts(pc.binary_length(values).fill_null(0).to_pylist()):
                raw = [v.as_py() for v in values[a:z]]
                cols = list(zip(*(K.encode_block(v, level) for v in raw)))
                made = [pa.array(c, k) for c, k in zip(([len(v) for v in raw], *cols), (pa.int64(), pa.binary(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([*others.slice(a, z - a).columns, *made], [*keep, "raw_len", "bits", "bit_len", "block_crc"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema if f.name != data)
    return blocks.mapInArrow(work, f"{fields}, {ENCODED}")


def positions(encoded: DataFrame, key: str) -> DataFrame:
    """Adds ``bit_pos``, where each block's bits begin in its stream. The window sees no payload."""
    place = encoded.select(key, "block_idx", "bit_len").withColumn("bit_pos", F.expr(f"32 + coalesce(sum(bit_len) over (partition by `{key}` order by block_idx rows between unbounded preceding and 1 preceding), 0L)"))
    place = place.select(F.col(key).alias("_key"), F.col("block_idx").alias("_idx"), "bit_pos")
    return encoded.join(place, F.col(key).eqNullSafe(F.col("_key")) & (F.col("block_idx") == F.col("_idx"))).drop("_key", "_idx")


def placed(encoded: DataFrame, key: str) -> DataFrame:
    """``key, block_idx, byte_pos, bytes``: each block shifted to its place, whole bytes with zeros around.

    Neighbours share at most one byte, whose parts are or-ed, so pieces can be made and
    written in any order.
    """

    def one(bits, n, pos):
        w = K.BitWriter()
        w.write_bits(0, pos % 8)
        w.copy_bits(bits, 0, n)
        return w.getvalue()

    def work(found):
        for b in found:
            bits, n, pos = (b.column(b.schema.get_field_index(c)) for c in ("bits", "bit_len", "bit_pos"))
            for a, z in cuts(pc.binary_length(bits).to_pylist()):
                made = [one(x.as_py(), k, p) for x, k, p in zip(bits[a:z], n[a:z].to_pylist(), pos[a:z].to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0)[a:z], b.column(1)[a:z], pa.array([p // 8 for p in pos[a:z].to_pylist()], pa.int64()), pa.array(made, pa.binary())], [key, "block_idx", "byte_pos", "bytes"])

    p = positions(encoded, key).select(key, "block_idx", "bits", "bit_len", "bit_pos")
    kind = p.schema[key].dataType.simpleString()
    return p.mapInArrow(work, f"`{key}` {kind}, block_idx int, byte_pos bigint, bytes binary")


def assemble(encoded: DataFrame, key: str, level: int = 9, keys: DataFrame | None = None) -> DataFrame:
    """``key, content``: a stream for each key, for streams that fit into a row.

    ``keys`` adds the keys that have no block, which get an empty stream.
    """
    K.checked_level(level)

    @F.arrow_udf("binary")
    def put(blocks: pa.Array) -> pa.Array:
        return pa.array([K.assemble([(b["bits"], b["bit_len"], b["block_crc"]) for b in x.as_py() or []], level) for x in blocks], pa.binary())

    grouped = encoded.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("block_idx", "bits", "bit_len", "block_crc"))).alias("_b"))
    if keys is not None:
        grouped = keys.select(key).distinct().withColumnRenamed(key, "_key").join(grouped, F.col("_key").eqNullSafe(F.col(key)), "left").select(F.col("_key").alias(key), "_b")
    return grouped.select(key, put("_b").alias("content"))


#: Input bytes of the consecutive blocks that are put together in one row of ``stream_parts``.
PART_BYTES = 4 << 20


def stream_parts(encoded: DataFrame, key: str, level: int = 9, keys: DataFrame | None = None) -> DataFrame:
    """``key, bit_pos, bit_len, last, bytes``: each key's stream put together in order like by ``assemble``, in parts, so no stream need fit into a row or a task.

    A part is a run of blocks; the first also has the header, the last the end with the checksum and the padding. ``bytes`` has zeros
    around its bits, which begin ``bit_pos % 8`` bits in. The windows see no payload. ``encoded`` is read twice and should be
    stored. ``keys`` adds the keys that have no block, which get an empty stream.
    """
    size = max(1, PART_BYTES // K.max_block_bytes(level))
    rows = encoded.select(F.col(key).alias("_k"), "block_idx", F.expr(f"block_idx div {size}").alias("_run"), "bits", "bit_len", "block_crc")
    i = rows.selectExpr("_k", "block_crc", "row_number() over (partition by _k order by block_idx) - 1 as i", "count(*) over (partition by _k) as n")
    ends = i.groupBy("_k").agg(fold_crc(F.col("block_crc"), F.col("i"), F.col("n")).alias("_crc"))
    if keys is not None:
        every = keys.select(F.col(key).alias("_every")).distinct()
        ends = every.join(ends, F.col("_every").eqNullSafe(F.col("_k")), "left").select(F.col("_every").alias("_k"), F.coalesce("_crc", F.lit(0)).alias("_crc"))
    runs = rows.groupBy(F.col("_k").alias("_rk"), F.col("_run").alias("_r")).agg(F.sum("bit_len").alias("_n"))
    runs = runs.selectExpr("_rk", "_r", "32 + coalesce(sum(_n) over (partition by _rk order by _r rows between unbounded preceding and 1 preceding), 0L) as _pos", "lead(_r) over (partition by _rk order by _r) is null as _last", "lag(_r) over (partition by _rk order by _r) is null as _first")
    frame = ends.join(runs, F.col("_k").eqNullSafe(F.col("_rk")), "left").select(F.col("_k").alias(key), "_r", F.coalesce("_pos", F.lit(32)).alias("_pos"), F.coalesce("_first", F.lit(True)).alias("_first"), F.coalesce("_last", F.lit(True)).alias("last"), "_crc")
    groups = rows.groupBy("_k", "_run").agg(F.array_sort(F.collect_list(F.struct("block_idx", "bits", "bit_len"))).alias("_b"))
    both = frame.join(groups, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_r") == F.col("_run")), "left").select(key, "_pos", "_first", "last", "_crc", "_b")

    def one(pos, first, last, crc, blocks):
        w = K.BitWriter()
        if first:
            w.write_bytes(b"BZh%d" % level)
            pos = 0
        w.write_bits(0, pos % 8)
        for b in blocks or []:
            w.copy_bits(b["bits"], 0, b["bit_len"])
        if last:
            w.write_bits(K.EOS_MAGIC, 48)
            w.write_bits(crc, 32)
            w.pad()
        return pos, w.bit_len - pos % 8, last, w.getvalue()

    def work(found):
        for b in found:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                made = one(*(c.to_pylist()[0] for c in row.columns[1:]))
                yield pa.RecordBatch.from_arrays([row.column(0), *(pa.array([x], t) for x, t in zip(made, (pa.int64(), pa.int64(), pa.bool_(), pa.binary())))], [key, "bit_pos", "bit_len", "last", "bytes"])

    return both.mapInArrow(work, f"`{key}` {both.schema[key].dataType.simpleString()}, bit_pos bigint, bit_len bigint, last boolean, bytes binary")


def encode(df: DataFrame, key: str, data: str, level: int = 9) -> DataFrame:
    """``key, content``: each binary value as one stream, its blocks encoded as rows of their own."""
    encoded = encode_blocks(split_blocks(df, key, data, level), level)
    return assemble(encoded, key, level, df.where(F.col(data).isNotNull()))


def archive(df: DataFrame, key: str, order: str, data: str, level: int = 9) -> DataFrame:
    """``key, content``: all rows of a key, in order, as one stream."""
    return assemble(encode_blocks(tile_rows(df, key, order, data, level), level), key, level, df)
