"""Sharding along a Hilbert curve over quantised metadata.

Rows are sorted by their place on the curve and the order is cut into runs. Rows
close in all of language, source and size land in the same runs, so the minimum and
maximum of each column in a shard's files let a reader skip most files for a filter on
any of them, not only on the first sort column.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import frozen, unused

BITS, DIMS = 5, 3


def curve(bits: int = BITS, dims: int = DIMS) -> np.ndarray:
    """Hilbert index of every cell; a cell's number is its coordinates' bits, one after the other.

    The reflected-code construction: from the top bit down, each set bit inverts the
    lower bits of the first coordinate, each clear one exchanges them.
    """
    cells = np.arange(1 << bits * dims)
    x = [(cells >> bits * (dims - 1 - d)) & ((1 << bits) - 1) for d in range(dims)]
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for d in range(dims):
            inside = (x[d] & q) > 0
            swap = np.where(inside, 0, (x[0] ^ x[d]) & low)
            x[0] = np.where(inside, x[0] ^ low, x[0] ^ swap)
            x[d] = x[d] ^ swap if d else x[0]
        q >>= 1
    for d in range(1, dims):
        x[d] = x[d] ^ x[d - 1]
    flip, q = np.zeros_like(cells), 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[-1] & q) > 0, flip ^ (q - 1), flip)
        q >>= 1
    index = np.zeros_like(cells)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            index = index << 1 | ((x[d] ^ flip) >> b & 1)
    return index


def _code(column: str):
    """A category's coordinate: 0 for null, else one of the others by its hash."""
    return F.when(F.col(column).isNull(), 0).otherwise(1 + F.crc32(F.col(column).cast("string").cast("binary")) % ((1 << BITS) - 1))


def hilbert_shards(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", categories: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert``, a row for each of ``df``.

    The law is ``rows``: the order (curve index, text_crc32, id, size) is cut into runs
    whose lengths differ by one at most, so ``grown_shard`` is null. ``slot`` counts
    from 0 in each shard along the curve. A hot language and source is spread by the
    rest of the order and a range partition never has to hold a whole cell. Null text
    counts as empty (size 1, crc 0); null categories have a coordinate of their own;
    null ids sort first; repeated rows get a slot each; other columns are not read.
    Fewer rows than shards leave shards empty. The lookup that is broadcast has
    2^15 rows, whatever the input.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *[_code(c).cast("long").alias(f"d{i}") for i, c in enumerate(categories)])
    # Log-scaled size: the number of binary digits, 1 to 31.
    cell = F.shiftleft(F.col("d0"), 2 * BITS) + F.shiftleft(F.col("d1"), BITS) + F.least(F.length(F.bin("size")), F.lit((1 << BITS) - 1))
    lookup = F.broadcast(spark.createDataFrame(list(enumerate(curve().tolist())), "cell long, hilbert long"))
    rows = rows.withColumn("cell", cell.cast("long")).join(lookup, "cell").select("doc_id", "size", "text_crc32", "hilbert")
    order = ["hilbert", "text_crc32", "doc_id", "size"]
    rows = frozen(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    rows = rows.select("*", part.alias("part"), place.alias("place"))
    # One row for each partition comes to the driver.
    counts = sorted((r["part"], r["n"]) for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect())
    bases, total = [], 0
    for p, n in counts:
        bases.append((p, total))
        total += n
    bases = F.broadcast(spark.createDataFrame(bases, "part long, base long"))
    rank = F.col("base") + F.col("place")
    rows = rows.join(bases, "part").withColumn("rank", rank).withColumn("shard", F.expr(f"rank * {shards} div {max(total, 1)}"))
    first = F.expr(f"(shard * {max(total, 1)} + {shards - 1}) div {shards}")
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), (F.col("rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def write_shards(df: DataFrame, path: str, shards: int = 8) -> None:
    """Writes ``df``, with the columns of documents, as one folder ``shard=k`` for each shard, sorted along the curve.

    Each file then covers a short stretch of the curve. Every row is written once: rows get a key of their own, so null and
    repeated ids are no matter. A column of ``df`` named ``shard`` is written as ``_shard``.
    """
    row, at, slot = (unused(c, [*df.columns, "shard"]) for c in ("_row", "_shard_at", "_slot"))
    rows = frozen(df.withColumn(row, F.monotonically_increasing_id()))
    placed = hilbert_shards(rows, shards, id_col=row).select(F.col("doc_id").alias(at), F.col("shard").alias("_to"), F.col("slot").alias(slot))
    out = rows.join(placed, F.col(row) == F.col(at))
    out = out.select(*[F.col(c).alias(unused("_shard", df.columns) if c.lower() == "shard" else c) for c in df.columns], F.col("_to").alias("shard"), slot)
    out.repartitionByRange("shard", slot).sortWithinPartitions("shard", slot).drop(slot).write.mode("overwrite").partitionBy("shard").parquet(path)
