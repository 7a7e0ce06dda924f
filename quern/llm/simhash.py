"""SimHash near-duplicates, searched with pivot distance tables.

A fingerprint is compared with reference fingerprints ("pivots"). Its Hamming
distances to them form a row of the pivot table. Two fingerprints that differ in at
most ``r`` bits have coordinates that differ by at most ``r``, for any pivot, so a
larger difference discards a pair without a look at its bits.

The pivots live on ``BLOCKS`` disjoint sub-spaces of 16 bits. Two differing bits
touch at most two of the four, so on some two sub-spaces all coordinates agree: the
coordinates of each of the six choices of two sub-spaces are a hash-join key, and no link
is missed. Joined pairs are discarded by the maximum difference over all coordinates, and
survivors are verified bit by bit.

A key that many fingerprints share (a large group of near copies) would give a pair for
each two of them. There, each fingerprint is replaced by the points at distance
1 or less within the sub-spaces left free: two fingerprints are 2 or fewer bits apart
exactly if they share such a point, so an edge from each to the smallest at each point
keeps all connections with a number of rows proportional to the group.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quern.llm.common import frozen, tidied, unused
from quern.llm.components import components

SEED, BLOCKS, WIDTH, RADIUS = 42, 4, 16, 2
#: Pivots on each sub-space. Twelve 5-bit distances fill a 60-bit key.
PIVOTS = 12
#: Up to so many fingerprints at a key are joined in pairs; more go by shared points.
PAIRED = 48


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash over the shingles of ``words`` words; zero for a text without words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and x20, x09-x0D only
    if not parts:
        return 0
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(b" ".join(parts), SEED)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    begins = np.concatenate(([0], ends[: -words]))
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    n = len(begins)
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begins.tolist(), (ends[words - 1 :] - 1).tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches):
    for b in batches:
        seen: dict = {}
        got = [seen[t] if t in seen else seen.setdefault(t, fingerprint(t)) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(np.array(got, np.uint64).view(np.int64))], ["doc_id", "fp"])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: fp is the fingerprint's 64 bits as a signed long."""
    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(tidied(_fingerprints), "doc_id long, fp long")


def _pivots() -> list[list[int]]:
    rng = np.random.default_rng(7)
    return [[int(x) for x in rng.choice(1 << WIDTH, PIVOTS, replace=False)] for _ in range(BLOCKS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivot_table(fps: DataFrame) -> DataFrame:
    """Adds ``t0`` to ``t3``: for each sub-space the packed distances to its pivots."""
    out = []
    for g, own in enumerate(_pivots()):
        part = F.shiftrightunsigned(F.col("fp"), g * WIDTH).bitwiseAND(F.lit((1 << WIDTH) - 1))
        packed = F.lit(0).cast("long")
        for j, p in enumerate(own):
            packed = packed + F.shiftleft(F.bit_count(part.bitwiseXOR(F.lit(p).cast("long"))).cast("long"), 5 * j)
        out.append(packed.alias(f"t{g}"))
    return fps.select("fp", *out)


def _coordinates(side: str):
    return [F.shiftright(F.col(f"{side}.t{g}"), 5 * j).bitwiseAND(F.lit(31)) for g in range(BLOCKS) for j in range(PIVOTS)]


def links(fps: DataFrame) -> DataFrame:
    """``u, v``: edges between different fingerprints (column ``fp``, distinct) at distance
    ``RADIUS`` or less, enough to connect every two that chains of such links connect."""
    rows = pivot_table(fps)
    keyed = rows.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"t{a}").alias("a"), F.col(f"t{b}").alias("b")) for k, (a, b) in enumerate(combinations(range(BLOCKS), 2))])).alias("key"))
    keyed = keyed.select("fp", *[f"t{g}" for g in range(BLOCKS)], "key.k", "key.a", "key.b")
    sizes = keyed.groupBy("k", "a", "b").agg(F.count("*").alias("n")).where("n > 1")
    keyed = keyed.join(sizes, ["k", "a", "b"])
    few = keyed.where(F.col("n") <= PAIRED)
    x, y = few.alias("x"), few.alias("y")
    on = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("k", "a", "b")]
    apart = F.greatest(*[F.abs(p - q) for p, q in zip(_coordinates("x"), _coordinates("y"))])
    pairs = x.join(y, [*on, F.col("x.fp") < F.col("y.fp")]).where(apart <= RADIUS).select(F.col("x.fp").alias("u"), F.col("y.fp").alias("v"))
    pairs = pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)
    free = F.array(*[F.array(*[F.lit(_signed(1 << (g * WIDTH + i))) for g in range(BLOCKS) if g not in ab for i in range(WIDTH)], F.lit(0).cast("long")) for ab in combinations(range(BLOCKS), 2)])
    points = keyed.where(F.col("n") > PAIRED).select("fp", "k", F.explode(F.element_at(free, F.col("k") + 1)).alias("bit"))
    points = points.select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("point")).distinct()
    heads = points.groupBy("point").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").select("point", "v")
    stars = points.join(heads, "point").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.unionAll(stars).distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id``: one row for each row of ``df``.

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` is the smallest id
    reachable over links of ``RADIUS`` or fewer differing bits, itself included.
    A null, empty or blank text has fingerprint zero and links like any other. Equal
    fingerprints are one node, so a group of copies costs one row in the search. A
    repeated row comes out repeated; a null id is kept and is no one's smallest id,
    unless a component has no other (then the component is null). Other columns are not read.
    An empty table gives an empty table.
    """
    docs = frozen(fingerprints(df, id_col, text_col))
    nodes = frozen(docs.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components(links(nodes.select("fp")))
    linked = nodes.join(linked, nodes["fp"] == linked["node"]).select("fp", "least", "component")
    heads = linked.groupBy("component").agg(F.min("least").alias("head"))
    linked = linked.join(heads, "component").select("fp", "head")
    # Written, so that the last join is one of two plain exchanges, which adaptive execution can split
    # where a fingerprint has most of the rows.
    labels = frozen(nodes.join(linked, "fp", "left").select("fp", F.coalesce("head", "least").alias("component_id")))
    return docs.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without near-duplicates: of each component the row with the smallest id stays.

    Of several such rows with that id in a component one stays. Rows with one id whose texts are in different
    components count for each. Rows whose id is null all stay.
    """
    rows = frozen(fingerprints(docs))
    nodes = frozen(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = components(links(nodes.select("fp")))
    part = nodes.join(linked, nodes["fp"] == linked["node"], "left").where("least IS NOT NULL").groupBy(F.coalesce("component", "fp")).agg(F.min(F.struct("least", "fp")).alias("at"))
    heads = frozen(part.select(F.col("at.least").alias("doc_id"), F.col("at.fp").alias("fp")))
    # Where all rows with an id have one fingerprint the id tells them, elsewhere id and fingerprint.
    mixed = frozen(rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("doc_id"))
    named = docs.where("doc_id IS NOT NULL")
    plain = named.join(heads.join(mixed, "doc_id", "left_anti").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    name, at = unused("_fp", docs.columns), docs.columns.index("text")

    def marked(batches):
        for b in batches:
            fps = np.array([fingerprint(t) for t in b.column(at).to_pylist()], np.uint64).view(np.int64)
            yield b.append_column(name, pa.array(fps))

    several = named.join(mixed, "doc_id", "left_semi").select(*docs.columns).mapInArrow(tidied(marked), StructType([*docs.schema.fields, StructField(name, LongType())]))
    several = several.join(heads.withColumnRenamed("fp", name), ["doc_id", name], "left_semi").dropDuplicates(["doc_id", name])
    return plain.select(*docs.columns).unionAll(several.select(*docs.columns)).unionAll(docs.where("doc_id IS NULL"))
