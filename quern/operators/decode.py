"""Decoding: every block of every stream is a row, decoded where its bytes are read.

Which ranges are blocks is settled on markers first, so nothing above the decoding tasks moves payload.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import kernels as K
from quern.functions.columns import fold_crc
from quern.operators.markers import block_ranges, dense, file_markers, format_errors, markers, streams
from quern.operators.schemas import BLOCK_RESULT
from quern.plans.batches import batches
from quern.plans.storage import frozen
from quern.sources.files import read_range

_KINDS = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
_NAMES = [x.split()[0] for x in BLOCK_RESULT.split(", ")]
_RANGE = ["file", "stream_idx", "block_idx", "level", "start_bit", "end_bit"]
#: A value of up to so many bytes is scanned and decoded by one task; a larger one's blocks are dealt out.
IN_PLACE = 16 << 20


def _result(r: dict, window, payload: bool = True) -> tuple:
    """A row of ``BLOCK_RESULT`` for a range that is taken as it is."""
    start, end, data, stored, computed, error = next(K.true_blocks(window, [(r["start_bit"], r["end_bit"])], r["level"]))
    return (r["file"], r["stream_idx"], r["block_idx"], r["level"], start, end, data if payload else None, stored, computed, error is None, error)


def _rows(rows):
    return batches(rows, _NAMES, _KINDS, 6)


def _blocks(source, payload: bool = True, packed: bool = False):
    """``source(row)`` gives the window function of a row, which is a dict of a range."""

    def put(r):
        return tuple(zlib.compress(x, 1) if k == 6 and x is not None else x for k, x in enumerate(r)) if packed else r

    def work(found):
        yield from _rows(put(_result(r, source(r), payload)) for b in found for r in b.to_pylist())

    return work


def _from_file(r):
    return lambda a, z: (read_range(r["file"], a, z), a)


def decode_file_blocks(ranges: DataFrame, tasks: int | None = None, payload: bool = True) -> DataFrame:
    """A result row for each range. ``ranges`` come from ``block_ranges`` or ``true_ranges``; tasks read their own bytes.

    Ranges are dealt out evenly, so one large file keeps all tasks busy. Without ``payload`` the
    blocks are checked and their data is null.
    """
    n = tasks or int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ranges.select(*_RANGE).repartition(n, "file", "stream_idx", "block_idx").mapInArrow(_blocks(_from_file, payload), BLOCK_RESULT)


def decoded_ranges(ranges: DataFrame, source: Callable, packed: bool = False) -> DataFrame:
    """The same, with the ranges' partitions and order kept. ``source(row)`` gives what reads the bytes of a row's file.

    If ``packed``, ``data`` comes as zlib streams, for blocks that go to the driver.
    """
    return ranges.select(*_RANGE).mapInArrow(_blocks(source, packed=packed), BLOCK_RESULT)


def decoded_files(ranges: DataFrame) -> DataFrame:
    return decoded_ranges(ranges, _from_file)


def packed_files(ranges: DataFrame) -> DataFrame:
    return decoded_ranges(ranges, _from_file, True)


#: Consecutive blocks of a value that are decoded from one window of its bytes.
CHUNK = 16


def _windows(ranges: DataFrame, df: DataFrame, key: str, data: str) -> DataFrame:
    """``file, a, rs, w``: groups of ranges (columns ``group, rs, a, z``: bytes) with the bytes they need.

    A value is joined once, to all its groups, which are then dealt out over the tasks.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = ranges.groupBy("file").agg(F.collect_list(F.struct("a", "z", "rs")).alias("cs"))
    values = df.select(F.col(key).cast("string").alias("file"), F.col(data).alias("content"))
    cut = F.expr("explode(transform(cs, c -> struct(c.a as a, c.rs as rs, substring(content, cast(c.a + 1 as int), cast(c.z - c.a as int)) as w)))")
    return groups.join(values, "file").select("file", cut.alias("c")).select("file", "c.a", "c.rs", "c.w").repartition(n, "file", "a")


def _each(found, of):
    """``of(row, window)`` for each row of ``_windows``, one at a time."""
    for b in found:
        for i in range(b.num_rows):
            c = b.slice(i, 1).to_pylist()[0]
            yield from of(c, lambda a, z: (c["w"][a - c["a"] : z - c["a"]], a))  # noqa: B023


def decode_value_blocks(ranges: DataFrame, df: DataFrame, key: str = "file", data: str = "content", payload: bool = True) -> DataFrame:
    """The same as ``decode_file_blocks`` for a binary column, in groups of ``CHUNK`` blocks."""
    groups = ranges.groupBy("file", "stream_idx", F.expr(f"block_idx div {CHUNK}").alias("c")).agg(F.collect_list(F.struct(*_RANGE[1:])).alias("rs"), F.expr("min(start_bit) div 8").alias("a"), F.expr("(max(end_bit) + 7) div 8").alias("z"))

    def work(found):
        yield from _rows(_each(found, lambda c, window: (_result({"file": c["file"], **r}, window, payload) for r in c["rs"])))

    return _windows(groups, df, key, data).mapInArrow(work, BLOCK_RESULT)


def _joined_runs(r, window):
    """The true blocks of a run of ranges that do not decode by themselves."""
    ends = [(x["start_bit"], x["end_bit"]) for x in r["rs"]]
    crcs = {x["start_bit"]: x["crc"] for x in r["rs"]}
    return [(r["file"], r["rs"][0]["stream_idx"], r["rs"][0]["level"], start, end, crcs[start]) for start, end, *_ in K.true_blocks(window, ends, r["rs"][0]["level"])]


_JOINED = "file string, stream_idx int, level int, start_bit bigint, end_bit bigint, crc bigint"
_JOINED_NAMES = [x.split()[0] for x in _JOINED.split(", ")]
_JOINED_KINDS = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def true_ranges(m: DataFrame, check: Callable[[DataFrame], DataFrame], join: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """``block_ranges`` with the ranges put together that a false marker splits, numbered without gaps; and the
    streams whose checksum must be looked at again, if there are any.

    Streams whose checksum agrees with those of their markers have no false marker and are taken as they are.
    Of the others a short one is read whole by one task; a long one's ranges are checked one by one (``check``, without payload), and
    each run of neighbours that fail, however long, is read again from its first start on (``join``). Only ranges are
    exchanged, never payload.
    """
    ranges = block_ranges(m)
    doubtful = frozen(marker_check(m).where("not ok").select("file", "stream_idx"))
    if doubtful.isEmpty():
        return ranges, None
    ranges = frozen(ranges)
    keys = ["file", "stream_idx"]
    mine = ranges.join(doubtful, keys, "left_semi")
    length = mine.groupBy(*keys).agg((F.max("end_bit") - F.min("start_bit")).alias("bits"))
    length = frozen(length.select(*keys, (F.col("bits") > 8 * IN_PLACE).alias("long")))
    found = mine.join(length.where("not long").select(*keys), keys, "left_semi").withColumn("run", F.lit(0).cast("long"))
    if not (long := length.where("long").select(*keys)).isEmpty():
        status = check(mine.join(long, keys, "left_semi")).select(*keys, "block_idx", F.col("crc_valid").alias("ok"))
        status = status.withColumn("run", F.expr("count_if(ok) over (partition by file, stream_idx order by block_idx)")).where("not ok")
        found = found.unionByName(ranges.join(status.drop("ok"), [*keys, "block_idx"]))
    runs = frozen(found.groupBy(*keys, "run").agg(F.array_sort(F.collect_list(F.struct("start_bit", "end_bit", "crc", "stream_idx", "level"))).alias("rs")).where("size(rs) > 1"))
    if runs.isEmpty():
        return ranges, doubtful
    put = join(runs.select("file", F.expr("rs[0].start_bit div 8").alias("a"), F.expr(f"(rs[size(rs) - 1].end_bit + 7) div 8 + {K.FOLLOWS}").alias("z"), "rs")).select(*_JOINED_NAMES)
    split = runs.select("file", "stream_idx", F.explode("rs.start_bit").alias("start_bit"))
    return frozen(dense(ranges.join(split, [*keys, "start_bit"], "left_anti").select(*_JOINED_NAMES).unionByName(put))), doubtful


def _file_runs(runs: DataFrame) -> DataFrame:
    def work(found):
        yield from batches((x for b in found for r in b.to_pylist() for x in _joined_runs(r, _from_file(r))), _JOINED_NAMES, _JOINED_KINDS, 0)

    return runs.repartition("file", "a").mapInArrow(work, _JOINED)


def _value_runs(df: DataFrame, key: str, data: str):
    def work(found):
        yield from batches(_each(found, _joined_runs), _JOINED_NAMES, _JOINED_KINDS, 0)

    return lambda runs: _windows(runs, df, key, data).mapInArrow(work, _JOINED)


def file_ranges(m: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``true_ranges`` of files."""
    return true_ranges(m, lambda r: decode_file_blocks(r, payload=False), _file_runs)


def value_ranges(m: DataFrame, df: DataFrame, key: str = "file", data: str = "content") -> tuple[DataFrame, DataFrame | None]:
    """``true_ranges`` of a binary column."""
    return true_ranges(m, lambda r: decode_value_blocks(r, df, key, data, payload=False), _value_runs(df, key, data))


def whole_blocks(file: str, content: bytes, mode: str = "FAILFAST", verify_stream_crc: bool = True):
    """The rows of ``BLOCK_RESULT`` of a whole file at hand. Mode FAILFAST raises the first error."""
    strict = mode == "FAILFAST"
    try:
        found = K.find_streams(content, K.scan(content))
    except K.InvalidFormat as e:
        if strict:
            raise K.InvalidFormat(f"invalid format: {file}: {e}") from e
        return
    for i, s in enumerate(found):
        crc = 0
        for k, (start, end, data, stored, computed, error) in enumerate(K.true_blocks(lambda a, z: (content[a:z], a), s.ranges, s.level)):
            if error and strict:
                raise K.DecompressionFailed(f"block {k} of {file}: {error}")
            crc = K.fold_crc(crc, stored or 0)
            yield file, i, k, s.level, start, end, data, stored, computed, error is None, error
        if strict and verify_stream_crc and crc != s.stored_crc:
            raise K.CrcMismatch(f"stream checksum mismatch: {file}, stream {i}")


def _in_place(mode: str, verify_stream_crc: bool):
    def work(found):
        yield from _rows(x for b in found for k, v in zip(b.column(0).to_pylist(), b.column(1)) for x in whole_blocks(k, v.as_py(), mode, verify_stream_crc))

    return work


def stream_check(results: DataFrame, stream_table: DataFrame) -> DataFrame:
    """``file, stream_idx, computed_stream_crc, stored_stream_crc, ok``; streams without blocks fold to 0."""
    dense = results.selectExpr("file", "stream_idx", "stored_crc", "row_number() over (partition by file, stream_idx order by start_bit) - 1 as i", "count(*) over (partition by file, stream_idx) as n")
    folded = dense.groupBy("file", "stream_idx").agg(fold_crc(F.col("stored_crc"), F.col("i"), F.col("n")).alias("c"))
    both = stream_table.join(folded, ["file", "stream_idx"], "left")
    c = F.coalesce("c", F.lit(0).cast("long"))
    return both.select("file", "stream_idx", c.alias("computed_stream_crc"), "stored_stream_crc", (c == F.col("stored_stream_crc")).alias("ok"))


def before_first_error(results: DataFrame) -> DataFrame:
    """Of each file the blocks that come before its first bad one: what a reader in order would get."""
    bad = results.where("not crc_valid").groupBy("file").agg(F.min("start_bit").alias("_bad"))
    return results.join(bad, "file", "left").where("_bad is null or start_bit < _bad").drop("_bad")


_BLOCK = ["file", "stream_idx", "start_bit"]
#: A range of up to so many bytes of each file has few blocks, whose places are sent to all tasks.
SHORT_RANGE = 1 << 30


def _offsets(results: DataFrame) -> DataFrame:
    """``file, stream_idx, start_bit, offset, _n``: where each block's bytes begin in its file's decoded content, and their number."""
    sizes = results.select(*_BLOCK, F.octet_length("data").cast("long").alias("_n"))
    at = F.expr("coalesce(sum(_n) over (partition by file order by stream_idx, start_bit rows between unbounded preceding and 1 preceding), 0L)")
    return sizes.select(*_BLOCK, at.alias("offset"), "_n")


def byte_offsets(results: DataFrame) -> DataFrame:
    """Adds ``offset``, where each block's bytes begin in its file's decoded content. The window sees sizes alone.

    The optimizer takes decoded blocks for as small as their ranges; by the hint it does not send them to the driver.
    """
    return results.hint("merge").join(_offsets(results).drop("_n"), _BLOCK)


def read_bytes(results: DataFrame, begin: int, length: int) -> DataFrame:
    """``file, offset, data``: the pieces of each file's decoded content in [begin, begin + length).

    Of a short range the places of its blocks, never their bytes, are broadcast; a long one is joined by an exchange.
    """
    end = begin + length
    places = _offsets(results).where((F.col("offset") < end) & (F.col("offset") + F.col("_n") > begin))
    inside = results.join(F.broadcast(places), _BLOCK) if length <= SHORT_RANGE else results.hint("merge").join(places, _BLOCK)
    skip = F.greatest(F.lit(begin) - F.col("offset"), F.lit(0))
    cut = F.substring("data", (skip + 1).cast("int"), (F.least(F.lit(end), F.col("offset") + F.col("_n")) - F.col("offset") - skip).cast("int"))
    return inside.select("file", (F.col("offset") + skip).alias("offset"), cut.alias("data"))


def failure_groups(status: DataFrame) -> DataFrame:
    """Runs of neighbouring failures: ``file, stream_idx, first_idx, last_idx, start_bit, end_bit``.

    ``status`` has ``file, stream_idx, block_idx, start_bit, end_bit, ok``. The number of
    successes so far is the same all along a run.
    """
    run = status.withColumn("run", F.expr("count_if(ok) over (partition by file, stream_idx order by block_idx)")).where("not ok")
    return run.groupBy("file", "stream_idx", "run").agg(F.min("block_idx").alias("first_idx"), F.max("block_idx").alias("last_idx"), F.min("start_bit").alias("start_bit"), F.max("end_bit").alias("end_bit")).drop("run")


def _checked_mode(mode: str) -> None:
    if mode not in ("FAILFAST", "PERMISSIVE"):
        raise ValueError(f"mode must be FAILFAST or PERMISSIVE, not {mode}")


def failfast(results: DataFrame, checks: DataFrame | None, errors: DataFrame) -> DataFrame:
    """The blocks, where any error of format, block or stream ends the query that reads them.

    ``checks`` and ``errors`` are small and looked at right away; what they tell is raised by the query.
    """
    bad = errors.select(F.concat(F.lit("invalid format: "), "file", F.lit(": "), "error").alias("why"))
    if checks is not None:
        bad = bad.unionAll(checks.where("not ok").select(F.concat(F.lit("stream checksum mismatch: "), "file", F.lit(", stream "), F.col("stream_idx").cast("string"))))
    why = bad.agg(F.min("why").alias("why")).first()["why"]
    if why is not None:
        one = results.sparkSession.range(1).where(F.raise_error(F.lit(why)).cast("string").isNull())
        return one.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in results.schema])
    failed = F.raise_error(F.concat(F.lit("block "), F.col("block_idx").cast("string"), F.lit(" of "), "file", F.lit(": "), F.coalesce("error", F.lit("")))).cast("boolean")
    return results.where(F.when(~F.col("crc_valid"), failed).otherwise(True))


def decode(df: DataFrame, key: str = "file", data: str = "content", mode: str = "FAILFAST", verify_stream_crc: bool = True) -> DataFrame:
    """Blocks of a binary column: ``file, stream_idx, block_idx, data`` and the checks' columns.

    Mode PERMISSIVE keeps bad blocks as rows with an ``error``; FAILFAST raises. Null values have no
    blocks. A value of up to ``IN_PLACE`` bytes is decoded where it is; a larger one's blocks are dealt out.
    """
    _checked_mode(mode)
    rows = df.select(F.col(key).cast("string").alias("file"), F.col(data).cast("binary").alias("content")).where("content is not null")
    small = rows.where(F.octet_length("content") <= IN_PLACE).mapInArrow(_in_place(mode, verify_stream_crc), BLOCK_RESULT)
    large = rows.where(F.octet_length("content") > IN_PLACE)
    if large.isEmpty():
        return small
    m = frozen(markers(large))
    ranges, doubtful = value_ranges(m, large)
    return small.unionAll(_checked(decode_value_blocks(ranges, large), ranges, doubtful if verify_stream_crc else None, m, large.select("file"), mode))


def checked_values(df: DataFrame, key: str = "file", data: str = "content") -> DataFrame:
    """``file, n_streams, n_blocks, bad_blocks, bad_streams, error`` of each value, which is decoded where it is.

    A stream with a bad block is not checked as a whole. ``error`` tells why a value is no sequence of streams. Null values
    have null in all columns but the first. Rows need no key of their own.
    """

    def of(file, content):
        if content is None:
            return file, None, None, None, None, None
        try:
            found = K.find_streams(content, K.scan(content))
        except K.InvalidFormat as e:
            return file, 0, 0, 0, 0, str(e)
        n = bad = off = 0
        for s in found:
            crc, good = 0, True
            for *_, stored, _, error in K.true_blocks(lambda a, z: (content[a:z], a), s.ranges, s.level):
                n, bad, good = n + 1, bad + bool(error), good and not error
                crc = K.fold_crc(crc, stored or 0)
            off += good and crc != s.stored_crc
        return file, len(found), n, bad, off, None

    def work(found):
        for b in found:
            rows = list(zip(*(of(k, v.as_py()) for k, v in zip(b.column(0).to_pylist(), b.column(1))))) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, (pa.string(), *[pa.int64()] * 4, pa.string()))], ["file", "n_streams", "n_blocks", "bad_blocks", "bad_streams", "error"])

    rows = df.select(F.col(key).cast("string").alias("file"), F.col(data).cast("binary").alias("content"))
    return rows.mapInArrow(work, "file string, n_streams long, n_blocks long, bad_blocks long, bad_streams long, error string")


def decode_files(spark: SparkSession, path: str, mode: str = "FAILFAST", verify_stream_crc: bool = True, part_bytes: int = 32 << 20) -> DataFrame:
    """The same for a file or folder, read in parts. Decoded bytes are not exchanged between tasks."""
    from quern.sources.files import sizes

    _checked_mode(mode)
    m = frozen(file_markers(spark, path, part_bytes))
    files = spark.createDataFrame([(f,) for f, _ in sizes(path)], "file string")
    ranges, doubtful = file_ranges(m)
    return _checked(decode_file_blocks(ranges), ranges, doubtful if verify_stream_crc else None, m, files, mode)


def marker_check(m: DataFrame) -> DataFrame:
    """``stream_check`` from the markers' checksums alone, without decoding.

    A stream that passes is as its writer left it, as far as its blocks' checksums go, which
    decoding verifies. One that fails may just hold a marker that only looks like one.
    """
    return stream_check(block_ranges(m).withColumnRenamed("crc", "stored_crc"), streams(m))


def _checked(results, ranges, doubtful, m, files, mode):
    """Streams are checked by the checksums that their true ranges store; decoding holds these against the data."""
    if mode == "PERMISSIVE":
        return results
    checks = doubtful and stream_check(ranges.withColumnRenamed("crc", "stored_crc"), streams(m).join(doubtful, ["file", "stream_idx"], "left_semi"))
    return failfast(results, checks, format_errors(m, files))


def whole_values(results: DataFrame) -> DataFrame:
    """``file, data``: each file's blocks in order, put together, for contents that fit into a row."""
    return results.groupBy("file").agg(F.expr("listagg(data) within group (order by stream_idx, block_idx)").alias("data"))
