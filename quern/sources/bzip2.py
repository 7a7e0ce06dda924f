"""Data source for the markers of bzip2 files, and a sink that writes bzip2 files."""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from quern.functions import kernels as K
from quern.functions.columns import fold_crc
from quern.operators.schemas import MARKER
from quern.plans.storage import frozen, stored
from quern.sources.files import located, read_range, sizes

NAME = "quern_bzip2"


@dataclass
class Part(InputPartition):
    file: str
    begin: int
    end: int


class MarkerReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.part = options["path"], int(options.get("partBytes", 32 << 20))

    def partitions(self):
        return [Part(f, a, min(a + self.part, n)) for f, n in sizes(self.path) for a in range(0, n, self.part)] or [Part("", 0, 0)]

    def read(self, part):
        from quern.operators.markers import marker_batch, marker_rows

        if part.end > part.begin:
            data = read_range(part.file, part.begin, part.end + K.LOOK_AHEAD)
            yield marker_batch(marker_rows(part.file, data, part.begin, part.end - part.begin))


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str


class FileWriter(DataSourceArrowWriter):
    """Each task writes one stream to a hidden file, which commit gives its name; abort removes it."""

    def __init__(self, options, schema, overwrite):
        if len(schema.fields) != 1 or schema.fields[0].dataType.typeName() not in ("binary", "string"):
            raise K.InvalidFormat("the sink takes one binary or string column")
        self.path, self.level, self.overwrite = options["path"], K.checked_level(int(options.get("level", 9))), overwrite
        self.line_end = options.get("lineEnd", "").encode()
        self.job = uuid.uuid4().hex

    def write(self, iterator):
        from pyspark import TaskContext

        system, root = located(self.path)
        system.create_dir(root, recursive=True)
        part = TaskContext.get()
        name = f"part-{part.partitionId():05d}-{self.job}.bz2"
        hidden = f"{root}/_{name}-{part.taskAttemptId()}"
        size, crc, pending, n = K.max_block_bytes(self.level), 0, bytearray(), 0
        with system.open_output_stream(hidden, compression=None) as f:
            w = K.BitWriter()
            w.write_bytes(b"BZh%d" % self.level)

            def block(data):
                nonlocal crc
                bits, n_bits, block_crc = K.encode_block(data, self.level)
                w.copy_bits(bits, 0, n_bits)
                crc = K.fold_crc(crc, block_crc)
                f.write(w.take_whole())

            for b in iterator:
                for v in b.column(0).cast(pa.binary()) if b.num_rows else ():
                    if v.is_valid:
                        pending += v.as_py() + self.line_end
                        n += 1
                    while len(pending) >= size:
                        block(bytes(pending[:size]))
                        del pending[:size]
            if pending:
                block(bytes(pending))
            w.write_bits(K.EOS_MAGIC, 48)
            w.write_bits(crc, 32)
            w.pad()
            f.write(w.take_whole())
        return Written(hidden, f"{root}/{name}")

    def commit(self, messages):
        system, root = located(self.path)
        old = [located(f)[1] for f, _ in sizes(self.path)] if self.overwrite else []
        for m in messages:
            if m:
                system.move(m.temporary, m.final)
        # Old files go once the new ones are there.
        for f in old:
            system.delete_file(f)
        self._tidy(system, root)

    def abort(self, messages):
        self._tidy(*located(self.path))

    def _tidy(self, system, root):
        """Removes this job's hidden files, those of failed and of repeated attempts as well."""
        for x in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if x.is_file and x.base_name.startswith("_part-") and self.job in x.base_name:
                system.delete_file(x.path)


class Bzip2DataSource(DataSource):
    """Reading gives marker rows (option ``partBytes``); writing takes one column of bytes or text,
    in the order of each partition's rows (options ``level`` and ``lineEnd``)."""

    @classmethod
    def name(cls):
        return NAME

    def schema(self):
        return MARKER

    def reader(self, schema):
        return MarkerReader(self.options)

    def writer(self, schema, overwrite):
        return FileWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> str:
    spark.dataSource.register(Bzip2DataSource)
    return NAME


def write_files(df, path: str, level: int = 9, mode: str = "append", line_end: str = "") -> None:
    """The rows of each partition as one .bz2 file; together, or concatenated, the files are valid bzip2."""
    df.write.format(register(df.sparkSession)).option("level", level).option("lineEnd", line_end).mode(mode).save(path)


def _stream_writer(root: str):
    """Writes pieces (key, byte_pos, bytes) into the files of their keys, all but the first and last byte of
    each, which neighbours may share; these come out as rows."""

    def work(found):
        for b in found:
            ends = []
            for k, at, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                piece = piece.as_py()
                if len(piece) > 2:
                    _put(root, k, [(at + 1, piece[1:-1])])
                ends += [(k, at, piece[0]), (k, at + len(piece) - 1, piece[-1])][: len(piece)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*ends)) or [()] * 3, (pa.string(), pa.int64(), pa.int64()))], ["key", "at", "byte"])

    return work


def _put(root: str, key: str | None, pieces) -> None:
    f = os.open(f"{root}/{file_name(key)}", os.O_CREAT | os.O_WRONLY, 0o644)
    try:
        for at, piece in pieces:
            os.pwrite(f, piece, at)
    finally:
        os.close(f)


def file_name(key: str | None) -> str:
    """The name of a key's file; no key's name begins like a hidden file's."""
    return ("null" if key is None else "=" + quote(key, safe="")) + ".bz2"


def write_streams(encoded: DataFrame, key: str, path: str, level: int = 9, keys: DataFrame | None = None) -> None:
    """The blocks of each key (rows of ``encode_blocks``) as one file of one stream, ``file_name(key)`` in ``path``.

    Blocks are written where they belong by as many tasks as there are, so neither a stream nor a file is ever in
    one row or task. Bytes that two blocks share are or-ed in a table of their own. Tasks may run again:
    they write the same bytes. Files get their names when all is written. ``keys`` adds keys that have no
    block. This needs a file system in which files can be written at any place, as mounted ones can; for others
    there is ``write_files``, which writes streams side by side.
    """
    from quern.operators.encode import placed

    system, root = located(path)
    if not isinstance(system, fs.LocalFileSystem):
        raise K.InvalidFormat(f"files in {path} cannot be written at any place: use write_files")
    K.checked_level(level)
    e = stored(encoded.withColumn(key, F.col(key).cast("string")), "encoded")
    hidden = f"{root}/_streams-{uuid.uuid4().hex}"
    system.create_dir(hidden, recursive=True)
    # Header, and end with the checksum, which follows the last block.
    i = e.selectExpr(f"`{key}` as key", "bit_len", "block_crc", f"row_number() over (partition by `{key}` order by block_idx) - 1 as i", f"count(*) over (partition by `{key}`) as n")
    ends = i.groupBy("key").agg(F.sum("bit_len").alias("bits"), fold_crc(F.col("block_crc"), F.col("i"), F.col("n")).alias("crc"))
    if keys is not None:
        every = keys.select(F.col(key).cast("string").alias("_key")).distinct()
        ends = every.join(ends, F.col("_key").eqNullSafe(F.col("key")), "left").select(F.col("_key").alias("key"), F.coalesce("bits", F.lit(0)).alias("bits"), F.coalesce("crc", F.lit(0)).alias("crc"))

    def frame(found):
        for b in found:
            rows = []
            for k, bits, crc in zip(*(c.to_pylist() for c in b.columns)):
                w = K.BitWriter()
                w.write_bits(0, bits % 8)
                w.write_bits(K.EOS_MAGIC, 48)
                w.write_bits(crc, 32)
                rows += [(k, 0, b"BZh%d" % level), (k, 4 + bits // 8, w.getvalue())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 3, (pa.string(), pa.int64(), pa.binary()))], ["key", "at", "piece"])

    pieces = placed(e, key).select(F.col(key).alias("key"), F.col("byte_pos").alias("at"), F.col("bytes").alias("piece"))
    pieces = pieces.unionAll(ends.select("key", "bits", "crc").mapInArrow(frame, "key string, at long, piece binary"))
    shared = frozen(pieces.mapInArrow(_stream_writer(hidden), "key string, at long, byte long"))

    def put(found):
        for b in found:
            of: dict = {}
            for k, at, x in zip(*(c.to_pylist() for c in b.columns)):
                of.setdefault(k, []).append((at, bytes([x])))
            for k, own in of.items():
                _put(hidden, k, own)
            yield pa.RecordBatch.from_arrays([pa.array(list(of), pa.string())], ["key"])

    def publish(found):
        for b in found:
            for k in b.column(0).to_pylist():
                # A task that runs again finds the name given already.
                if os.path.exists(f"{hidden}/{file_name(k)}"):
                    os.replace(f"{hidden}/{file_name(k)}", f"{root}/{file_name(k)}")
            yield b

    done = frozen(shared.groupBy("key", "at").agg(F.bit_or("byte").alias("byte")).mapInArrow(put, "key string").distinct())
    done.mapInArrow(publish, "key string").write.format("noop").mode("overwrite").save()
    os.rmdir(hidden)


def same_streams(parts: DataFrame, key: str, path: str) -> DataFrame:
    """``key, same``: whether the file of each key in ``path`` is, bit by bit, the stream that ``parts`` (of ``encode.stream_parts``) make up.

    Each part is held against its own range of the file, so no file is ever in one row or task.
    """

    def same(k, at, n, last, piece):
        file = f"{path}/{file_name(k)}"
        system, name = located(file)
        info = system.get_file_info(name)
        if not info.is_file or last and info.size != (at + n) // 8:
            return False
        got = bytearray(read_range(file, at // 8, (at + n + 7) // 8))
        if len(got) != len(piece):
            return False
        got[0] &= 0xFF >> at % 8
        got[-1] &= 0xFF << -(at + n) % 8
        return got == piece

    def work(found):
        for b in found:
            keys, at, n, last = (c.to_pylist() for c in b.columns[:4])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([same(*x, piece.as_py()) for *x, piece in zip(keys, at, n, last, b.column(4))], pa.bool_())], [key, "same"])

    held = parts.select(F.col(key).cast("string").alias(key), "bit_pos", "bit_len", "last", "bytes").mapInArrow(work, f"`{key}` string, same boolean")
    return held.groupBy(key).agg(F.bool_and("same").alias("same"))
