"""The library's queries over the driver's tables, and the same in SQL.

Level 1 is used where the number of blocks matters, as its blocks are the smallest.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import kernels as K
from quern.functions.columns import block_crc, compress, continued_crc, decompress, extract_bits, fold_crc, max_block_bytes, ratio, read_u32
from quern.operators import decode, encode, markers, stats
from quern.plans.batches import pulled_longs
from quern.plans.spread import spread
from quern.plans.storage import fresh_folder, stored
from quern.sources.bzip2 import same_streams, write_files, write_streams
from quern.sources.files import located
from quern.streaming.batches import write_stream
from quern.streaming.files import DecoderOptions, EncoderOptions

SIZE_1 = K.max_block_bytes(1)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _work(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table whose values are to be encoded."""
    return spread(_table(spark, sf_dir, name).select(*columns))


def _bytes(c: str):
    return F.encode(F.col(c), "utf-8")


def _text(c):
    return F.decode(c, "utf-8")


def roundtrip_documents(spark, sf_dir):
    return _work(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", _text(decompress(compress(_bytes("text")))).alias("text"))


def roundtrip_pages(spark, sf_dir):
    return _work(spark, sf_dir, "pages", "page_id", "html").select("page_id", _text(decompress(compress(_bytes("html"), 1))).alias("html"))


def roundtrip_conversations(spark, sf_dir):
    return _work(spark, sf_dir, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", _text(decompress(compress(_bytes("text"), 5))).alias("text"))


def encode_decode_documents(spark, sf_dir):
    """Blocks and markers as rows of tables, both ways; null texts stay null."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", _bytes("text").alias("data"))
    files = stored(encode.encode(spread(docs), "doc_id", "data", 1).select(F.col("doc_id").cast("string").alias("file"), "content"), "files")
    whole = decode.whole_values(decode.decode(files)).withColumnRenamed("file", "_file")
    kept = docs.select("doc_id", F.when(F.col("data").isNotNull(), "").alias("_empty"))
    return kept.join(whole, F.col("doc_id").cast("string") == F.col("_file"), "left").select("doc_id", F.coalesce(_text(F.col("data")), "_empty").alias("text"))


def _blocks(spark, sf_dir, key):
    """All documents of a key as one run of bytes in blocks, encoded."""
    docs = _table(spark, sf_dir, "documents").select(key, "doc_id", _bytes("text").alias("data"))
    return encode.encode_blocks(encode.tile_rows(docs, key, "doc_id", "data", 1), 1)


def _archives(spark, sf_dir, key="lang", damaged=None):
    """A folder with one file of one stream for each key, written by all tasks; ``damaged`` changes the blocks before."""
    path, blocks = fresh_folder(spark, "archives"), _blocks(spark, sf_dir, key)
    write_streams(damaged(blocks) if damaged else blocks, key, path, 1, _table(spark, sf_dir, "documents").select(key))
    return path


def _key(file="file"):
    """The key of an archive's path; the keys here need no quoting."""
    return F.regexp_extract(file, "=([^/]*)[.]bz2$", 1)


def archive_roundtrip_by_lang(spark, sf_dir):
    blocks = decode.decode_files(spark, _archives(spark, sf_dir))
    return blocks.groupBy(_key().alias("lang")).agg(F.sum(F.octet_length("data")).cast("long").alias("total_bytes"), F.count("*").alias("n_blocks"))


def archive_text_by_source(spark, sf_dir):
    whole = decode.whole_values(decode.decode_files(spark, _archives(spark, sf_dir, "source")))
    return whole.select(_key().alias("source"), F.md5("data").alias("digest"))


def block_layout(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", _bytes("text").alias("data"))
    return encode.split_blocks(docs, "doc_id", "data", 1).select("doc_id", "block_idx", "offset", F.octet_length("data").cast("long").alias("length"))


def tile_layout(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("lang", "doc_id", _bytes("text").alias("data"))
    return encode.tile_rows(docs, "lang", "doc_id", "data", 1).select("lang", "block_idx", F.octet_length("data").cast("long").alias("length"))


def block_sizes(spark, sf_dir):
    return spark.range(1, 10).select(F.col("id").cast("int").alias("level"), max_block_bytes(F.col("id")).alias("bytes"))


def part_name_crc(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", block_crc(_bytes("p_name")).alias("crc"))


def stream_crc_by_brand(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select("p_brand", "p_partkey", block_crc(_bytes("p_name")).alias("crc"))
    p = p.selectExpr("p_brand", "crc", "row_number() over (partition by p_brand order by p_partkey) - 1 as i", "count(*) over (partition by p_brand) as n")
    return p.groupBy("p_brand").agg(fold_crc(F.col("crc"), F.col("i"), F.col("n")).alias("stream_crc"))


def crc_in_two_steps(spark, sf_dir):
    """The checksum of a name, continued after its first five bytes."""
    p = _table(spark, sf_dir, "part").select("p_partkey", _bytes("p_name").alias("b"))
    return p.select("p_partkey", continued_crc(block_crc(F.substring("b", 1, 5)), F.expr("substring(b, 6)")).alias("crc"))


def bits_of_part_names(spark, sf_dir):
    """32 bits from bit 5 on, and the bits [3, 27) in hex digits."""
    return _table(spark, sf_dir, "part").select("p_partkey", read_u32(_bytes("p_name"), 5).alias("u32"), F.lower(F.hex(extract_bits(_bytes("p_name"), 3, 27))).alias("cut"))


#: file, first bit, kind, checksum, level of a header that follows. In c the end at 700 only looks like one.
MARKERS = [
    *[("a", b, k, c, n) for b, k, c, n in ((0, "H", 0, 9), (32, "B", 1, None), (500, "B", 2, None), (1000, "B", 3, None), (1500, "E", 4, None))],
    *[("b", b, k, c, n) for b, k, c, n in ((0, "H", 0, 1), (1000, "B", 6, None), (32, "B", 5, None), (1500, "E", 7, 2), (1616, "E", 0, 3), (1728, "B", 8, None), (2400, "E", 9, None))],
    *[("c", b, k, c, n) for b, k, c, n in ((0, "H", 0, 5), (32, "B", 1, None), (700, "E", 2, None), (900, "B", 3, None), (1300, "E", 4, None))],
]


def _literal_markers(spark):
    return spark.createDataFrame(MARKERS, "file string, bit_offset bigint, kind string, crc bigint, next_level int")


def pair_markers(spark, sf_dir):
    return markers.block_ranges(_literal_markers(spark)).select("file", "stream_idx", "block_idx", "level", "start_bit", "end_bit")


def find_streams(spark, sf_dir):
    return markers.streams(_literal_markers(spark))


def failure_groups(spark, sf_dir):
    """A failure wherever a line item was returned; each order is a stream, each line a block."""
    s = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.col("l_returnflag") == "R").alias("returned"))
    s = s.selectExpr("'x' as file", "l_orderkey as stream_idx", "l_linenumber as block_idx", "cast(l_linenumber as bigint) * 100 as start_bit", "cast(l_linenumber as bigint) * 100 + 100 as end_bit", "not returned as ok")
    return decode.failure_groups(s).select("stream_idx", "first_idx", "last_idx", "start_bit", "end_bit")


def _flip(content, at: int):
    """One byte inverted, counted from the end if negative."""
    i = F.lit(at) if at >= 0 else F.octet_length(content) + at
    byte = F.lit(255) - F.conv(F.hex(F.substring(content, i + 1, F.lit(1))), 16, 10).cast("int")
    return F.concat(F.substring(content, F.lit(1), i), F.unhex(F.lpad(F.hex(byte), 2, "0")), F.substring(content, i + 2, F.octet_length(content)))


def corruption_report(spark, sf_dir):
    """Of every three documents one has its twelfth and one its fourth last byte damaged."""
    files = _work(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", compress(_bytes("text"), 9).alias("content"))
    kind = F.col("doc_id") % 3
    # Byte 12 is in the block's checksum, in an empty stream in the stream's, as the fourth byte from the end always is.
    files = files.select(F.col("doc_id").cast("string").alias("file"), F.when(kind == 1, _flip("content", 12)).when(kind == 2, _flip("content", -4)).otherwise(F.col("content")).alias("content"))
    status = F.when(F.col("bad_blocks") > 0, "bad block").when(F.col("bad_streams") > 0, "bad stream").when(F.col("error").isNotNull(), F.col("error")).when(F.col("n_streams") > 0, "ok")
    return decode.checked_values(files).select(F.col("file").cast("long").alias("doc_id"), status.alias("status"))


def unverified_streams(spark, sf_dir):
    """Streams whose checksum is wrong, decoded without a look at it."""
    files = _work(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", _flip(compress(_bytes("text"), 1), -4).alias("content"))
    return files.select("doc_id", _text(decompress(F.col("content"), verify_stream_crc=False)).alias("text"), decompress(F.col("content"), mode="PERMISSIVE").isNull().alias("refused"))


def blocks_before_error(spark, sf_dir):
    """The second block of each document archive is damaged: one is left."""
    hurt = F.when(F.col("block_idx") == 1, _flip("bits", 40)).otherwise(F.col("bits"))
    path = _archives(spark, sf_dir, damaged=lambda e: e.withColumn("bits", hurt))
    left = decode.before_first_error(decode.decode_files(spark, path, mode="PERMISSIVE"))
    return left.groupBy(_key().alias("lang")).agg(F.count("*").alias("n_blocks"), F.sum(F.octet_length("data")).cast("long").alias("n_bytes"))


def false_marker_recovery(spark, sf_dir):
    """Up to 20 false block markers are put into every range; the texts come out whole."""
    files = _work(spark, sf_dir, "documents", "doc_id", "text").select(F.col("doc_id").cast("string").alias("file"), compress(_bytes("text"), 1).alias("content"))
    files = stored(files, "files")
    m = decode.frozen(markers.markers(files))
    n = F.col("file").cast("long") % 21
    at = F.explode(F.transform(F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<long>")), lambda j: F.expr("start_bit") + F.floor((F.col("end_bit") - F.col("start_bit")) * j / (n + 1))))
    false = markers.block_ranges(m).select("file", at.alias("bit_offset"), F.lit("B").alias("kind"), F.lit(0).cast("long").alias("crc"), F.lit(None).cast("int").alias("next_level"))
    ranges, _ = decode.value_ranges(decode.frozen(m.unionByName(false)), files)
    whole = decode.whole_values(decode.decode_value_blocks(ranges, files)).withColumnRenamed("file", "_file")
    kept = files.select("file", F.when(F.col("content").isNotNull(), "").alias("_empty"))
    return kept.join(whole, F.col("file") == F.col("_file"), "left").select(F.col("file").cast("long").alias("doc_id"), F.coalesce(_text(F.col("data")), "_empty").alias("text"))


def multi_stream_decode(spark, sf_dir):
    """Each turn is a stream of its own, with a level of its own; a conversation is their concatenation."""
    c = _work(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    c = c.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, compress(_bytes("text"), 1)).otherwise(compress(_bytes("text"), 9)).alias("content"))
    c = c.groupBy("conv_id").agg(F.expr("listagg(content) within group (order by turn)").alias("content"))
    return c.select("conv_id", _text(decompress(F.col("content"))).alias("text"))


def marker_counts(spark, sf_dir):
    m = markers.file_markers(spark, _archives(spark, sf_dir), 1 << 18)
    return m.groupBy(_key().alias("lang")).agg(F.count_if(F.col("kind") == "E").alias("n_streams"), F.count_if(F.col("kind") == "B").alias("n_blocks"))


def stream_checks(spark, sf_dir):
    m = decode.frozen(markers.file_markers(spark, _archives(spark, sf_dir), 1 << 18))
    results = decode.decode_file_blocks(markers.block_ranges(m), payload=False)
    return decode.stream_check(results, markers.streams(m)).select(_key().alias("lang"), "stream_idx", "ok")


def placed_reassembly(spark, sf_dir):
    """Files of blocks written in any order, against the streams put together in order; both in parts, as a file may exceed a row."""
    e = stored(_blocks(spark, sf_dir, "lang"), "blocks")
    path, keys = fresh_folder(spark, "placed"), _table(spark, sf_dir, "documents").select("lang")
    write_streams(e, "lang", path, 1, keys)
    return same_streams(encode.stream_parts(e, "lang", 1, keys), "lang", path)


def decoder_statistics(spark, sf_dir):
    """The counters; ``whole`` tells whether the last bit consumed is where the last stream's end begins."""
    m = decode.frozen(markers.file_markers(spark, _archives(spark, sf_dir), 1 << 18))
    table = markers.streams(m)
    s = stats.decoder_stats(decode.decode_file_blocks(markers.block_ranges(m)), table)
    last = table.groupBy("file").agg(F.max("eos_bit").alias("b")).agg(F.sum("b").alias("b")).first()["b"]
    return s.select(*[F.col(c).cast("long").alias(c) for c in ("blocks_total", "blocks_completed", "blocks_failed", "streams_total", "bytes_out")], "progress", (F.col("bits_consumed") == last).alias("whole"))


def push_and_pull(spark, sf_dir):
    """Orders' keys, a line each, pushed through the file-like encoder and pulled through the decoder in odd pieces."""
    path = fresh_folder(spark, "pushed") + ".bz2"
    system, name = located(path)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    seen, flushed = [], 0
    with system.open_output_stream(name, compression=None) as out, EncoderOptions(level=1, min_blocks=2, on_progress=seen.append).build(out, spark) as e:
        for k, key in enumerate(pulled_longs(_table(spark, sf_dir, "orders").select("o_orderkey").orderBy("o_orderkey"))):
            e.write(b"%d\n" % key)
            if k == 5000:
                e.flush()
                flushed = out.tell()
    pulled, crcs = [], set()
    digest = hashlib.md5()
    with DecoderOptions(blocks_per_partition=2, part_bytes=1 << 16, on_progress=pulled.append).open(spark, path) as d:
        while piece := d.read(10_007):
            digest.update(piece)
            crcs.add(d.stored_stream_crc)
        s = d.stats
    row = (e.stats.total_in, e.stats.blocks_completed, e.stats.total_out == system.get_file_info(name).size, 1 < e.stats.batches_completed == len(seen) or e.stats.blocks_completed < 3, flushed > 0, s.bytes_out, s.blocks_completed, s.streams_completed, len(pulled) == s.blocks_completed, len(crcs), digest.hexdigest())
    return spark.createDataFrame([row], "total_in long, blocks_in long, all_written boolean, in_batches boolean, flushed boolean, bytes_out long, blocks_out long, n_streams long, all_told boolean, n_checksums long, digest string")


def micro_batches(spark, sf_dir):
    """Part names as a stream, written in micro-batches as .bz2 files, read again by Spark's own text reader."""
    path, checkpoint = fresh_folder(spark, "stream"), fresh_folder(spark, "progress")
    names = spark.readStream.schema(_table(spark, sf_dir, "part").schema).option("pathGlobFilter", "part.parquet").parquet(sf_dir).select("p_name")
    write_stream(names, path, checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.text(f"{path}/batch=*/*.bz2").select(F.col("value").alias("p_name"))


def encoder_statistics(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", _bytes("text").alias("data"))
    return stats.encoder_stats(encode.encode_blocks(encode.split_blocks(spread(docs), "doc_id", "data"), 9))


def encoder_counts(spark, sf_dir):
    """What of the statistics does not depend on the codec."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", _bytes("text").alias("data"))
    return stats.encoder_stats(encode.encode_blocks(encode.split_blocks(spread(docs), "doc_id", "data", 1), 1)).select(F.col("total_in").cast("long").alias("total_in"), "blocks_completed")


def byte_ranges(spark, sf_dir):
    """The bytes [70000, 90000) of each language's archive, from the blocks that hold them."""
    results = decode.decode_files(spark, _archives(spark, sf_dir))
    parts = decode.read_bytes(results, 70_000, 20_000)
    return parts.select(_key().alias("lang"), "offset", F.octet_length("data").cast("long").alias("length"), F.md5("data").alias("digest"))


def compression_by_lang(spark, sf_dir):
    docs = _work(spark, sf_dir, "documents", "lang", "text").select("lang", _bytes("text").alias("data")).select("lang", F.octet_length("data").alias("n"), F.octet_length(compress(F.col("data"))).alias("z"))
    return docs.groupBy("lang").agg(ratio(F.sum("z"), F.sum("n")).alias("compression_ratio"))


def compression_gains(spark, sf_dir):
    """Whether text shrinks, by language."""
    return compression_by_lang(spark, sf_dir).select("lang", F.col("compression_ratio").between(0.01, 0.9).alias("smaller"))


def ratios(spark, sf_dir):
    """Rates of the events' values; none where the values sum to nothing."""
    e = _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") < 0).alias("below"))
    return e.select("event_type", ratio(F.col("below"), F.col("n")).alias("share"), ratio(F.col("n"), F.col("below")).alias("inverse"))


def file_roundtrip(spark, sf_dir):
    """Written as .bz2 files by the sink, read again in small parts, all blocks of all files at once."""
    path = fresh_folder(spark, "files")
    docs = _table(spark, sf_dir, "documents").select(_bytes("text").alias("data"))
    write_files(spread(docs), path, 1)
    blocks = decode.decode_files(spark, path, part_bytes=1 << 18)
    return blocks.agg(F.sum(F.octet_length("data")).cast("long").alias("total_bytes"))


def text_files(spark, sf_dir):
    """Part names written by the sink as lines, read by Spark's own text reader."""
    path = fresh_folder(spark, "lines")
    write_files(_table(spark, sf_dir, "part").select("p_name").repartition(3), path, 9, line_end="\n")
    return spark.read.text(path).select(F.col("value").alias("p_name"))


QUERIES = {
    f.__name__: f
    for f in (
        roundtrip_documents, roundtrip_pages, roundtrip_conversations, encode_decode_documents, archive_roundtrip_by_lang, archive_text_by_source, block_layout, tile_layout, block_sizes,
        part_name_crc, stream_crc_by_brand, bits_of_part_names, pair_markers, find_streams, failure_groups, corruption_report, blocks_before_error, false_marker_recovery,
        multi_stream_decode, marker_counts, stream_checks, placed_reassembly, decoder_statistics, encoder_counts, byte_ranges, encoder_statistics, compression_by_lang, compression_gains, ratios, file_roundtrip, text_files,
        crc_in_two_steps, unverified_streams, push_and_pull, micro_batches,
    )
}


def _crc_table() -> list[int]:
    """Remainders of all bytes by the polynomial, most significant bit first."""
    out = []
    for b in range(256):
        r = b << 24
        for _ in range(8):
            r = (r << 1) ^ (0x104C11DB7 if r >> 31 else 0)
        out.append(r)
    return out


_CRC = f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(p_name) + 1), lambda i: ord(substr(p_name, i::INT, 1))::BIGINT)),
    lambda a, b: xor((a << 8) & 4294967295, ({_crc_table()}::BIGINT[])[(xor(a >> 24, b) + 1)::INT])))"""
_VALUES = ", ".join(f"('{f}', {b}::BIGINT, '{k}', {c}::BIGINT, {'NULL' if n is None else n}::INT)" for f, b, k, c, n in MARKERS)
_MARKED = f"""t AS (SELECT *, max(CASE WHEN kind = 'E' THEN b END) OVER (PARTITION BY file) AS last_end FROM (VALUES {_VALUES}) v(file, b, kind, crc, nl)),
    u AS (SELECT * FROM t WHERE kind <> 'E' OR nl IS NOT NULL OR b = last_end)"""
_SIZES = "SELECT lang, sum(octet_length(encode(text)))::BIGINT AS n FROM documents GROUP BY lang"

ORACLES = {
    "roundtrip_documents": "SELECT doc_id, text FROM documents",
    "roundtrip_pages": "SELECT page_id, html FROM pages",
    "roundtrip_conversations": "SELECT conv_id, turn, text FROM conversations",
    "encode_decode_documents": "SELECT doc_id, text FROM documents",
    "archive_roundtrip_by_lang": f"SELECT lang, n AS total_bytes, (n + {SIZE_1 - 1}) // {SIZE_1} AS n_blocks FROM ({_SIZES})",
    "archive_text_by_source": "SELECT source, md5(string_agg(text, '' ORDER BY doc_id)) AS digest FROM documents GROUP BY source",
    "block_layout": f"SELECT doc_id, i::INT AS block_idx, i * {SIZE_1} AS \"offset\", least({SIZE_1}, n - i * {SIZE_1})::BIGINT AS length FROM (SELECT doc_id, octet_length(encode(text)) AS n, unnest(range(0, (octet_length(encode(text)) + {SIZE_1 - 1}) // {SIZE_1})) AS i FROM documents)",
    "tile_layout": f"SELECT lang, i::INT AS block_idx, least({SIZE_1}, n - i * {SIZE_1})::BIGINT AS length FROM (SELECT lang, n, unnest(range(0, (n + {SIZE_1 - 1}) // {SIZE_1})) AS i FROM ({_SIZES}))",
    "block_sizes": "SELECT i::INT AS level, (i * 100000 - 19) * 4 // 5 AS bytes FROM range(1, 10) t(i)",
    "part_name_crc": f"SELECT p_partkey, {_CRC} AS crc FROM part",
    "stream_crc_by_brand": f"SELECT p_brand, list_reduce(list_prepend(0::BIGINT, list(c ORDER BY p_partkey)), lambda a, b: xor(((a << 1) | (a >> 31)) & 4294967295, b)) AS stream_crc FROM (SELECT p_brand, p_partkey, {_CRC} AS c FROM part) GROUP BY p_brand",
    "bits_of_part_names": "SELECT p_partkey, ((((b[1] << 32) | (b[2] << 24) | (b[3] << 16) | (b[4] << 8) | b[5]) >> 3) & 4294967295)::BIGINT AS u32, lower(printf('%06x', (((b[1] << 24) | (b[2] << 16) | (b[3] << 8) | b[4]) >> 5) & 16777215)) AS cut FROM (SELECT p_partkey, list_transform(range(1, 6), lambda i: coalesce(ord(nullif(substr(p_name, i::INT, 1), '')), 0)::BIGINT) AS b FROM part)",
    "pair_markers": f"""WITH {_MARKED}, w AS (SELECT file, kind, b, coalesce(sum(CASE WHEN kind = 'E' THEN 1 ELSE 0 END) OVER (x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS stream_idx, last_value(nl IGNORE NULLS) OVER (x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS level, lead(b) OVER x AS end_bit FROM u WINDOW x AS (PARTITION BY file ORDER BY b))
        SELECT file, stream_idx, (row_number() OVER (PARTITION BY file, stream_idx ORDER BY b) - 1)::INT AS block_idx, level, b AS start_bit, end_bit FROM w WHERE kind = 'B'""",
    "find_streams": f"""WITH {_MARKED}, w AS (SELECT *, sum(CASE WHEN kind = 'B' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY b) AS blocks FROM u)
        SELECT file, (row_number() OVER x - 2)::INT AS stream_idx, lag(nl) OVER x AS level, CASE WHEN lag(kind) OVER x = 'H' THEN 0 ELSE (lag(b) OVER x + 87) // 8 END::BIGINT AS header_byte, b AS eos_bit, crc AS stored_stream_crc, (blocks - lag(blocks) OVER x)::BIGINT AS n_ranges
        FROM w WHERE kind <> 'B' WINDOW x AS (PARTITION BY file ORDER BY b) QUALIFY kind = 'E'""",
    "failure_groups": """WITH s AS (SELECT l_orderkey AS o, l_linenumber AS k, max(l_returnflag = 'R') AS bad FROM lineitem GROUP BY ALL),
        r AS (SELECT *, k - row_number() OVER (PARTITION BY o, bad ORDER BY k) AS run, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY o ORDER BY k) AS good FROM s)
        SELECT o AS stream_idx, min(k) AS first_idx, max(k) AS last_idx, min(k)::BIGINT * 100 AS start_bit, max(k)::BIGINT * 100 + 100 AS end_bit FROM r WHERE bad GROUP BY o, good""",
    "corruption_report": "SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN doc_id % 3 = 0 THEN 'ok' WHEN doc_id % 3 = 1 AND length(text) > 0 THEN 'bad block' ELSE 'bad stream' END AS status FROM documents",
    "unverified_streams": "SELECT doc_id, text, true AS refused FROM documents",
    "crc_in_two_steps": f"SELECT p_partkey, {_CRC} AS crc FROM part",
    "compression_gains": "SELECT DISTINCT lang, true AS smaller FROM documents",
    "micro_batches": "SELECT p_name FROM part",
    "push_and_pull": f"""WITH t AS (SELECT string_agg(o_orderkey || chr(10), '' ORDER BY o_orderkey) AS t FROM orders), n AS (SELECT t, length(t)::BIGINT AS n, (length(t) + {SIZE_1 - 1}) // {SIZE_1} AS b FROM t)
        SELECT n AS total_in, b AS blocks_in, true AS all_written, true AS in_batches, (SELECT count(*) > 5000 FROM orders) AS flushed, n AS bytes_out, b AS blocks_out, 1::BIGINT AS n_streams, true AS all_told, 1::BIGINT AS n_checksums, md5(t) AS digest FROM n""",
    "blocks_before_error": f"SELECT lang, 1::BIGINT AS n_blocks, least(n, {SIZE_1}) AS n_bytes FROM ({_SIZES})",
    "false_marker_recovery": "SELECT doc_id, text FROM documents",
    "multi_stream_decode": "SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id",
    "marker_counts": f"SELECT lang, 1::BIGINT AS n_streams, (n + {SIZE_1 - 1}) // {SIZE_1} AS n_blocks FROM ({_SIZES})",
    "stream_checks": "SELECT DISTINCT lang, 0 AS stream_idx, true AS ok FROM documents",
    "placed_reassembly": "SELECT DISTINCT lang, true AS same FROM documents",
    "decoder_statistics": f"SELECT sum(b)::BIGINT AS blocks_total, sum(b)::BIGINT AS blocks_completed, 0::BIGINT AS blocks_failed, count(*) AS streams_total, sum(n)::BIGINT AS bytes_out, 1.0::DOUBLE AS progress, true AS whole FROM (SELECT n, (n + {SIZE_1 - 1}) // {SIZE_1} AS b FROM ({_SIZES}))",
    "encoder_counts": f"SELECT sum(n)::BIGINT AS total_in, sum((n + {SIZE_1 - 1}) // {SIZE_1})::BIGINT AS blocks_completed FROM (SELECT octet_length(encode(text)) AS n FROM documents)",
    "byte_ranges": f"""WITH h AS (SELECT lang, hex(encode(string_agg(text, '' ORDER BY doc_id))) AS h FROM documents GROUP BY lang),
        r AS (SELECT lang, h, greatest(i * {SIZE_1}, 70000)::BIGINT AS a, (least((i + 1) * {SIZE_1}, length(h) // 2, 90000) - greatest(i * {SIZE_1}, 70000))::BIGINT AS n FROM h, range(0, 2) t(i))
        SELECT lang, a AS "offset", n AS length, md5(unhex(substr(h, (2 * a + 1)::BIGINT, (2 * n)::BIGINT))) AS digest FROM r WHERE n > 0""",
    "ratios": "SELECT event_type, count(*) FILTER (value < 0) / count(*) AS share, CASE WHEN count(*) FILTER (value < 0) = 0 THEN 0.0::DOUBLE ELSE count(*) / count(*) FILTER (value < 0) END AS inverse FROM events GROUP BY event_type",
    "file_roundtrip": "SELECT sum(octet_length(encode(text)))::BIGINT AS total_bytes FROM documents",
    "text_files": "SELECT p_name FROM part",
}
