import bz2

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quern.functions import kernels as K
from quern.functions.columns import compress, decompress, fold_crc, max_block_bytes, ratio
from quern.operators import decode, encode, markers, stats
from quern.plans.prefix import prefix_sum
from quern.sources.bzip2 import file_name, register, same_streams, write_files, write_streams
from quern.streaming.batches import read_stream, write_stream
from tests.test_kernels import lcg


def frame(spark, rows):
    return spark.createDataFrame([(k, bytearray(v) if v is not None else None) for k, v in rows], "file string, content binary")


DATA = {"small": b"hello", "empty": b"", "large": lcg(3, 250_000), "text": b"a line of text\n" * 9000}


def test_column_codec(spark):
    df = frame(spark, [*DATA.items(), ("null", None)])
    got = {r[0]: r[1:] for r in df.select("file", compress(F.col("content"), 1), decompress(compress(F.col("content"), 1))).collect()}
    assert got.pop("null") == (None, None)
    for k, (z, back) in got.items():
        assert bz2.decompress(bytes(z)) == DATA[k] == bytes(back)


def test_column_modes(spark):
    df = frame(spark, [("bad", b"no bzip2"), ("good", bz2.compress(b"x"))])
    got = dict(df.select("file", decompress(F.col("content"), mode="PERMISSIVE")).collect())
    assert got["bad"] is None and bytes(got["good"]) == b"x"
    with pytest.raises(PySparkException, match="no streams"):
        df.select(decompress(F.col("content"))).collect()
    with pytest.raises(ValueError):
        decompress(F.col("content"), mode="OTHER")


def test_table_codec(spark):
    df = frame(spark, DATA.items())
    out = {r["file"]: bytes(r["content"]) for r in encode.encode(df, "file", "content", 1).collect()}
    assert {k: bz2.decompress(v) for k, v in out.items()} == DATA
    assert out == {k: K.compress(v, 1) for k, v in DATA.items()}
    blocks = decode.decode(frame(spark, out.items()))
    back = {r["file"]: bytes(r["data"]) for r in decode.whole_values(blocks).collect()}
    assert back == {k: v for k, v in DATA.items() if v}


def test_foreign_streams_decode(spark):
    files = {k: bz2.compress(v, 1) + bz2.compress(b"tail", 7) for k, v in DATA.items()}
    back = decode.whole_values(decode.decode(frame(spark, files.items())))
    assert {r["file"]: bytes(r["data"]) for r in back.collect()} == {k: v + b"tail" for k, v in DATA.items()}


def test_empty_tables(spark):
    none = frame(spark, [("x", b"y")]).where("false")
    assert encode.encode(none, "file", "content").count() == 0
    assert markers.markers(none).count() == 0
    assert decode.decode(none).count() == 0
    assert stats.encoder_stats(encode.encode_blocks(encode.split_blocks(none, "file", "content"))).first()["compression_ratio"] == 0.0


def test_failfast_and_permissive(spark):
    block, stream = bytearray(K.compress(DATA["large"], 1)), bytearray(K.compress(DATA["text"], 1))
    block[20_000] ^= 0xFF
    stream[-3] ^= 0xFF
    for name, data, why in (("b", block, "block"), ("s", stream, "stream checksum"), ("n", b"nothing", "no streams")):
        df = frame(spark, [(name, bytes(data)), ("good", K.compress(b"good"))])
        with pytest.raises(PySparkException, match=why):
            decode.decode(df).collect()
    df = frame(spark, [("b", bytes(block))])
    rows = decode.decode(df, mode="PERMISSIVE").orderBy("block_idx").collect()
    assert [r["crc_valid"] for r in rows] == [False, True, True, True]
    assert decode.before_first_error(decode.decode(df, mode="PERMISSIVE")).count() == 0
    assert decode.decode(frame(spark, [("s", bytes(stream))]), verify_stream_crc=False).count() == 2


def test_format_errors(spark):
    late = K.compress(b"x", 1) + K.compress(DATA["large"], 1)[:60_000]
    df = frame(spark, [("none", b"abc"), ("late", late), ("good", K.compress(b"a")), ("zero", b"")])
    got = dict(markers.format_errors(markers.markers(df), df).collect())
    assert got == {"none": "no streams", "late": "blocks after the last stream", "zero": "no streams"}


def test_archive_in_order(spark):
    rows = [("k", i, bytearray(lcg(i, 1000 * (i % 7)))) for i in range(120)] + [("other", 5, bytearray(b"z")), (None, 1, bytearray(b"n"))]
    df = spark.createDataFrame(rows, "key string, n long, v binary")
    got = {r["key"]: bz2.decompress(bytes(r["content"])) for r in encode.archive(df, "key", "n", "v", 1).collect()}
    assert got["k"] == b"".join(bytes(v) for k, _, v in rows if k == "k") and got["other"] == b"z"


def test_prefix_sum_over_stretches(spark):
    df = spark.range(0, 100_000, 7).select(F.lit("a").alias("k"), F.col("id").alias("o"), (F.col("id") % 10).alias("v"))
    rows = prefix_sum(df, "k", "o", "v", "p").orderBy("o").collect()
    total = 0
    for r in rows:
        assert r["p"] == total
        total += r["v"]


@pytest.mark.parametrize("crcs", [[], [1], [0x12345678, 0xABCDEF01], list(range(1, 100))])
def test_fold_in_any_order(spark, crcs):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(crcs)], "i long, c long").repartition(3)
    got = df.agg(fold_crc(F.col("c"), F.col("i"), F.lit(len(crcs))).alias("c")).first()["c"]
    assert got == K.fold_crcs(crcs)


def test_block_sizes_and_ratio(spark):
    got = spark.range(1, 10).select(max_block_bytes(F.col("id")).alias("n")).collect()
    assert [r["n"] for r in got] == [K.max_block_bytes(k) for k in range(1, 10)]
    got = spark.sql("select 1 as a, 0 as z, cast(null as int) as n").select(ratio(F.col("a"), F.col("z")), ratio(F.col("a"), F.col("n")), ratio(F.col("a"), F.lit(4))).first()
    assert tuple(got) == (0.0, 0.0, 0.25)


def test_failure_groups(spark):
    df = spark.createDataFrame([("f", 0, i, i * 10, i * 10 + 10, ok) for i, ok in enumerate([True, False, False, True, False])], "file string, stream_idx int, block_idx int, start_bit long, end_bit long, ok boolean")
    got = sorted(tuple(r)[2:] for r in decode.failure_groups(df).collect())
    assert got == [(1, 2, 10, 30), (4, 4, 40, 50)]


@pytest.mark.parametrize("part", [1 << 12, 1 << 20])
def test_files_in_parts(spark, tmp_path, part):
    data = {f"{i}.bz2": lcg(i, 200_000) for i in range(3)}
    for k, v in data.items():
        (tmp_path / k).write_bytes(bz2.compress(v, 1))
    (tmp_path / "_hidden").write_bytes(b"junk")
    got = decode.whole_values(decode.decode_files(spark, str(tmp_path), part_bytes=part))
    assert {r["file"].rpartition("/")[2]: bytes(r["data"]) for r in got.collect()} == data
    whole = markers.file_markers(spark, str(tmp_path), 1 << 30).count()
    assert markers.file_markers(spark, str(tmp_path), part).count() == whole


def test_missing_path(spark, tmp_path):
    with pytest.raises((FileNotFoundError, PySparkException)):
        decode.decode_files(spark, str(tmp_path / "none")).collect()


def test_sink(spark, tmp_path):
    df = spark.range(5000).select(F.concat(F.lit("row "), F.col("id").cast("string")).alias("v")).repartition(3)
    path = str(tmp_path / "out")
    write_files(df, path, 1, line_end="\n")
    want = {r[0] for r in df.collect()}
    assert {r[0] for r in spark.read.text(path).collect()} == want
    write_files(df.limit(10), path, 9, mode="overwrite", line_end="\n")
    assert spark.read.text(path).count() == 10
    write_files(df.limit(10), path, 9, line_end="\n")
    assert spark.read.text(path).count() == 20


def test_failed_write_leaves_nothing(spark, tmp_path):
    path = tmp_path / "out"
    bad = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error("stop").cast("string")).otherwise("x").alias("v"))
    with pytest.raises(PySparkException):
        write_files(bad, str(path))
    assert not path.exists() or not [p for p in path.iterdir() if not p.name.startswith("_")]


def test_sink_arguments(spark, tmp_path):
    for df, level in ((spark.range(1), 9), (spark.sql("select 'x' as v"), 0)):
        with pytest.raises((PySparkException, K.InvalidFormat)):
            df.write.format(register(spark)).option("level", level).mode("append").save(str(tmp_path / "o"))


def test_stats_and_observation(spark):
    df = frame(spark, [("a", K.compress(DATA["large"], 1)), ("e", K.compress(b""))])
    m = markers.markers(df)
    results = decode.decode_value_blocks(markers.block_ranges(m), df)
    r = stats.decoder_stats(results, markers.streams(m), 2.0).first()
    assert (r["blocks_total"], r["blocks_completed"], r["blocks_failed"], r["streams_total"], r["bytes_out"], r["progress"]) == (4, 4, 0, 2, 250_000, 1.0)
    assert r["decompression_rate"] == 125_000
    watched, o = stats.observed(results)
    watched.collect()
    assert o.get["blocks"] == 4 and o.get["failed"] == 0


def test_micro_batches(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("one\ntwo\n")
    (source / "b.txt").write_text("three\n")
    out = str(tmp_path / "out")
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(str(source))
    write_stream(lines, out, str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    assert {r[0] for r in spark.read.text(f"{out}/batch=*/*.bz2").collect()} == {"one", "two", "three"}
    back = read_stream(spark, out).select("data")
    q = back.writeStream.format("memory").queryName("decoded").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(b"".join(bytes(r[0]) for r in spark.table("decoded").collect()).split()) == [b"one", b"three", b"two"]


def with_false_markers(data, level, n):
    """A file's markers with ``n`` false ones in each of its ranges."""
    m = K.scan(data)
    rows = markers.marker_rows("f", data)
    for s in K.find_streams(data, m):
        rows += [("f", a + (z - a) * j // (n + 1), "B", 0, None) for a, z in s.ranges for j in range(1, n + 1)]
    return rows


@pytest.mark.parametrize("n", [0, 1, 9, 25])
def test_failure_groups_of_any_length(spark, tmp_path, n):
    data = K.compress(DATA["large"], 1) + K.compress(DATA["text"], 1)
    (tmp_path / "f.bz2").write_bytes(data)
    path = str(tmp_path / "f.bz2")
    df = frame(spark, [("f", data)])
    m = spark.createDataFrame(with_false_markers(data, 1, n), "file string, bit_offset bigint, kind string, crc bigint, next_level int")
    ranges, doubtful = decode.value_ranges(m, df)
    assert (doubtful is None) == (n == 0)
    rows = decode.decode_value_blocks(ranges, df).orderBy("stream_idx", "block_idx").collect()
    assert b"".join(bytes(r["data"]) for r in rows) == DATA["large"] + DATA["text"] and [r["block_idx"] for r in rows] == [0, 1, 2, 3, 0, 1]
    named = m.withColumn("file", F.lit(path))
    assert decode.decode_file_blocks(decode.file_ranges(named)[0]).where("crc_valid").count() == 6


def test_bad_blocks_beside_false_markers(spark):
    """What no neighbour makes whole stays an error; the good blocks around it are decoded."""
    data = bytearray(K.compress(DATA["large"], 1))
    second = K.find_streams(bytes(data), K.scan(bytes(data)))[0].ranges[1]
    rows = [("f", (second[0] + second[1]) // 2, "B", 0, None), *markers.marker_rows("f", bytes(data))]
    data[second[0] // 8 + 300] ^= 0xFF
    m = spark.createDataFrame(rows, "file string, bit_offset bigint, kind string, crc bigint, next_level int")
    df = frame(spark, [("f", bytes(data))])
    got = decode.decode_value_blocks(decode.value_ranges(m, df)[0], df).orderBy("start_bit").collect()
    assert [r["crc_valid"] for r in got if r["crc_valid"]] == [True] * 3 and not all(r["crc_valid"] for r in got)


def test_ends_beyond_any_block_are_not_tried():
    data = K.compress(DATA["small"], 1)
    asked = []

    def window(a, z):
        asked.append(z)
        return b"", a

    ranges = [(32, 500), (500, 900), (900, K.longest_block(1) + 10_000)]
    found = list(K.true_blocks(window, ranges, 1))
    assert [x[0] for x in found] == [32, 500, 900] and all(x[5] for x in found) and len(data) > 0
    assert asked.count((K.longest_block(1) + 10_007) // 8) == 1


def test_large_values_agree(spark, monkeypatch):
    files = [(k, bz2.compress(v, 1) + K.compress(b"tail", 7)) for k, v in DATA.items()] + [("null", None)]
    df = frame(spark, files)
    want = sorted(map(tuple, decode.decode(df).collect()))
    monkeypatch.setattr(decode, "IN_PLACE", 0)
    assert sorted(map(tuple, decode.decode(df).collect())) == want


def test_no_payload_is_exchanged(spark, tmp_path, capsys):
    (tmp_path / "f.bz2").write_bytes(K.compress(DATA["large"], 1))
    decode.decode_files(spark, str(tmp_path)).select("file", "stream_idx", "block_idx", "data").explain()
    plan = capsys.readouterr().out
    above = plan[: plan.index("MapInArrow")]
    assert not any(x in above for x in ("Exchange", "Sort", "Window", "Join"))


def test_streams_written_by_many_tasks(spark, tmp_path):
    rows = [(k, i, bytearray(lcg(i, 3000 * (i % 50)))) for k in ("a/b", "c") for i in range(40)] + [(None, 1, bytearray(b"n")), ("e", 1, bytearray(b""))]
    df = spark.createDataFrame(rows, "key string, n long, v binary")
    e = encode.encode_blocks(encode.tile_rows(df, "key", "n", "v", 1), 1)
    path = str(tmp_path / "out")
    write_streams(e, "key", path, 1, df)
    want = {file_name(k): b"".join(bytes(v) for x, _, v in rows if x == k) for k in ("a/b", "c", None, "e")}
    assert {p.name: bz2.decompress(p.read_bytes()) for p in (tmp_path / "out").iterdir()} == want
    assert (tmp_path / "out" / file_name("c")).read_bytes() == K.compress(want[file_name("c")], 1)
    with pytest.raises(K.InvalidFormat):
        write_streams(e, "key", "mock://somewhere/out", 1)


def test_null_and_repeated_orders(spark):
    rows = [("k", None, bytearray(b"aa")), ("k", 1, bytearray(b"bb")), ("k", 1, bytearray(b"bb")), ("k", 3, None), ("k", 2, bytearray(b"cc")), (None, 5, bytearray(b"x")), (None, None, bytearray(b"y"))]
    df = spark.createDataFrame(rows, "key string, n long, v binary")
    got = {r["key"]: bz2.decompress(bytes(r["content"])) for r in encode.archive(df, "key", "n", "v", 1).collect()}
    assert got == {"k": b"aabbbbcc", None: b"yx"}


def test_checked_values(spark):
    good, block, stream = K.compress(DATA["large"], 1), bytearray(K.compress(DATA["large"], 1)), bytearray(K.compress(DATA["text"], 1))
    block[20_000] ^= 0xFF
    stream[-3] ^= 0xFF
    df = frame(spark, [("g", good), ("b", bytes(block)), ("s", bytes(stream)), ("n", b"abc"), ("null", None), ("e", K.compress(b""))])
    got = {r["file"]: tuple(r)[1:] for r in decode.checked_values(df).collect()}
    assert got == {"g": (1, 4, 0, 0, None), "b": (1, 4, 1, 0, None), "s": (1, 2, 0, 1, None), "n": (0, 0, 0, 0, "no streams"), "null": (None,) * 5, "e": (1, 0, 0, 0, None)}


def test_prefix_sum_goes_on_over_partitions(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "a").alias("k"), F.expr("if(id % 7 = 0, null, id)").alias("o"), (F.col("id") % 10).alias("v"))
    rows = prefix_sum(df, "k", "o", "v", "p").collect()
    for k in ("a", None):
        own = sorted((r for r in rows if r["k"] == k), key=lambda r: (r["o"] is not None, r["o"] or 0, r["p"], r["p"] + r["v"]))
        total = 0
        for r in own:
            assert r["p"] == total
            total += r["v"]


def test_a_failed_write_removes_hidden_files(spark, tmp_path):
    path = tmp_path / "out"
    write_files(spark.range(5).selectExpr("cast(id as string) as v"), str(path))
    bad = spark.range(0, 10, 1, 4).select(F.when(F.col("id") == 9, F.raise_error("stop").cast("string")).otherwise("x").alias("v"))
    with pytest.raises(PySparkException):
        write_files(bad, str(path), mode="overwrite")
    assert spark.read.text(str(path)).count() >= 1 and not [p for p in path.iterdir() if p.name.startswith("_part")]


@pytest.mark.parametrize("longest", [1 << 30, 0])
def test_ranges_of_bytes_broadcast_no_payload(spark, tmp_path, capsys, monkeypatch, longest):
    """Blocks look as small as their ranges once these are there, so all of them were broadcast by the driver."""
    monkeypatch.setattr(decode, "SHORT_RANGE", longest, raising=False)
    (tmp_path / "f.bz2").write_bytes(K.compress(DATA["large"], 1))
    results = decode.decode_files(spark, str(tmp_path))
    part, all_ = decode.read_bytes(results, 70_000, 20_000).orderBy("offset"), decode.byte_offsets(results).orderBy("offset")
    assert b"".join(bytes(r["data"]) for r in part.collect()) == DATA["large"][70_000:90_000]
    assert b"".join(bytes(r["data"]) for r in all_.collect()) == DATA["large"]
    for df in (part, all_):
        df.explain("formatted")  # as it ran
        nodes = capsys.readouterr().out.split("\n\n")
        assert not any(") BroadcastExchange\n" in x and "data#" in x for x in nodes)


def test_streams_are_compared_in_parts(spark, tmp_path, monkeypatch):
    """No part holds more than its run of blocks; together they are the stream; one changed bit or byte too many is seen."""
    monkeypatch.setattr(encode, "PART_BYTES", 160_000)
    df = spark.createDataFrame([(k, i, bytearray(lcg(i, 50_000 + i))) for k in ("a", None) for i in range(9)] + [("b", 1, bytearray(b"b")), ("e", 1, bytearray(b""))], "key string, n long, v binary")
    e = encode.encode_blocks(encode.tile_rows(df, "key", "n", "v", 1), 1).localCheckpoint()
    parts = encode.stream_parts(e, "key", 1, df).localCheckpoint()
    whole = {r["key"]: bytes(r["content"]) for r in encode.assemble(e, "key", 1, df).collect()}
    for k, z in whole.items():
        own, bits, at = sorted((r for r in parts.collect() if r["key"] == k), key=lambda r: r["bit_pos"]), 0, 0
        for r in own:
            assert r["bit_pos"] == at and len(r["bytes"]) < 2 * 90_000
            bits |= int.from_bytes(r["bytes"], "big") << 8 * (len(z) - at // 8 - len(r["bytes"]))
            at += r["bit_len"]
        assert at == 8 * len(z) and bits.to_bytes(len(z), "big") == z and [r["last"] for r in own] == [False] * (len(own) - 1) + [True]
    path = tmp_path / "out"
    write_streams(e, "key", str(path), 1, df)
    assert parts.where("key = 'a'").count() == 3 and dict(same_streams(parts, "key", str(path)).collect()) == dict.fromkeys(["a", None, "b", "e"], True)
    changed = bytearray(whole["a"])
    changed[len(changed) // 2] ^= 1
    (path / file_name("a")).write_bytes(changed)
    (path / file_name("b")).write_bytes(whole["b"] + b"0")
    (path / file_name(None)).unlink()
    assert dict(same_streams(parts, "key", str(path)).collect()) == {"a": False, None: False, "b": False, "e": True}


def test_reassembly_holds_no_whole_stream(spark, sf, capsys):
    from quern.queries import placed_reassembly

    placed_reassembly(spark, sf).explain("formatted")
    assert "content#" not in capsys.readouterr().out


@pytest.mark.parametrize("n", [1, 20])
def test_false_markers_are_passed_in_one_go(monkeypatch, n):
    """However many false markers split a block, it is not decoded anew for each; ends in one byte are told apart."""
    data = K.compress(DATA["large"], 1) + K.compress(b"tail" * 50, 1)
    tries = []
    monkeypatch.setattr(K, "decode_block", lambda *a, f=K.decode_block: tries.append(a) or f(*a))
    for s in K.find_streams(data, K.scan(data)):
        cut = [(a, sorted({a, *(a + (z - a) * j // (n + 1) for j in range(1, n + 1)), z - 3, z - 1})) for a, z in s.ranges]
        starts = [x for _, own in cut for x in own]
        for whole in (data, data[: (s.eos_bit + 7) // 8]):  # with and without what follows the last block
            tries.clear()
            got = list(K.true_blocks(lambda a, z: (whole[a:z], a), list(zip(starts, [*starts[1:], s.eos_bit])), 1))
            assert [x[:2] for x in got] == s.ranges and not any(x[5] for x in got)
            assert b"".join(x[2] for x in got) in (DATA["large"], b"tail" * 50) and len(tries) <= len(got) + 3


def test_a_joined_block_is_decoded_once(monkeypatch):
    """The run's window shows the magic after its last block, so the way from end to end settles it."""
    data = K.compress(DATA["text"][:50_000], 1)
    (a, z), = K.find_streams(data, K.scan(data))[0].ranges
    tries = []
    monkeypatch.setattr(K, "decode_block", lambda *a, f=K.decode_block: tries.append(a) or f(*a))
    rs = [{"start_bit": x, "end_bit": y, "crc": 5, "stream_idx": 0, "level": 1} for x, y in ((a, a + 99), (a + 99, z))]
    assert decode._joined_runs({"file": "f", "rs": rs}, lambda a, z: (data[a:z], a)) == [("f", 0, 1, a, z, 5)] and len(tries) == 1
