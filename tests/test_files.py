import bz2
import io

import pytest
from pyspark.sql import functions as F

from quern.functions import kernels as K
from quern.operators import decode, markers
from quern.streaming.files import Decoder, DecoderOptions, Encoder, EncoderOptions
from tests.test_kernels import lcg

DATA = lcg(11, 420_000)


@pytest.mark.parametrize("step", [13, 997, 100_000, 420_000])
def test_output_does_not_depend_on_writes(step):
    seen = []
    with Encoder(io.BytesIO(), 1, min_blocks=2, on_progress=seen.append) as e:
        for i in range(0, len(DATA), step):
            assert e.write(DATA[i : i + step]) == len(DATA[i : i + step])
    out = e.out.getvalue()
    assert out == K.compress(DATA, 1) and bz2.decompress(out) == DATA
    s = e.stats
    assert (s.total_in, s.total_out, s.blocks_completed) == (len(DATA), len(out), 6) and s.compression_ratio == len(out) / len(DATA)
    assert seen[-1].blocks_completed == 6 and seen[-1].batches_completed == s.batches_completed


def test_encoder_by_spark(spark):
    e = Encoder(io.BytesIO(), 1, spark, min_blocks=3)
    e.write(DATA)
    assert e.finish().getvalue() == K.compress(DATA, 1)
    assert e.finish() is e.out and e.finish().getvalue() == K.compress(DATA, 1)
    with pytest.raises(ValueError):
        e.write(b"more")


def test_encoder_edges():
    with Encoder(io.BytesIO()) as e:
        assert e.write(b"") == 0
        e.flush()
    assert e.out.getvalue() == K.compress(b"") and e.stats.compression_ratio == 0.0
    with pytest.raises(K.InvalidFormat):
        Encoder(io.BytesIO(), 10)
    with pytest.raises(RuntimeError), Encoder(io.BytesIO(), 1) as e:
        e.write(b"half")
        raise RuntimeError
    assert not e.finished


def test_decoder(spark, tmp_path):
    data = bz2.compress(DATA, 1) + K.compress(b"") + K.compress(b"tail", 9)
    path = tmp_path / "x.bz2"
    path.write_bytes(data)
    seen = []
    for d in (Decoder.from_bytes(spark, data, on_progress=seen.append), Decoder.open(spark, str(path), part_bytes=50_000)):
        assert d.read(10) == DATA[:10] and d.read(0) == b""
        assert d.readall() == DATA[10:] + b"tail" and d.read(5) == b""
        s = d.stats
        assert (s.streams_total, s.streams_completed, s.bytes_out, s.progress) == (3, 3, len(DATA) + 4, 1.0) and s.decompression_rate > 0
    assert seen[-1].blocks_completed == len(seen)


def test_decoder_errors(spark):
    for data in (b"", b"text", K.compress(b"x", 1) + K.compress(DATA, 1)[:200_000]):
        with pytest.raises(K.InvalidFormat):
            Decoder.from_bytes(spark, data)
    data = bytearray(K.compress(DATA, 1))
    second = K.find_streams(bytes(data), K.scan(bytes(data)))[0].ranges[1][0]
    data[second // 8 + 200] ^= 0xFF
    d = Decoder.from_bytes(spark, bytes(data))
    assert d.read(1 << 20) == DATA[:79_984]
    for _ in range(2):
        with pytest.raises((K.DecompressionFailed, K.CrcMismatch)):
            d.read(10)
    data = bytearray(K.compress(b"abc"))
    data[-2] ^= 1
    d = Decoder.from_bytes(spark, bytes(data))
    assert d.read(3) == b"abc" and d.stream_crc != d.stored_stream_crc
    with pytest.raises(K.CrcMismatch):
        d.read(1)
    assert Decoder.from_bytes(spark, bytes(data), verify_stream_crc=False).readall() == b"abc"


@pytest.mark.parametrize("begin, length", [(0, 10), (79_980, 10), (100_000, 200_000), (419_999, 50), (0, 0), (500_000, 3)])
def test_read_bytes(spark, begin, length):
    df = spark.createDataFrame([("f", bytearray(K.compress(DATA, 1)))], "file string, content binary")
    results = decode.decode_value_blocks(markers.block_ranges(markers.markers(df)), df)
    got = sorted((r["offset"], bytes(r["data"])) for r in decode.read_bytes(results, begin, length).collect())
    assert b"".join(b for _, b in got) == DATA[begin : begin + length]


def test_options(spark):
    o = EncoderOptions(level=3)
    assert o.replace(min_blocks=2) == EncoderOptions(3, 2) and o.replace().min_blocks is None and "level=3" in repr(o)
    assert o.batch_blocks(None) == 1 and o.batch_blocks(spark) == spark.sparkContext.defaultParallelism and o.replace(min_blocks=5).batch_blocks(spark) == 5
    e = o.replace(pool="codec").build(io.BytesIO(), spark)
    e.write(b"abc")
    assert bz2.decompress(e.finish().getvalue()) == b"abc" and e.out.getvalue()[3:4] == b"3"
    assert Encoder(io.BytesIO(), 5, options=o).level == 5
    with pytest.raises(K.InvalidFormat):
        EncoderOptions(level=0).build(io.BytesIO())
    d = DecoderOptions(blocks_per_partition=1, pool="codec").from_bytes(spark, K.compress(DATA, 1))
    assert d.options.blocks_per_partition == 1 and d.readall() == DATA


def test_closing_early(spark):
    d = Decoder.from_bytes(spark, K.compress(DATA, 1), blocks_per_partition=1)
    assert d.read(5) == DATA[:5]
    d.close()
    d.close()
    with pytest.raises(ValueError):
        d.read(1)


def test_large_values_go_by_file(spark, monkeypatch):
    monkeypatch.setattr("quern.streaming.files.BROADCAST", 10)
    assert Decoder.from_bytes(spark, K.compress(DATA, 1)).readall() == DATA


def test_little_is_sent_to_the_driver(spark, tmp_path, monkeypatch):
    """Sorted keys come as packed differences, decoded blocks packed."""
    from pyspark.sql import Row
    from quern.plans import batches

    seen = []
    monkeypatch.setattr(batches.zlib, "decompress", lambda b, f=batches.zlib.decompress: seen.append(len(b)) or f(b))
    keys = [-(1 << 63), -5, 0, 0, *range(7, 60_000, 3), 1 << 40, (1 << 63) - 1]
    df = spark.createDataFrame([Row(k=k) for k in [*keys, None]], "k long").repartition(3)
    assert list(batches.pulled_longs(df.orderBy("k"))) == keys and sum(seen) < len(keys)
    assert list(batches.pulled_longs(df.where("false"))) == [] and list(batches.pulled_longs(df.select(F.expr("cast(k % 100 as int)")).where("k is null"))) == []
    seen.clear()
    text = b"".join(b"%d\n" % k for k in range(40_000))
    (tmp_path / "x.bz2").write_bytes(K.compress(text, 1))
    assert Decoder.open(spark, str(tmp_path / "x.bz2")).readall() == text and len(seen) == 3 and sum(seen) < len(text) // 2
