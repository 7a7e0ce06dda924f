import bz2
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.functions import kernels as K


def lcg(seed, n, add=1442695040888963407):
    out, s = bytearray(), seed
    for _ in range(n):
        s = (s * 6364136223846793005 + add) % (1 << 64)
        out.append(s >> 33 & 0xFF)
    return bytes(out)


@pytest.mark.parametrize("data, crc", [(b"", 0), (b"A", 0x81B02D8B), (b"abcdef", 0xA0F54FB9), (b"hello", 0x1931653D), (b"123456789", 0xFC891918), (bytes(range(256)), 0xB6B5EE95), (b"the quick brown fox jumps over the lazy dog", 0xF0269282)])
def test_crc_goldens(data, crc):
    assert K.crc32(data) == crc


@pytest.mark.parametrize("seed, n, first, crc, sha", [(42, 100, "7652d21f560cd996", 0xA2F85A45, "1f4ec175c72b49a7"), (123, 1024, "a1f4242060e774a7", 0x7732733A, "f572df63982bd336"), (444, 100000, "078637cdc44a3a59", 0xC7F06C6B, "2ba5901c9a9a9341")])
def test_generator_goldens(seed, n, first, crc, sha):
    data = lcg(seed, n)
    assert data[:8].hex() == first and K.crc32(data) == crc and hashlib.sha256(data).hexdigest().startswith(sha)


@given(st.binary(max_size=300), st.integers(0, 300))
def test_crc_continues(data, cut):
    assert K.crc32(data[cut:], K.crc32(data[:cut])) == K.crc32(data)


def test_fold_golden():
    assert K.fold_crcs([0x12345678, 0xABCDEF01]) == 0x8FA543F1


def _bits(data):
    return "".join(f"{b:08b}" for b in data)


@given(st.binary(max_size=40), st.integers(0, 400), st.integers(0, 400))
def test_extract_bits(data, start, end):
    want = _bits(data).ljust(500, "0")[start:end]
    got = K.extract_bits(data, start, end)
    assert len(got) == (max(0, end - start) + 7) // 8
    assert _bits(got) == want.ljust(8 * len(got), "0")


@given(st.binary(max_size=20), st.integers(0, 200))
def test_reads_past_the_end_are_zero(data, bit):
    assert K.read_u32(data, bit) == int(_bits(data).ljust(400, "0")[bit : bit + 32], 2)


@given(st.lists(st.one_of(st.tuples(st.integers(0, (1 << 64) - 1), st.integers(0, 64)), st.tuples(st.binary(max_size=9), st.integers(0, 30), st.integers(0, 90)), st.just(())), max_size=12))
def test_bit_writer(steps):
    w, want = K.BitWriter(), ""
    for s in steps:
        if not s:
            w.pad()
            want += "0" * (-len(want) % 8)
        elif len(s) == 2:
            w.write_bits(*s)
            want += f"{s[0] & ((1 << s[1]) - 1):0{s[1]}b}" if s[1] else ""
        else:
            w.copy_bits(*s)
            want += _bits(s[0]).ljust(200, "0")[s[1] : s[1] + s[2]]
        assert w.bit_len == len(want)
    assert _bits(w.getvalue()) == want.ljust(-(-len(want) // 8) * 8, "0")


def test_bit_writer_limits():
    with pytest.raises(ValueError):
        K.BitWriter().write_bits(0, 65)


def test_take_whole_keeps_the_tail():
    w = K.BitWriter()
    w.write_bits(0b101, 3)
    w.write_bytes(b"ab")
    first = w.take_whole()
    w.pad()
    assert first + w.getvalue() == K.extract_bits(bytes([0b10100000 | b"ab"[0] >> 3, (b"ab"[0] << 5 | b"ab"[1] >> 3) & 255, b"ab"[1] << 5 & 255]), 0, 24)


@pytest.mark.parametrize("shift", range(8))
@pytest.mark.parametrize("magic, kind", [(K.BLOCK_MAGIC, "B"), (K.EOS_MAGIC, "E")])
def test_scan_finds_all_shifts(shift, magic, kind):
    w = K.BitWriter()
    w.write_bytes(b"BZh9" + b"\xff" * 3)
    w.write_bits(0, shift)
    w.write_bits(magic, 48)
    w.write_bits(0xDEADBEEF, 32)
    w.pad()
    assert [(m.bit_offset, m.kind, m.crc) for m in K.scan(w.getvalue())] == [(56 + shift, kind, 0xDEADBEEF)]


def test_scan_skips_the_header_and_wrong_edges():
    assert K.scan(K.BLOCK_MAGIC.to_bytes(6, "big")) == []
    w = K.BitWriter()
    w.write_bytes(b"BZh9")
    w.write_bits(0, 3)
    w.write_bits(K.BLOCK_MAGIC ^ 1, 48)
    w.pad()
    assert K.scan(w.getvalue()) == []


@pytest.mark.parametrize("part", [7, 100, 4096, 100_000])
def test_parts_scan_as_the_whole(part):
    data = bz2.compress(lcg(5, 300_000), 1)
    got = [m for i in range(0, len(data), part) for m in K.scan(data[i : i + part + K.LOOK_AHEAD], i, min(part, len(data) - i))]
    assert got == K.scan(data) and len(got) >= 4


@pytest.mark.parametrize("level", range(1, 10))
def test_levels(level):
    data = lcg(level, 50_000)
    out = K.compress(data, level)
    assert out[3] == 0x30 + level and bz2.decompress(out) == data and K.decompress(out) == data


@pytest.mark.parametrize("n", [0, 1, 100, 79_984, 79_985, 159_968, 300_000])
def test_sizes(n):
    data = lcg(n, n)
    out = K.compress(data, 1)
    assert bz2.decompress(out) == data == K.decompress(out) == K.decompress(bz2.compress(data, 1))


@pytest.mark.parametrize("data", [b"\0" * 200_000, b"\xff" * 100_000, bytes(range(256)) * 500, b"a" * 500_000 + b"b" * 500_000, b"Z" * (1 << 20), b"ab" * 90_000])
def test_patterns(data):
    assert bz2.decompress(K.compress(data, 1)) == data
    assert K.decompress(bz2.compress(data, 9)) == data


def test_empty_stream():
    assert K.compress(b"", 9) == bytes.fromhex("425a683917724538509000000000")


def test_block_sizes():
    assert (K.max_block_bytes(1), K.max_block_bytes(2), K.max_block_bytes(9)) == (79_984, 159_984, 719_984)
    for level in (0, 10):
        with pytest.raises(K.InvalidFormat):
            K.max_block_bytes(level)


@pytest.mark.parametrize("seed, n, level, blocks", [(444, 100_000, 1, 2), (666, 100_001, 1, 2), (9999, 512_000, 1, 7)])
def test_block_counts(seed, n, level, blocks):
    assert len(K.split(lcg(seed, n), level)) == blocks


def test_encode_block_arguments():
    with pytest.raises(K.InvalidFormat):
        K.encode_block(b"", 1)
    with pytest.raises(K.InvalidFormat):
        K.encode_block(b"x" * 79_985, 1)
    with pytest.raises(K.InvalidFormat):
        K.encode_block(b"x", 0)


def test_streams_of_mixed_levels_and_empty_ones():
    data = bz2.compress(b"one", 1) + bz2.compress(b"") + K.compress(b"two" * 50_000, 5) + bz2.compress(b"three", 9)
    assert K.decompress(data) == b"one" + b"two" * 50_000 + b"three" == bz2.decompress(data)


def test_trailing_garbage_is_ignored():
    assert K.decompress(K.compress(b"abc") + b"garbage") == b"abc"


@pytest.mark.parametrize("data", [b"", b"plain text", b"BZ", b"BZh0", b"BZh9", b"BZh9" + b"\x55" * 40])
def test_malformed(data):
    with pytest.raises(K.InvalidFormat):
        K.decompress(data)


def test_truncated():
    data = K.compress(lcg(1, 200_000), 1)
    with pytest.raises((K.InvalidFormat, K.DecompressionFailed)):
        K.decompress(data[: len(data) // 2])


def test_blocks_after_the_last_stream():
    data = K.compress(lcg(1, 200_000), 1)
    with pytest.raises(K.InvalidFormat, match="after"):
        K.decompress(K.compress(b"x", 1) + data[: len(data) // 2])


def test_stream_checksum():
    data = bytearray(K.compress(b"hello" * 1000))
    data[-3] ^= 0xFF
    with pytest.raises(K.CrcMismatch):
        K.decompress(bytes(data))
    assert K.decompress(bytes(data), verify_stream_crc=False) == b"hello" * 1000


def test_damaged_block():
    data = bytearray(K.compress(lcg(3, 60_000), 1))
    for i in range(30, 40):
        data[i] ^= 0xFF
    with pytest.raises((K.DecompressionFailed, K.CrcMismatch)):
        K.decompress(bytes(data))


@pytest.mark.parametrize("where", ["first", "second", "both", "twice"])
def test_split_blocks_are_joined(where):
    data = K.compress(lcg(8, 200_000), 1)
    (s,) = K.find_streams(data, K.scan(data))
    r = s.ranges
    mid = lambda k, f=2: r[k][0] + (r[k][1] - r[k][0]) // f
    extra = {"first": [mid(0)], "second": [mid(1)], "both": [mid(0), mid(1)], "twice": [mid(1), mid(1, 3)]}[where]
    cuts = sorted([a for a, _ in r] + extra) + [r[-1][1]]
    blocks = K.decode_ranges(data, list(zip(cuts, cuts[1:])), 1)
    assert b"".join(b for b, _ in blocks) == lcg(8, 200_000)


def test_a_false_end_is_not_believed():
    data = K.compress(lcg(2, 150_000), 1)
    true = K.scan(data)
    false = K.Marker(true[0].bit_offset + 5000, "E", 0, None)
    (s,) = K.find_streams(data, sorted([*true, false]))
    assert s.eos_bit == true[-1].bit_offset


def test_magic_in_plain_text():
    data = (K.BLOCK_MAGIC.to_bytes(6, "big") + K.EOS_MAGIC.to_bytes(6, "big")) * 3000
    assert K.decompress(K.compress(data, 1)) == data


@settings(max_examples=30, deadline=None)
@given(st.lists(st.binary(max_size=2000), max_size=4), st.integers(1, 9))
def test_any_streams(parts, level):
    data = b"".join(K.compress(p, level) for p in parts)
    if parts:
        assert K.decompress(data) == b"".join(parts) == bz2.decompress(data)
