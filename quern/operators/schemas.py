"""Schemas of the tables that the operators exchange. Unsigned 32-bit values are longs."""

MARKER = "file string, bit_offset bigint, kind string, crc bigint, next_level int"
BLOCK_RESULT = "file string, stream_idx int, block_idx int, level int, start_bit bigint, end_bit bigint, data binary, stored_crc bigint, computed_crc bigint, crc_valid boolean, error string"
ENCODED = "raw_len bigint, bits binary, bit_len bigint, block_crc bigint"
#: Kinds of markers: header of the first stream, block, end of stream.
HEADER, BLOCK, EOS = "H", "B", "E"
