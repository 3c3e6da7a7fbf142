from __future__ import annotations

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlake.functions import codec as C
from strandlake.functions.errors import ChecksumError, FormatError, UnsupportedError, UsageError

# Fixed values of the wire format: records and their bytes.
RECORDS = [("read_1", "1:N:0:ACGT", "ACGTNacgt", "!#IJKLMNO"), ("read_2", "2:N:0:TGCA", "TGCARYSWK", "JKLMNOPQR"), ("read_3", "", "NNNNACGT", "!!!!!!!!"), ("read_4", "comment", "ACGTACGT", "~~~~~~~~")]


def columns(records):
    return C.Records.of_arrow(*(pa.array(c, pa.string()) for c in zip(*records)))


def rows(records):
    return [tuple(bytes(x).decode("latin-1") for x in r) for r in records.rows()]


def test_varints():
    for v, h in ((0, "00"), (127, "7f"), (128, "8001"), (300, "ac02"), (16383, "ff7f"), (16384, "808001"), (2**64 - 1, "ffffffffffffffffff01")):
        assert C.varint(v).hex() == h
        assert C.read_varint(bytes.fromhex(h), 0) == (v, len(h) // 2)
    with pytest.raises(FormatError):
        C.read_varint(bytes.fromhex("ffffffffffffffffff02"), 0)
    with pytest.raises(FormatError):
        C.read_varint(b"\x80", 0)


def test_golden_streams():
    ids, seqs, quals, bases = C.encode_streams(columns(RECORDS))
    assert ids.hex() == "0406726561645f310a313a4e3a303a4143475406726561645f320a323a4e3a303a5447434106726561645f330006726561645f3407636f6d6d656e74"
    assert seqs.hex() == "0409e4000005044e0161016301670174091b0000050452015901530157014b0800e404004e014e014e014e08e4e400"
    assert quals.hex() == "04092123494a4b4c4d4e4f094a4b4c4d4e4f505152082121212121212121087e7e7e7e7e7e7e7e"
    checksum = C.logical_checksum(ids, seqs, quals)
    assert (checksum, C.advance(0, checksum), bases) == (0x4D877D0653F3C3FC, 0x13584DC09BD65F26, 34)
    assert rows(C.decode_streams(ids, seqs, quals, 4)) == RECORDS


def test_headers():
    assert C.header("illumina", False).hex() == "46514356320d0a1a0200200000000000010101010000000057ab8ba8b4708668"
    assert C.header("pacbio-clr", True).hex() == "46514356320d0a1a020020000100000004010101000000002493447d1f587d19"
    for p in C.PROFILE_CODES:
        for paired in (False, True):
            assert C.parse_header(C.header(p, paired)) == (p, paired)
    good = bytearray(C.header("ont", False))
    for at, value, error in ((0, 0, FormatError), (8, 9, UnsupportedError), (17, 0x7F, UnsupportedError), (20, 1, UnsupportedError), (24, good[24] ^ 1, ChecksumError)):
        bad = bytearray(good)
        bad[at] = value
        with pytest.raises(error):
            C.parse_header(bytes(bad))
    with pytest.raises(FormatError):
        C.parse_header(bytes(good[:31]))


@pytest.mark.parametrize("record", [("", "", "A", "!"), ("a b", "", "A", "!"), ("a", "x\ny", "A", "!"), ("a", "", "Z", "!"), ("a", "", "A", "\n"), ("a", "", "AC", "!")])
def test_invalid_records_are_usage_errors(record):
    with pytest.raises(UsageError):
        C.encode_streams(columns([record]))


def test_corrupt_streams_are_format_errors():
    h, _, i, s, q = C.encode_frame(0, columns(RECORDS))
    assert len(C.decode_frame(h, i, s, q)) == 4
    with pytest.raises(FormatError):
        C.decode_frame(h, i[:-3], s, q)
    ids, seqs, quals, _ = C.encode_streams(columns(RECORDS))
    with pytest.raises(FormatError):
        C.decode_streams(b"\x01\x80", seqs, quals, 4)
    with pytest.raises(FormatError):
        C.decode_streams(ids + b"\0", seqs, quals, 4)
    with pytest.raises(FormatError):
        C.decode_streams(ids, seqs, quals, 3)
    with pytest.raises(ChecksumError):
        C.decode_frame(C.FrameHeader(*[getattr(h, f) for f in list(h.__dataclass_fields__)[:-1]], h.checksum ^ 1), i, s, q)


records = st.integers(1, 300).flatmap(lambda n: st.tuples(st.text(st.characters(min_codepoint=33, max_codepoint=255), min_size=1, max_size=200).filter(lambda x: not set(x) & set(" \r\n")), st.text(st.characters(min_codepoint=32, max_codepoint=255), max_size=150), st.text("ACGT" * 8 + "RYSWKMBDHVNacgtryswkmbdhvn", min_size=n, max_size=n), st.text(st.characters(min_codepoint=33, max_codepoint=126), min_size=n, max_size=n)))


@given(st.lists(records, min_size=1, max_size=8))
@settings(max_examples=80, deadline=None)
def test_round_trip(data):
    h, bases, i, s, q = C.encode_frame(3, columns(data))
    back = C.decode_frame(h, i, s, q)
    assert rows(back) == data and list(zip(*(x.to_pylist() for x in back.arrow()))) == data
    assert bases == sum(len(r[2]) for r in data)
    text = "".join(f"@{a}{' ' if b else ''}{b}\n{x}\n+\n{y}\n" for a, b, x, y in data)
    assert back.fastq() == text.encode("latin-1") and back.text_bytes() == len(text)
    assert rows(C.Records.mates(back, back)) == [r for r in data for _ in range(2)]


def test_equal_lengths():
    """Records of one length are gathered as a matrix."""
    for n in (1, 4, 7, 150):
        data = [(f"r{i:03}", "c" * (i % 2), "ACGTN"[i % 5] * n, "!" * n) for i in range(50)]
        h, _, *streams = C.encode_frame(0, columns(data))
        assert rows(C.decode_frame(h, *streams)) == data


def test_counts_are_32_bit():
    h, *_ = C.encode_frame(0, columns(RECORDS))
    with pytest.raises(UsageError):
        C.FrameHeader(0, 1 << 32, *[getattr(h, f) for f in list(h.__dataclass_fields__)[2:]]).pack()
    with pytest.raises(UsageError):
        C.footer(1, 1 << 64, 1, 0)
