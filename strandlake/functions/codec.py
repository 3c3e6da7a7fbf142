"""The byte level of archives: varints, packed sequences, streams of a frame, headers and checksums.

Records are columns: the bytes of all values and the length of each. Encoding computes the pieces of
all records (lengths, packed bases, exceptions) as arrays and puts them in their places in one buffer;
decoding finds where the values lie and gathers them at once.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard

from strandlake.functions.errors import ChecksumError, FormatError, UnsupportedError, UsageError

# Fixed values of the wire format.
MAGIC = bytes([0x46, 0x51, 0x43, 0x56, 0x32, 0x0D, 0x0A, 0x1A])
VERSION, HEADER_SIZE, FRAME_HEADER_SIZE, FOOTER_SIZE = 2, 32, 72, 40
FRAME_MAGIC, FOOTER_MAGIC = 0x324D5246, 0x32444E45
PROFILE_CODES = {"illumina": 1, "ont": 2, "pacbio-hifi": 3, "pacbio-clr": 4}
PROFILE_NAMES = {v: k for k, v in PROFILE_CODES.items()}
CODECS = (1, 1, 1)
PAIRED = 1
ZSTD_LEVEL = 1
BASES = b"ACGT"
IUPAC = b"ACGTRYSWKMBDHVNacgtryswkmbdhvn"

_CODE = np.zeros(256, np.uint8)
_CODE[list(BASES)] = [0, 1, 2, 3]
_PLAIN = np.zeros(256, bool)
_PLAIN[list(BASES)] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(IUPAC)] = True
_QUAD = np.array([[BASES[(b >> (2 * i)) & 3] for i in range(4)] for b in range(256)], np.uint8).view(np.uint32).ravel()
_NOT_ID, _NOT_COMMENT, _NOT_QUALITY = np.zeros(256, bool), np.zeros(256, bool), np.ones(256, bool)
_NOT_ID[list(b" \r\n")] = _NOT_COMMENT[list(b"\r\n")] = True
_NOT_QUALITY[33:127] = False

#: The bytes of all values of a column, and the length of each.
Column = tuple[np.ndarray, np.ndarray]
#: Mean length of values from which they are joined as slices instead of being scattered byte by byte.
SLICED = 24

FRAME_HEADER = struct.Struct("<4I7Q")
FOOTER = struct.Struct("<2I4Q")


def varint(v: int) -> bytes:
    if not 0 <= v < 1 << 64:
        raise UsageError("varint out of range")
    out = bytearray()
    while v >= 128:
        out.append(v & 127 | 128)
        v >>= 7
    out.append(v)
    return bytes(out)


def read_varint(data, at: int) -> tuple[int, int]:
    """(value, place after it)"""
    value = shift = 0
    while True:
        if at >= len(data):
            raise FormatError("truncated field")
        b = data[at]
        at += 1
        if shift == 63 and b > 1:
            raise FormatError("varint overflow")
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values, length of each)"""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1 << (7 * k))
    i = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out = ((np.repeat(v, size) >> (7 * i).astype(np.uint64)) & np.uint64(127)).astype(np.uint8)
    out |= np.where(i < np.repeat(size, size) - 1, 128, 0).astype(np.uint8)
    return out, size


def cut(data, lengths: np.ndarray) -> list:
    """The values of a column, as slices of it."""
    ends = np.cumsum(lengths)
    view = memoryview(data)
    return [view[a:z] for a, z in zip((ends - lengths).tolist(), ends.tolist())]


def interleave(*pieces: Column) -> bytes:
    """The pieces of record 0, then those of record 1 and so on; a piece is (bytes, length in each record)."""
    lengths = np.stack([n for _, n in pieces])
    total = int(lengths.sum())
    if total >= SLICED * lengths.size:
        out = [b""] * lengths.size
        for i, (data, n) in enumerate(pieces):
            out[i :: len(pieces)] = cut(data, n)
        return b"".join(out)
    begin = np.cumsum(lengths.sum(0)) - lengths.sum(0)
    out = np.empty(total, np.uint8)
    for (data, n), before in zip(pieces, np.cumsum(lengths, 0) - lengths):
        out[ranges(begin + before, n)] = data
    return out.tobytes()


def gather(data, starts: np.ndarray, lengths: np.ndarray) -> Column:
    """The column of values that begin at these places of data."""
    if not len(starts):
        return np.zeros(0, np.uint8), lengths
    n, step = int(lengths[0]), int(starts[1] - starts[0]) if len(starts) > 1 else 0
    if (lengths == n).all() and (np.diff(starts) == step).all():  # all alike: rows of a matrix
        rows = np.lib.stride_tricks.as_strided(np.frombuffer(data, np.uint8)[int(starts[0]) :], (len(starts), n), (step, 1), writeable=False)
        return rows.reshape(-1), lengths
    view = memoryview(data)
    return np.frombuffer(b"".join([view[a:z] for a, z in zip(starts.tolist(), (starts + lengths).tolist())]), np.uint8), lengths


def column(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, length of each) of a binary column; strings are written as Latin-1, one byte for a character."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if pa.types.is_string(values.type) or pa.types.is_large_string(values.type):
        data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
        if len(data) and data.max() > 127:
            values = pa.array([x.encode("latin-1") for x in values.to_pylist()], pa.large_binary())
    values = values.cast(pa.large_binary())
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(values) + 1, values.offset * 8)
    return np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]], np.diff(offsets)


def validate(ids: Column, comments: Column, bases: Column, quals: Column, error=UsageError) -> None:
    (i, ni), (c, _), (s, ns), (q, nq) = ids, comments, bases, quals
    if (ni == 0).any() or (ns == 0).any() or (ns != nq).any():
        raise error("invalid record: empty field or different lengths")
    if _NOT_ID[i].any() or _NOT_COMMENT[c].any():
        raise error("invalid record: white space in the header")
    if not _SYMBOL[s].all():
        raise error("invalid record: not a base")
    if _NOT_QUALITY[q].any():
        raise error("invalid record: not a quality")


def pack(bases: np.ndarray, n: np.ndarray) -> Column:
    """(packed bytes, bytes of each read)"""
    size = (n + 3) // 4
    codes = _CODE[bases]
    if (n % 4 != 0).any():
        pad = [bytes(k) for k in range(4)]
        codes = np.frombuffer(interleave_slices(cut(codes, n), [pad[k] for k in (4 * size - n).tolist()]), np.uint8)
    quads = codes.view("<u4")
    return (quads | quads >> np.uint32(6) | quads >> np.uint32(12) | quads >> np.uint32(18)).astype(np.uint8), size


def interleave_slices(*pieces: list) -> bytes:
    out = [b""] * (len(pieces) * len(pieces[0]))
    for i, x in enumerate(pieces):
        out[i :: len(pieces)] = x
    return b"".join(out)


def exceptions(bases: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, Column]:
    """(number in each read, their bytes): varint of the delta and the symbol, one after the other."""
    at = np.flatnonzero(~_PLAIN[bases])
    begin = np.cumsum(n) - n
    read = np.searchsorted(begin, at, "right") - 1
    while len(at) and (n[read] == 0).any():  # reads without bases share a place with the next
        read = np.where(n[read] == 0, read - 1, read)
    pos = at - begin[read]
    first = np.append(True, read[1:] != read[:-1]) if len(at) else np.zeros(0, bool)
    delta = np.where(first, pos, pos - np.append(0, pos[:-1])) if len(at) else pos
    data, size = varints(delta)
    mixed = np.frombuffer(interleave((data, size), (bases[at], np.ones(len(at), np.int64))), np.uint8)
    per_read = np.bincount(read, size + 1, minlength=len(n)).astype(np.int64)
    return np.bincount(read, minlength=len(n)), (mixed, per_read)


@dataclass(frozen=True)
class Records:
    """Records as columns."""

    ids: Column
    comments: Column
    bases: Column
    quals: Column

    def __len__(self) -> int:
        return len(self.ids[1])

    @property
    def columns(self) -> tuple[Column, Column, Column, Column]:
        return self.ids, self.comments, self.bases, self.quals

    def text_bytes(self) -> int:
        """Bytes of the records as canonical FASTQ."""
        return sum(int(n.sum()) for _, n in self.columns) + 6 * len(self) + int((self.comments[1] > 0).sum())

    def fastq(self) -> bytes:
        """The records as canonical FASTQ."""
        return b"".join([b"@%b %b\n%b\n+\n%b\n" % r if r[1] else b"@%b%b\n%b\n+\n%b\n" % r for r in self.rows()])

    def rows(self):
        """Tuples (id, comment, bases, qualities)."""
        return zip(*(cut(data.tobytes(), n) for data, n in self.columns))

    def arrow(self) -> list[pa.Array]:
        """String columns; bytes are Latin-1 characters."""
        out = []
        for data, n in self.columns:
            if len(data) and data.max() > 127:
                out.append(pa.array([bytes(x).decode("latin-1") for x in cut(data, n)], pa.string()))
            else:
                offsets = np.zeros(len(n) + 1, np.int64)
                np.cumsum(n, out=offsets[1:])
                out.append(pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string()))
        return out

    def part(self, a: int, z: int) -> Records:
        """Records a to z."""
        return Records(*((data[int(n[:a].sum()) : int(n[:z].sum())], n[a:z]) for data, n in self.columns))

    @classmethod
    def mates(cls, first: Records, second: Records) -> Records:
        """The records of two files in turn."""
        columns = []
        for (a, n), (b, m) in zip(first.columns, second.columns):
            lengths = np.stack([n, m], 1).ravel()
            columns.append((np.frombuffer(interleave((a, n), (b, m)), np.uint8), lengths))
        return cls(*columns)

    @classmethod
    def of_arrow(cls, *columns) -> Records:
        return cls(*(column(x) for x in columns))


def streams_of(records: Records) -> tuple[bytes, bytes, bytes, int]:
    """What records add to the (ids, sequences, qualities) of their frame, and their bases."""
    i, c, s, q = records.columns
    validate(i, c, s, q)
    n_exceptions, mixed = exceptions(*s)
    return (
        interleave(varints(i[1]), i, varints(c[1]), c),
        interleave(varints(s[1]), pack(*s), varints(n_exceptions), mixed),
        interleave(varints(q[1]), q),
        int(s[1].sum()),
    )


def encode_streams(records: Records) -> tuple[bytes, bytes, bytes, int]:
    """(ids, sequences, qualities) of a frame, and its bases."""
    *streams, bases = streams_of(records)
    return *(varint(len(records)) + x for x in streams), bases


def walk(data: bytes, at: int, count: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, lengths, place after the last) of count values that follow their length."""
    starts, lengths = [0] * count, [0] * count
    try:
        for k in range(count):
            n = data[at]
            if n < 128:
                at += 1
            elif (m := data[at + 1]) < 128:
                n += (m << 7) - 128
                at += 2
            else:
                n, at = read_varint(data, at)
            starts[k], lengths[k] = at, n
            at += n
    except IndexError:
        raise FormatError("truncated field") from None
    if at > len(data):
        raise FormatError("truncated field")
    return np.array(starts, np.int64), np.array(lengths, np.int64), at


def walk_sequences(data: bytes, at: int, count: int):
    """(places of packed bases, lengths in bases, (reads, positions, symbols) of exceptions, place after the last)"""
    starts, lengths = [0] * count, [0] * count
    reads, positions, symbols = [], [], bytearray()
    try:
        for k in range(count):
            n = data[at]
            if n < 128:
                at += 1
            elif (m := data[at + 1]) < 128:
                n += (m << 7) - 128
                at += 2
            else:
                n, at = read_varint(data, at)
            starts[k], lengths[k] = at, n
            at += (n + 3) >> 2
            e = data[at]
            if not e:
                at += 1
                continue
            e, at = read_varint(data, at)
            if e > n:
                raise FormatError("more exceptions than bases")
            pos = 0
            for j in range(e):
                delta, at = (data[at], at + 1) if data[at] < 128 else read_varint(data, at)
                if j and not delta:
                    raise FormatError("exceptions out of order")
                pos += delta
                if pos >= n:
                    raise FormatError("exception beyond the sequence")
                reads.append(k)
                positions.append(pos)
                symbols.append(data[at])
                at += 1
    except IndexError:
        raise FormatError("truncated field") from None
    if at > len(data):
        raise FormatError("truncated field")
    return np.array(starts, np.int64), np.array(lengths, np.int64), (np.array(reads, np.int64), np.array(positions, np.int64), np.frombuffer(bytes(symbols), np.uint8)), at


def unpack(packed: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The bases of packed reads of n bases each."""
    bases = _QUAD[packed].view(np.uint8)
    spare = -n % 4
    if not spare.any():
        return bases
    ends = np.cumsum((n + 3) // 4) * 4
    keep = np.ones(len(bases), bool)
    for k in (1, 2, 3):
        keep[ends[spare >= k] - k] = False
    return bases[keep]


def decode_streams(ids: bytes, sequences: bytes, qualities: bytes, count: int) -> Records:
    (a, i), (b, s), (c, q) = read_varint(ids, 0), read_varint(sequences, 0), read_varint(qualities, 0)
    if (a, b, c) != (count, count, count):
        raise FormatError("stream counts differ")
    if 2 * count > len(ids) or count > len(sequences) or count > len(qualities):  # before anything is allocated for them
        raise FormatError("truncated field")
    places, lengths, i = walk(ids, i, 2 * count)
    starts, n, (reads, positions, symbols), s = walk_sequences(sequences, s, count)
    quality_places, quality_lengths, q = walk(qualities, q, count)
    if (i, s, q) != (len(ids), len(sequences), len(qualities)):
        raise FormatError("trailing bytes in a stream")
    packed, _ = gather(sequences, starts, (n + 3) // 4)
    bases = unpack(packed, n)
    if len(reads):
        if not _SYMBOL[symbols].all():
            raise FormatError("exception is not a base")
        bases = bases.copy()
        bases[(np.cumsum(n) - n)[reads] + positions] = symbols
    out = Records(gather(ids, places[::2], lengths[::2]), gather(ids, places[1::2], lengths[1::2]), (bases, n), gather(qualities, quality_places, quality_lengths))
    validate(*out.columns, error=FormatError)
    return out


def logical_checksum(*streams: bytes, start: int = 0) -> int:
    """XXH64 over the three streams; each starts from the digest of the one before."""
    for x in streams:
        start = xxhash.xxh64_intdigest(x, start)
    return start


def advance(rolling: int, checksum: int) -> int:
    return xxhash.xxh64_intdigest(struct.pack("<Q", checksum), rolling)


def compress(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=ZSTD_LEVEL).compress(data)


def decompress(data: bytes, size: int) -> bytes:
    try:
        out = zstandard.ZstdDecompressor().decompress(data, max_output_size=max(size, 1))
    except zstandard.ZstdError as e:
        raise FormatError(f"invalid compressed stream: {e}") from None
    if len(out) != size:
        raise FormatError("stream has another size than its header says")
    return out


def header(profile: str, paired: bool) -> bytes:
    if profile not in PROFILE_CODES:
        raise UsageError(f"unknown profile: {profile}")
    data = MAGIC + struct.pack("<HHI4BI", VERSION, HEADER_SIZE, PAIRED if paired else 0, PROFILE_CODES[profile], *CODECS, 0)
    return data + struct.pack("<Q", xxhash.xxh64_intdigest(data))


def parse_header(data: bytes) -> tuple[str, bool]:
    """(profile, paired); fields are tested before the checksum."""
    if len(data) < HEADER_SIZE:
        raise FormatError("truncated archive")
    if data[:8] != MAGIC:
        raise FormatError("not an archive")
    version, size, flags, profile, *codecs, reserved = struct.unpack_from("<HHI4BI", data, 8)
    if version != VERSION or size != HEADER_SIZE:
        raise UnsupportedError("unsupported version")
    if flags & ~PAIRED or reserved or profile not in PROFILE_NAMES or tuple(codecs) != CODECS:
        raise UnsupportedError("unsupported flags, profile or codec")
    if struct.unpack_from("<Q", data, 24)[0] != xxhash.xxh64_intdigest(data[:24]):
        raise ChecksumError("header checksum differs")
    return PROFILE_NAMES[profile], bool(flags & PAIRED)


@dataclass(frozen=True)
class FrameHeader:
    frame_id: int
    record_count: int
    raw_ids: int
    enc_ids: int
    raw_seq: int
    enc_seq: int
    raw_qual: int
    enc_qual: int
    checksum: int

    def pack(self) -> bytes:
        if max(self.frame_id, self.record_count) >> 32:
            raise UsageError("a frame's number or its records do not fit 32 bits")
        return FRAME_HEADER.pack(FRAME_MAGIC, FRAME_HEADER_SIZE, *(getattr(self, f) for f in self.__dataclass_fields__))

    @property
    def payload(self) -> int:
        return self.enc_ids + self.enc_seq + self.enc_qual


def parse_frame_header(data: bytes, expected_id: int, paired: bool) -> FrameHeader:
    magic, size, *fields = FRAME_HEADER.unpack(data)
    h = FrameHeader(*fields)
    if magic != FRAME_MAGIC:
        raise FormatError("invalid frame marker")
    if size != FRAME_HEADER_SIZE or h.frame_id != expected_id or not h.record_count:
        raise FormatError("invalid frame header")
    if paired and h.record_count % 2:
        raise FormatError("odd number of records in a paired frame")
    return h


def footer(frames: int, records: int, bases: int, rolling: int) -> bytes:
    if max(frames, records, bases) >> 64:
        raise UsageError("totals do not fit 64 bits")
    return FOOTER.pack(FOOTER_MAGIC, FOOTER_SIZE, frames, records, bases, rolling)


def encode_slices(frame_id: int, slices: Iterable[Records]) -> tuple[FrameHeader, int, int, list[bytes]]:
    """(header, bases, bytes as canonical FASTQ, streams) of a frame whose records come slice by slice; only bytes of streams are kept."""
    parts: tuple[list[bytes], ...] = ([], [], [])
    n = bases = text = 0
    for records in slices:
        *found, b = streams_of(records)
        for x, data in zip(parts, found):
            x.append(data)
        n, bases, text = n + len(records), bases + b, text + records.text_bytes()
    sizes, streams, checksum = [], [], 0
    for x in parts:
        raw = b"".join([varint(n), *x])
        x.clear()
        checksum = logical_checksum(raw, start=checksum)
        streams.append(compress(raw))
        sizes += [len(raw), len(streams[-1])]
    return FrameHeader(frame_id, n, *sizes, checksum), bases, text, streams


def encode_frame(frame_id: int, records: Records) -> tuple[FrameHeader, int, bytes, bytes, bytes]:
    h, bases, _, streams = encode_slices(frame_id, [records])
    return h, bases, *streams


def decode_frame(h: FrameHeader, ids: bytes, seq: bytes, qual: bytes) -> Records:
    i, s, q = decompress(ids, h.raw_ids), decompress(seq, h.raw_seq), decompress(qual, h.raw_qual)
    if logical_checksum(i, s, q) != h.checksum:
        raise ChecksumError("frame checksum differs")
    return decode_streams(i, s, q, h.record_count)
