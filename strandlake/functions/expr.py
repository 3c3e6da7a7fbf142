"""Column builders for records, formats and the byte grammar of archives (as hex strings)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Alphabets and names that the archive format defines.
IUPAC = "ACGTRYSWKMBDHVNacgtryswkmbdhvn"
PROFILES = {"illumina": 1, "ont": 2, "pacbio-hifi": 3, "pacbio-clr": 4}
MAGICS = {"gzip": "1F8B", "bzip2": "425A68", "xz": "FD377A585A00", "zstd": "28B52FFD"}
EXTENSIONS = {".gz": "gzip", ".gzip": "gzip", ".bz2": "bzip2", ".bzip2": "bzip2", ".xz": "xz", ".lzma": "xz", ".zst": "zstd", ".zstd": "zstd"}
FORMAT_EXTENSIONS = {"none": "", "gzip": ".gz", "bzip2": ".bz2", "xz": ".xz", "zstd": ".zst", "unknown": ""}
SUPPORTED = ("none", "gzip")
ERRORS = {0: ("success", 0), 1: ("usage error", 1), 2: ("I/O error", 2), 3: ("format error", 3), 4: ("checksum error", 4), 5: ("unsupported", 5), 17: ("internal error", 3)}

MIB = 1 << 20
RESERVE = 16 * MIB
MAX_FRAME = 512 * MIB
#: Bytes that a record holds in memory besides its text; a fixed rule, so that frames are the same everywhere.
RECORD_BYTES = 128


def _map(pairs: dict, key: Column, default) -> Column:
    out = F.lit(default)
    for k, v in reversed(pairs.items()):
        out = F.when(key == F.lit(k), F.lit(v)).otherwise(out)
    return out


# Lines and headers


def trim_cr(line: Column) -> Column:
    return F.regexp_replace(line, "\\r+\\z", "")


def header_id(header: Column) -> Column:
    return F.substring_index(F.substr(header, F.lit(2)), " ", 1)


def header_comment(header: Column) -> Column:
    space = F.instr(header, " ")
    return F.when(space > 0, F.substr(header, space + 1)).otherwise("")


def header_line(id_: Column, comment: Column) -> Column:
    return F.concat(F.lit("@"), id_, F.when(comment == "", "").otherwise(F.concat(F.lit(" "), comment)))


def render_fastq(id_: Column, comment: Column, sequence: Column, quality: Column) -> Column:
    nl = F.lit("\n")
    return F.concat(header_line(id_, comment), nl, sequence, F.lit("\n+\n"), quality, nl)


def canonical_bytes(id_: Column, comment: Column, sequence: Column, quality: Column) -> Column:
    return (F.length(id_) + F.length(comment) + F.length(sequence) + F.length(quality) + 6 + (comment != "").cast("int")).cast("long")


def retained_bytes(id_: Column, comment: Column, sequence: Column, quality: Column) -> Column:
    return (F.length(id_) + F.length(comment) + F.length(sequence) + F.length(quality) + 4 + RECORD_BYTES).cast("long")


# Formats


def detect_magic(head_hex: Column) -> Column:
    out = F.lit("none")
    for name, magic in reversed(MAGICS.items()):
        out = F.when(head_hex.startswith(magic), name).otherwise(out)
    return out


def detect_extension(path: Column) -> Column:
    return _map(EXTENSIONS, F.lower(F.regexp_extract(path, "(\\.[^./]*)$", 1)), "none")


def format_extension(name: Column) -> Column:
    return _map(FORMAT_EXTENSIONS, name, "")


def supported(name: Column) -> Column:
    return name.isin(*SUPPORTED)


# Predicates


def valid_shape(id_: Column, comment: Column, sequence: Column, quality: Column) -> Column:
    return (F.length(id_) > 0) & (F.length(sequence) > 0) & (F.length(sequence) == F.length(quality)) & ~id_.rlike("[ \\r\\n]") & ~comment.rlike("[\\r\\n]")


def is_record(id_: Column, sequence: Column, quality: Column) -> Column:
    """Whether a record has an id, and bases with a quality each; what the fields hold is not looked at."""
    return (F.length(id_) > 0) & (F.length(sequence) > 0) & (F.length(sequence) == F.length(quality))


def valid_iupac(sequence: Column) -> Column:
    return sequence.rlike(f"^[{IUPAC}]+\\z")


def valid_quality(quality: Column) -> Column:
    return quality.rlike("^[!-~]+\\z")


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contains_any(c: Column, needles: tuple[str, ...]) -> Column:
    out = c.contains(needles[0])
    for n in needles[1:]:
        out = out | c.contains(n)
    return out


def count_char(c: Column, char: str) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))).cast("int")


# Bytes as hex


def hex_byte(v: Column) -> Column:
    return F.lpad(F.hex(v), 2, "0")


def varint_size(v: Column) -> Column:
    """Bytes of a non-negative long as a varint."""
    out = F.lit(9)
    for n in range(8, 0, -1):
        out = F.when(v < F.lit(1 << (7 * n)).cast("long"), n).otherwise(out)
    return out.cast("int")


def varint_hex(v: Column) -> Column:
    size = varint_size(v)
    part = lambda i: F.call_function("shiftrightunsigned", v, (i * 7).cast("int")).bitwiseAND(F.lit(127).cast("long"))
    return F.array_join(F.transform(F.sequence(F.lit(0), size - 1), lambda i: hex_byte(part(i) + F.when(i < size - 1, 128).otherwise(0))), "")


def le_hex(v: Column, width: int) -> Column:
    return F.concat(*[hex_byte(F.shiftrightunsigned(v.cast("long"), 8 * i).bitwiseAND(F.lit(255).cast("long"))) for i in range(width)])


def prefixed_hex(text: Column) -> Column:
    data = F.encode(text, "ISO-8859-1")
    return F.concat(varint_hex(F.octet_length(data).cast("long")), F.hex(data))


# Two-bit sequences


def base_codes(sequence: Column) -> Column:
    """A digit for each base; every other symbol is 0 and an exception."""
    others = "".join(b for b in IUPAC if b not in "ACGT")
    return F.translate(sequence, "CGTA" + others, "1230" + "0" * len(others))


def packed_size(n: Column) -> Column:
    return F.floor((n + 3) / 4).cast("int")


def pack_hex(sequence: Column) -> Column:
    """Four bases a byte, the first in the lowest bits."""
    quads = F.regexp_extract_all(base_codes(sequence), F.lit("(.{1,4})"), F.lit(1))
    return F.array_join(F.transform(quads, lambda g: F.lpad(F.conv(F.reverse(F.rpad(g, 4, "0")), 4, 16), 2, "0")), "")


def unpack_hex(packed: Column, length: Column) -> Column:
    """The bases of packed bytes, exceptions not yet laid over."""
    pairs = F.regexp_extract_all(packed, F.lit("(..)"), F.lit(1))
    digits = F.array_join(F.transform(pairs, lambda h: F.reverse(F.lpad(F.conv(h, 16, 4), 4, "0"))), "")
    return F.substr(F.translate(digits, "0123", "ACGT"), F.lit(1), length)


# Limits


def max_frame_bytes(memory: Column) -> Column:
    return F.least(F.lit(MAX_FRAME).cast("long"), F.floor((memory - RESERVE) / 4)).cast("long")


def target_frame_bytes(memory: Column, target: Column) -> Column:
    return F.least(target, F.floor((memory - RESERVE) / 8)).cast("long")


def sample_limit_bytes(memory: Column) -> Column:
    return F.least(F.lit(MAX_FRAME).cast("long"), F.floor((memory - RESERVE) / 8)).cast("long")


def compress_bound(n: Column) -> Column:
    """The greatest size of n bytes compressed by Zstandard in one go."""
    small = F.lit(128 * 1024).cast("long")
    return n + F.shiftright(n, 8) + F.when(n < small, F.shiftright(small - n, 11)).otherwise(F.lit(0).cast("long"))
