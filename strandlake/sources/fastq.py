"""The data source "fastq": records of FASTQ files, plain or gzip, and canonical FASTQ output.

Reading: one partition for each file (a parser has state, and a quality line may look like a
header), Arrow batches out. Columns: file_no, read_no (from 0 in each file), id, comment, sequence,
quality. Text is Latin-1, so that bytes and characters are the same. Faults name the line.

Writing: rows of (id, comment, sequence, quality) in the order of partitions; the parts become one
file that appears at once. With the option layout=parts they stay files of a folder, in order by
their names, which appears at once, and which is read like one file.

records_of() and Lane work on blocks of bytes instead of lines: all records of a block are checked
and measured as arrays. A block that is not plain (blank lines, carriage returns, faults) goes
through the strict parser, which says what is wrong.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from strandlake.functions import codec as C
from strandlake.functions.errors import FormatError, UsageError
from strandlake.sources.storage import Staged, is_plain, open_input, part_files

SCHEMA = "file_no int, read_no long, id string, comment string, sequence string, quality string"
NAMES = ["file_no", "read_no", "id", "comment", "sequence", "quality"]
CHUNK = 4 << 20
COPY = 1 << 20
#: Bytes of a frame's text that are encoded at once: their arrays take many times as much memory.
SLICE = 1 << 18
#: Bytes that a record counts for a frame besides its text: a fixed rule, see functions.expr.retained_bytes().
RETAINED = 132


class Parser:
    """Strict records of four lines; blank lines are skipped only where a header is due."""

    def __init__(self, stream: io.BufferedIOBase):
        self.stream, self.line_no, self.rest, self.ended = stream, 0, b"", False

    def lines(self) -> list[bytes]:
        """The next whole lines without their ends; an empty list at the end of the stream."""
        while not self.ended:
            data = self.stream.read(CHUNK)
            if not data:
                self.ended = True
                last, self.rest = self.rest, b""
                return [last.rstrip(b"\r")] if last else []
            found = (self.rest + data).split(b"\n")
            self.rest = found.pop()
            if found:
                return [x.rstrip(b"\r") for x in found] if b"\r" in data or b"\r" in found[0] else found
        return []

    def blocks(self) -> Iterator[tuple[list[bytes], list[bytes], list[bytes]]]:
        """(headers without @, sequences, qualities) of the next records."""
        held: list[bytes] = []
        while True:
            more = self.lines()
            held += more
            n = len(held) // 4 * 4
            heads, bases, plus, quals = held[0:n:4], held[1:n:4], held[2:n:4], held[3:n:4]
            if all(h[:1] == b"@" and h[1:2] not in (b"", b" ") for h in heads) and all(p[:1] == b"+" for p in plus) and all(bases) and list(map(len, bases)) == list(map(len, quals)):
                self.line_no += n
                held = held[n:]
                if heads:
                    yield [h[1:] for h in heads], bases, quals
            else:
                block, held = self.slowly(held)
                if block[0]:
                    yield block
            if not more:
                if any(held):
                    self.slowly(held, True)
                return

    def slowly(self, held: list[bytes], ended: bool = False):
        """Records line by line: skips blank lines, and says what is wrong."""
        at, out = 0, ([], [], [])
        while at < len(held):
            if not held[at]:
                at, self.line_no = at + 1, self.line_no + 1
                continue
            self.fault(not held[at].startswith(b"@"), at, held, "a header begins with @")
            self.fault(held[at][1:].split(b" ", 1)[0] == b"", at, held, "empty id")
            if at + 4 > len(held):
                if ended:
                    raise FormatError(f"line {self.line_no + len(held) - at}: the file ends inside a record")
                break
            head, bases, plus, quals = held[at : at + 4]
            self.fault(not bases, at, held, "empty sequence", 1)
            self.fault(not plus.startswith(b"+"), at, held, "a separator begins with +", 2)
            self.fault(len(bases) != len(quals), at, held, "sequence and quality differ in length", 3)
            for x, v in zip(out, (head[1:], bases, quals)):
                x.append(v)
            at, self.line_no = at + 4, self.line_no + 4
        return out, held[at:]

    def fault(self, wrong: bool, at: int, held: list[bytes], what: str, below: int = 0) -> None:
        if wrong:
            raise FormatError(f"line {self.line_no + below + 1}: {what}")


def lines_of(block: bytes):
    """(header, its first space or its end, its end, sequence, its end, quality, its end) of each record, as places in
    the block; None if the block is not whole records without blank lines and carriage returns."""
    buf = np.frombuffer(block, np.uint8)
    ends = np.flatnonzero(buf == 10)
    if not len(ends) or len(ends) % 4 or ends[-1] != len(buf) - 1 or b"\r" in block:
        return None
    starts = np.append(0, ends[:-1] + 1)
    (h, s, p, q), (he, se, pe, qe) = (starts.reshape(-1, 4).T, ends.reshape(-1, 4).T)
    if (buf[h] != 64).any() or (he - h < 2).any() or (buf[h + 1] == 32).any() or (buf[p] != 43).any() or (se == s).any() or (se - s != qe - q).any():
        return None
    spaces = np.append(np.flatnonzero(buf == 32), len(buf))
    return h, np.minimum(spaces[np.searchsorted(spaces, h)], he), he, s, se, q, qe


def records_at(block: bytes, lines) -> C.Records:
    h, space, he, s, se, q, qe = lines
    comment = np.minimum(space + 1, he)
    return C.Records(C.gather(block, h + 1, space - h - 1), C.gather(block, comment, he - comment), C.gather(block, s, se - s), C.gather(block, q, qe - q))


def records_of(block: bytes) -> C.Records:
    """The records of a block of whole records without blank lines."""
    return records_at(block, lines_of(block))


def slices_of(read, size: int) -> Iterator[C.Records]:
    """The records of `size` bytes of whole plain records, about SLICE bytes (one record at least) at a time; read(at, n) gives bytes."""
    held, lines = [], 0
    for at in range(0, size, SLICE):
        data = read(at, min(SLICE, size - at))
        held.append(data)
        lines += data.count(b"\n")
        if lines < 4:
            continue
        block = b"".join(held)
        end = len(block)
        for _ in range(lines % 4 + 1):
            end = block.rfind(b"\n", 0, end)
        yield records_of(block[: end + 1])
        held, lines = [block[end + 1 :]], lines % 4
    if any(held):
        raise FormatError("the file ends inside a record")


class Prefixed:
    """A stream with bytes before it."""

    def __init__(self, head: bytes, stream):
        self.head, self.stream = head, stream

    def read(self, n: int) -> bytes:
        head, self.head = self.head, b""
        return head or self.stream.read(n)


def blocks_of(stream) -> Iterator[tuple[bytes, tuple, int]]:
    """(bytes, lines_of() them, their place in the stream or -1 if they were rewritten) of all records."""
    offset, rest, line_no = 0, b"", 0
    while data := stream.read(CHUNK):
        block = rest + data
        n = block.count(b"\n") // 4 * 4
        if not n:
            rest = block
            continue
        end = int(np.flatnonzero(np.frombuffer(block, np.uint8) == 10)[n - 1]) + 1
        lines = lines_of(block[:end])
        if lines is None:
            rest = block
            break
        yield block[:end], lines, offset
        offset, rest, line_no = offset + end, block[end:], line_no + n
    if rest:
        parser = Parser(Prefixed(rest, stream))
        parser.line_no = line_no
        for found in parser.blocks():
            block = b"".join(b"@%b\n%b\n+\n%b\n" % r for r in zip(*found))
            yield block, lines_of(block), -1


def parse(stream, file_no: int = 0) -> Iterator[pa.RecordBatch]:
    n = 0
    for block, lines, _ in blocks_of(stream):
        size = len(lines[0])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(size, file_no, np.int32)), pa.array(np.arange(n, n + size)), *records_at(block, lines).arrow()], names=NAMES)
        n += size


@dataclass
class Segment:
    """Records of a lane that no frame has taken yet: where each begins and the last ends, in the file or in data."""

    starts: np.ndarray
    end: int
    offset: int
    data: bytes | None
    used: int = 0


def sizes_of(lines) -> np.ndarray:
    """Bytes that each record counts for a frame."""
    h, space, he, s, se, _, _ = lines
    return (he - h - 1 - (space < he)) + 2 * (se - s) + RETAINED


def measured(path: str) -> Iterator[tuple[np.ndarray, Segment]]:
    """(sizes, segment) of a file from its start to its end."""
    again = is_plain(path)
    for block, lines, offset in blocks_of(open_input(path)):
        yield sizes_of(lines), Segment(lines[0], len(block), offset, None if again and offset >= 0 else block)


def read_range(f, a: int, z: int) -> bytes:
    f.seek(a)
    return f.read(z - a)


def count_lines(f, a: int, z: int) -> tuple[int, bool]:
    """(line ends in a range of a file, whether it has what only the strict parser reads: blank lines, carriage returns)"""
    n, odd, last = 0, False, read_range(f, a - 1, a) if a else b"\n"
    for at in range(a, z, CHUNK):
        data = read_range(f, at, min(z, at + CHUNK))
        n += data.count(b"\n")
        odd |= b"\r" in data or b"\n\n" in last + data
        last = data[-1:]
    return n, odd


def measure_range(f, a: int, z: int, size: int, line: int) -> Iterator[tuple[np.ndarray, Segment]]:
    """(sizes, segment) of the records that begin in [a, z) of a file of plain lines, `line` of which end before a."""
    at, skip = a, -line % 4
    if a and read_range(f, a - 1, a) != b"\n":  # a lies inside a line
        skip = (skip - 1) % 4 + 1
    rest = b""
    while at < size:
        data = read_range(f, at, min(size, at + CHUNK))
        rest, at = rest + data, at + len(data)
        while skip and (end := rest.find(b"\n")) >= 0:
            rest, skip, line = rest[end + 1 :], skip - 1, line + 1
        if skip:
            continue
        begin = at - len(rest)
        if begin >= z:
            return
        ends = np.flatnonzero(np.frombuffer(rest, np.uint8) == 10)
        starts = np.append(0, ends[3::4] + 1)
        n = int(np.count_nonzero(begin + starts[:-1] < z))  # records that begin in the range and are whole
        if n:
            block = rest[: int(ends[4 * n - 1]) + 1]
            lines = lines_of(block)
            if lines is None:
                parser = Parser(io.BytesIO(block))
                parser.line_no = line
                list(parser.blocks())  # says what is wrong
                raise FormatError(f"line {line + 1}: not a plain record")
            yield sizes_of(lines), Segment(lines[0], len(block), begin, None)
            rest, line = rest[len(block) :], line + 4 * n


class Lane:
    """A file as measured records, which frames take in order; only what cannot be read again is held."""

    def __init__(self, found: Iterator[tuple[np.ndarray, Segment]]):
        self.segments: list[Segment] = []
        self.sizes = np.zeros(0, np.int64)
        self.found = found

    def fill(self) -> int:
        """Records that are measured and not yet seen."""
        while not len(self.sizes):
            got = next(self.found, None)
            if got is None:
                return 0
            self.sizes = got[0]
            self.segments.append(got[1])
        return len(self.sizes)

    def see(self, n: int) -> np.ndarray:
        sizes, self.sizes = self.sizes[:n], self.sizes[n:]
        return sizes

    def take(self, n: int) -> list[dict]:
        """The next n records as pieces: places in the file, or bytes."""
        pieces = []
        while n:
            x = self.segments[0]
            m = min(n, len(x.starts) - x.used)
            last = x.used + m
            a, z = int(x.starts[x.used]), int(x.starts[last]) if last < len(x.starts) else x.end
            if x.data is not None:
                pieces.append({"at": -1, "n": z - a, "data": x.data[a:z]})
            elif pieces and pieces[-1]["at"] >= 0 and pieces[-1]["at"] + pieces[-1]["n"] == x.offset + a:
                pieces[-1]["n"] += z - a
            else:
                pieces.append({"at": x.offset + a, "n": z - a, "data": None})
            x.used, n = last, n - m
            if last == len(x.starts):
                self.segments.pop(0)
        return pieces


@dataclass
class File(InputPartition):
    number: int
    path: str


class FastqReader(DataSourceReader):
    def __init__(self, options):
        if not options.get("path"):
            raise UsageError("a path is needed")
        self.paths = [p for p in options["path"].split(",") if p]

    def partitions(self):
        return [File(i, p) for i, p in enumerate(self.paths)]

    def read(self, partition):
        before = 0
        for path in part_files(partition.path):
            n = before
            for b in parse(open_input(path), partition.number):
                n = before + b.column(1)[-1].as_py() + 1
                yield b.set_column(1, NAMES[1], pa.compute.add(b.column(1), before)) if before else b
            before = n


@dataclass
class Part(WriterCommitMessage):
    number: int
    path: str | None
    n_bytes: int


class PartsWriter(DataSourceArrowWriter):
    """Writes parts beside the target; commit() joins them in the order of partitions."""

    def __init__(self, options, overwrite):
        force = overwrite or options.get("force", "false").lower() == "true"
        self.staged, self.stay = Staged(options["path"], force), options.get("layout", "file") == "parts"

    def render(self, batch: pa.RecordBatch) -> bytes:
        return C.Records.of_arrow(*(batch.column(batch.schema.get_field_index(c)) for c in NAMES[2:])).fastq()

    def write(self, iterator):
        context = TaskContext.get()
        path = self.staged.part(f"{context.partitionId():06d}-{context.taskAttemptId()}")
        n = 0
        with self.staged.fs.open_output_stream(path) as out:
            for batch in iterator:
                data = self.render(batch)
                out.write(data)
                n += len(data)
        return Part(context.partitionId(), path, n)

    def commit(self, messages):
        if self.stay:
            return self.staged.commit_parts([m.path for m in sorted((m for m in messages if m), key=lambda m: m.number)])
        with self.staged.open() as out:
            for m in sorted((m for m in messages if m), key=lambda m: m.number):
                with self.staged.fs.open_input_stream(m.path) as part:
                    while data := part.read(COPY):
                        out.write(data)
        self.staged.commit()

    def abort(self, messages):
        self.staged.abort()


class FastqSource(DataSource):
    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FastqReader(self.options)

    def writer(self, schema, overwrite):
        return PartsWriter(self.options, overwrite)
