"""The data source "readframes": archives of encoded frames.

Reading: the driver walks the frame headers, checks the footer's counts and checksum against them,
and makes one partition for each run of frames; tasks inflate, verify and decode. An archive that is
gzip-wrapped is read by one task. Sizes are admitted against limits before anything is allocated.

Writing: rows of encoded frames (see plans.archive); tasks write payloads to parts, commit() joins
them by frame id between header and footer, and the file appears at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from strandlake.functions import codec as C
from strandlake.functions import expr as E
from strandlake.functions.errors import ChecksumError, FormatError, UsageError
from strandlake.plans.archive import HEADER_FIELDS, unsigned
from strandlake.sources.storage import Staged, locate, open_input

SCHEMA = "frame_id long, read_no long, id string, comment string, sequence string, quality string"
NAMES = ["frame_id", "read_no", "id", "comment", "sequence", "quality"]
MIB = 1 << 20
MEMORY_MIB = 16384
#: Payload bytes of the frames that one task reads.
TASK_BYTES = 16 * MIB
RESERVE, MAX_FRAME, RECORD_COST = E.RESERVE, E.MAX_FRAME, 2 * E.RECORD_BYTES


def admit(h: C.FrameHeader, memory: int) -> None:
    limit = min(MAX_FRAME, (memory - RESERVE) // 4)
    sizes = [getattr(h, f) for f in HEADER_FIELDS[2:8]]
    if max(sizes) > limit:
        raise FormatError("a stream is larger than the limit")
    if RESERVE + h.record_count * RECORD_COST + 2 * (h.raw_ids + h.raw_seq + h.raw_qual) + h.payload > memory:
        raise FormatError("a frame needs more memory than the limit")


@dataclass
class Archive:
    profile: str
    paired: bool
    headers: list[tuple[int, C.FrameHeader]]  # (offset of the payload, header)
    records: int
    bases: int
    size: int
    rolling: int = 0  # checksum of all frames


def exactly(stream, n: int) -> bytes:
    data = stream.read(n)
    if len(data) != n:
        raise FormatError("truncated archive")
    return data


def frames_of(stream, paired: bool, memory: int, payload) -> Iterator[tuple[C.FrameHeader, object]]:
    """Headers with what payload(stream, header) makes of each; checks the footer at the end, and that nothing follows."""
    n = records = rolling = 0
    while True:
        marker = exactly(stream, 4)
        magic = int.from_bytes(marker, "little")
        if magic == C.FOOTER_MAGIC:
            break
        if magic != C.FRAME_MAGIC:
            raise FormatError("invalid frame marker")
        h = C.parse_frame_header(marker + exactly(stream, C.FRAME_HEADER_SIZE - 4), n, paired)
        admit(h, memory)
        yield h, payload(stream, h)
        n, records, rolling = n + 1, records + h.record_count, C.advance(rolling, h.checksum)
    _, size, frames, total, bases, checksum = C.FOOTER.unpack(marker + exactly(stream, C.FOOTER_SIZE - 4))
    if size != C.FOOTER_SIZE or (frames, total) != (n, records):
        raise FormatError("footer totals differ")
    if checksum != rolling:
        raise ChecksumError("footer checksum differs")
    if stream.read(1):
        raise FormatError("trailing bytes")
    yield None, (bases, rolling)


def inspect(path: str, memory: int = MEMORY_MIB * MIB) -> Archive:
    """Everything that headers and footer say; payloads are skipped."""
    stream = open_input(path)

    def skip(s, h):
        if s.seekable():
            at = s.tell()
            s.seek(h.payload, 1)
        else:
            at = -1
            exactly(s, h.payload)
        return at

    profile, paired = C.parse_header(stream.read(C.HEADER_SIZE))
    found = list(frames_of(stream, paired, memory, skip))
    (_, (bases, rolling)), headers = found[-1], [(at, h) for h, at in found[:-1]]
    fs, p = locate(path)
    return Archive(profile, paired, headers, sum(h.record_count for _, h in headers), bases, fs.get_file_info(p).size, rolling)


@dataclass
class Run(InputPartition):
    """Frames to read: (offset, first record, header) of each; offsets below 0 mean the whole stream."""

    frames: list


class FramesReader(DataSourceReader):
    def __init__(self, options):
        if not options.get("path"):
            raise UsageError("a path is needed")
        self.path = options["path"]
        self.memory = int(options.get("memory_mib", MEMORY_MIB)) * MIB

    def partitions(self):
        first, runs, size = 0, [], TASK_BYTES
        for at, h in inspect(self.path, self.memory).headers:
            if size >= TASK_BYTES and (at >= 0 or not runs):
                runs.append(Run([]))
                size = 0
            runs[-1].frames.append((at, first, h))
            first, size = first + h.record_count, size + h.payload
        return runs or [Run([])]

    def read(self, partition):
        if not partition.frames:
            return
        if partition.frames[0][0] < 0:
            stream = open_input(self.path)
            _, paired = C.parse_header(exactly(stream, C.HEADER_SIZE))
            first = 0
            for h, data in frames_of(stream, paired, self.memory, lambda s, h: exactly(s, h.payload)):
                if h:
                    yield self.decode(h, data, first)
                    first += h.record_count
            return
        fs, p = locate(self.path)
        with fs.open_input_file(p) as f:
            for at, first, h in partition.frames:
                f.seek(at)
                yield self.decode(h, exactly(f, h.payload), first)

    def decode(self, h: C.FrameHeader, data: bytes, first: int) -> pa.RecordBatch:
        a, b = h.enc_ids, h.enc_ids + h.enc_seq
        records = C.decode_frame(h, data[:a], data[a:b], data[b:])
        n = len(records)
        return pa.RecordBatch.from_arrays([pa.array([h.frame_id] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()), *records.arrow()], names=NAMES)


@dataclass
class Written(WriterCommitMessage):
    path: str
    frames: list  # (frame_id, offset, bytes, records, bases, checksum)


class FramesWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite):
        self.header = C.header(options.get("profile", "illumina"), options.get("paired", "false").lower() == "true")
        self.staged = Staged(options["path"], overwrite or options.get("force", "false").lower() == "true")

    def write(self, iterator):
        context = TaskContext.get()
        path = self.staged.part(f"{context.partitionId():06d}-{context.taskAttemptId()}")
        frames, at = [], 0
        with self.staged.fs.open_output_stream(path) as out:
            for batch in iterator:
                for r in batch.to_pylist():
                    h = C.FrameHeader(*(r[f] for f in HEADER_FIELDS[:-1]), unsigned(r["checksum"]))
                    data = h.pack() + r["ids"] + r["seqs"] + r["quals"]
                    out.write(data)
                    frames.append((h.frame_id, at, len(data), h.record_count, r["bases"], h.checksum))
                    at += len(data)
        return Written(path, frames)

    def commit(self, messages):
        frames = sorted((f, m.path) for m in messages if m for f in m.frames)
        if [f[0] for f, _ in frames] != list(range(len(frames))):
            self.staged.abort()
            raise UsageError("frame ids are not 0, 1, 2 and so on")
        rolling, opened = 0, {}
        with self.staged.open() as out:
            out.write(self.header)
            for (_, at, n, _, _, checksum), path in frames:
                if path not in opened:
                    opened[path] = self.staged.fs.open_input_file(path)
                opened[path].seek(at)
                out.write(opened[path].read(n))
                rolling = C.advance(rolling, checksum)
            out.write(C.footer(len(frames), sum(f[3] for f, _ in frames), sum(f[4] for f, _ in frames), rolling))
        for f in opened.values():
            f.close()
        self.staged.commit()

    def abort(self, messages):
        self.staged.abort()


class FramesSource(DataSource):
    @classmethod
    def name(cls):
        return "readframes"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FramesReader(self.options)

    def writer(self, schema, overwrite):
        return FramesWriter(self.options, overwrite)
