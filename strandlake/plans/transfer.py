"""FASTQ files to archives and back as one Spark job each.

To an archive: records are measured and cut into frames, and a frame's place in the file (or its
bytes, if the file is compressed) goes to one of the tasks that read, encode and write frames. Ranges
of a large plain file are measured in parallel: a first pass counts the line ends of each range, so that
every range knows which of a record's four lines it begins in. Only the cut, which depends on all
records before, is one task's, and it sees two numbers of each record. From an archive: the frames that its headers name are dealt to tasks that read,
check, decode and write them as text. So no read is a row, and nothing is shuffled but places (and
compressed input, which no two tasks can read).

The parts that tasks write become one file by assemble(). The driver holds a row for each frame.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import codec as C
from strandlake.functions.errors import ChecksumError, FormatError
from strandlake.operators.frames import Cutter
from strandlake.operators.profile import SAMPLE_READS
from strandlake.plans.archive import admit as admit_encoded
from strandlake.plans.archive import signed, unsigned
from strandlake.sources.fastq import Lane, Segment, count_lines, measure_range, measured, parse, read_range, slices_of
from strandlake.sources.frames import Archive, exactly, frames_of
from strandlake.sources.storage import Staged, is_plain, locate, open_input

CUT = "frame_id long, lanes array<array<struct<at:bigint,n:bigint,data:binary>>>"
#: A frame that a task has written: its place in a part, and what it holds. The checksum is signed.
DONE = "frame_id long, path string, at long, n long, records long, bases long, text long, checksum long"
DONE_NAMES = [x.split()[0] for x in DONE.split(", ")]
#: Frames' bytes for each task, and the output up to which the driver joins parts by itself.
TASK_BYTES, JOINED = 1 << 30, 256 << 20
#: Bytes of a plain file that are measured by one task; a smaller file is measured by the task that cuts it.
RANGE = 256 << 20
COPY = 4 << 20


def cut_frames(lanes: list[Lane], target: int) -> Iterator[tuple[int, list]]:
    """(number, pieces of each file) of the frames; two files are mates."""
    cutter = Cutter(target, len(lanes) == 2)
    frame = held = 0
    while True:
        waiting = [lane.fill() for lane in lanes]
        if not (n := min(waiting)):
            break
        numbers = cutter.cut(np.stack([lane.see(n) for lane in lanes], 1).ravel())
        for i, count in enumerate(np.bincount(numbers - frame).tolist()):
            held += count
            if frame + i < cutter.frame:
                yield frame + i, [lane.take(held // len(lanes)) for lane in lanes]
                held = 0
        frame = cutter.frame
    if any(waiting):
        raise FormatError("paired inputs have different record counts")
    if held:
        yield frame, [lane.take(held // len(lanes)) for lane in lanes]


def rows_in(batches) -> Iterator[dict]:
    """The rows of batches, of which one at a time is a Python object (a batch of rows with bytes is large)."""
    return (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist())


def part_name() -> str:
    context = TaskContext.get()
    return f"{context.partitionId():06d}-{context.taskAttemptId()}"


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), *[pa.int64()] * 6]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=DONE_NAMES)


def tasks_for(spark: SparkSession, size: int) -> int:
    return max(2 * spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))


MEASURED = "i long, lane long, at long, sizes binary, lengths binary"


def line_counts(spark: SparkSession, path: str, size: int) -> list[int] | None:
    """How many lines end before each range of a plain file; None if it must be read from its start."""

    def count(batches):
        fs, name = locate(path)
        for b in batches:
            with fs.open_input_file(name) as f:
                found = [count_lines(f, i * RANGE, min(size, (i + 1) * RANGE)) for i in b.column(0).to_pylist()]
                last = read_range(f, size - 1, size)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in found]), pa.array([odd or last != b"\n" for _, odd in found])], names=["i", "n", "odd"])

    n = -(-size // RANGE)
    rows = sorted(spark.range(0, n, 1, n).mapInArrow(count, "i long, n long, odd boolean").collect())  # a row for each range
    ends = np.cumsum([r.n for r in rows])
    return None if any(r.odd for r in rows) or ends[-1] % 4 else [0, *ends[:-1].tolist()]


def measured_ranges(spark: SparkSession, paths: list[str]) -> DataFrame | None:
    """The records of large plain files, range by range (MEASURED); None if a file is small or not plain."""
    sizes = [fs.get_file_info(p).size or 0 for fs, p in map(locate, paths)]
    if min(sizes) <= RANGE or not all(map(is_plain, paths)):
        return None
    lines = [line_counts(spark, p, n) for p, n in zip(paths, sizes)]
    if None in lines:
        return None

    def measure(batches):
        for b in batches:
            for i, lane, line in zip(*(c.to_pylist() for c in b.columns)):
                fs, name = locate(paths[lane])
                with fs.open_input_file(name) as f:
                    for n, x in measure_range(f, i * RANGE, min(sizes[lane], (i + 1) * RANGE), sizes[lane], line):
                        lengths = np.diff(np.append(x.starts, x.end))
                        yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([lane]), pa.array([x.offset]), pa.array([n.astype(np.int64).tobytes()]), pa.array([lengths.astype(np.int64).tobytes()])], names=["i", "lane", "at", "sizes", "lengths"])

    rows = [(i, lane, n) for lane, own in enumerate(lines) for i, n in enumerate(own)]
    table = spark.createDataFrame(rows, "i long, lane long, line long")
    return table.repartitionById(len(rows), (F.col("i") * len(paths) + F.col("lane")).cast("int") % len(rows)).mapInArrow(measure, MEASURED)


def lanes_of(batches, n: int) -> list[Lane]:
    """The lanes of measured rows that come in the order of ranges, those of all lanes in turn."""
    waiting: list[deque] = [deque() for _ in range(n)]
    rows = rows_in(batches)

    def lane(k):
        while True:
            while not waiting[k]:
                r = next(rows, None)
                if r is None:
                    return
                waiting[r["lane"]].append(r)
            r = waiting[k].popleft()
            ends = np.cumsum(np.frombuffer(r["lengths"], np.int64))
            yield np.frombuffer(r["sizes"], np.int64), Segment(np.append(0, ends[:-1]), int(ends[-1]), r["at"], None)

    return [Lane(lane(k)) for k in range(n)]


def encode_files(spark: SparkSession, paths: list[str], target: int, memory: int, staged: Staged) -> list:
    """The rows (DONE) of all frames in order."""

    def cut(lanes):
        for number, pieces in cut_frames(lanes, target):
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([pieces], kind)], names=["frame_id", "lanes"])

    def from_start(batches):
        for _ in batches:
            yield from cut([Lane(measured(p)) for p in paths])

    def encode(batches):
        path, out, at = staged.part(part_name()), None, 0
        files: dict[str, object] = {}
        for row in rows_in(batches):
            both = mated([records_in(source, pieces, files) for source, pieces in zip(paths, row["lanes"])])
            h, bases, text, streams = C.encode_slices(row["frame_id"], both)
            admit_encoded((h.raw_ids, h.raw_seq, h.raw_qual), h.record_count, text, memory)
            out = out or staged.fs.open_output_stream(path)
            out.write(h.pack())
            for x in streams:
                out.write(x)
            n = C.FRAME_HEADER_SIZE + h.payload
            yield rows_of([(h.frame_id, path, at, n, h.record_count, bases, text, signed(h.checksum))])
            at += n
        if out:
            out.close()

    kind = pa.list_(pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])))
    size = sum(fs.get_file_info(p).size or 0 for fs, p in map(locate, paths))
    n = tasks_for(spark, size)
    ranges = measured_ranges(spark, paths)
    if ranges is None:
        frames = spark.range(1).repartition(1).mapInArrow(from_start, CUT)
    else:
        frames = ranges.repartition(1).sortWithinPartitions("i", "lane", "at").mapInArrow(lambda batches: cut(lanes_of(batches, len(paths))), CUT)
    dealt = frames.repartitionById(n, F.pmod("frame_id", F.lit(n)).cast("int"))
    return sorted(dealt.mapInArrow(encode, DONE).collect())


def records_in(source: str, pieces: list[dict], files: dict) -> Iterator[C.Records]:
    """The records of a frame's pieces of one file, slice by slice; `files` are those that are open."""
    for p in pieces:
        if p["data"] is None:
            if source not in files:
                fs, name = locate(source)
                files[source] = fs.open_input_file(name)
            yield from slices_of(lambda at, n, f=files[source], begin=p["at"]: exactly_at(f, begin + at, n), p["n"])
        else:
            yield from slices_of(lambda at, n, data=p["data"]: data[at : at + n], p["n"])


def mated(lanes: list[Iterator[C.Records]]) -> Iterator[C.Records]:
    """The records of one file as they come, or of two in turn, whose slices hold different numbers of records."""
    if len(lanes) == 1:
        yield from lanes[0]
        return
    held = [next(x, None) for x in lanes]
    while all(held):
        n = min(map(len, held))
        yield C.Records.mates(*(r.part(0, n) for r in held))
        held = [r.part(n, len(r)) if n < len(r) else next(x, None) for r, x in zip(held, lanes)]
    if any(held):
        raise FormatError("paired inputs have different record counts")


def exactly_at(f, at: int, n: int) -> bytes:
    f.seek(at)
    return exactly(f, n)


def decode_frames(spark: SparkSession, source: str, found: Archive, memory: int, staged: Staged | None) -> list:
    """The rows (DONE) of all frames in order; without `staged` frames are only checked."""
    paired, whole = found.paired, bool(found.headers) and found.headers[0][0] < 0

    def decoded(h, payload, out, path, at):
        a, b = h.enc_ids, h.enc_ids + h.enc_seq
        records = C.decode_frame(h, payload[:a], payload[a:b], payload[b:])
        text = records.text_bytes()
        if out:
            out.write(records.fastq())
        return rows_of([(h.frame_id, path, at, text if out else 0, len(records), int(records.bases[1].sum()), text, signed(h.checksum))])

    def run(batches):
        path = staged.part(part_name()) if staged else None
        out, at, f = None, 0, None
        for b in batches:
            for row in b.to_pylist():
                if staged and out is None:
                    out = staged.fs.open_output_stream(path)
                if whole:
                    stream = open_input(source)
                    C.parse_header(exactly(stream, C.HEADER_SIZE))
                    each = ((h, x) for h, x in frames_of(stream, paired, memory, lambda s, h: exactly(s, h.payload)) if h)
                else:
                    if f is None:
                        fs, name = locate(source)
                        f = fs.open_input_file(name)
                    h = C.parse_frame_header(row["header"], row["frame_id"], paired)
                    each = [(h, exactly_at(f, row["at"], h.payload))]
                for h, payload in each:
                    made = decoded(h, payload, out, path, at)
                    at += made.column(3)[0].as_py()
                    yield made
        if out:
            out.close()

    n = 1 if whole else min(max(1, len(found.headers)), tasks_for(spark, found.size))
    headers = found.headers[:1] if whole else found.headers
    rows = pa.table({"frame_id": pa.array([h.frame_id for _, h in headers], pa.int64()), "at": pa.array([at for at, _ in headers], pa.int64()), "header": pa.array([h.pack() for _, h in headers], pa.binary())})
    # Runs of neighbouring frames, so that a part is one range of the output.
    dealt = spark.createDataFrame(rows).repartitionById(n, F.floor(F.col("frame_id") * n / max(1, len(headers))).cast("int")) if len(headers) else None
    done = sorted(dealt.sortWithinPartitions("frame_id").mapInArrow(run, DONE).collect()) if dealt is not None else []
    if (len(done), sum(r.records for r in done), sum(r.bases for r in done)) != (len(found.headers) if not whole else len(done), found.records, found.bases):
        raise FormatError("footer totals differ")
    rolling = 0
    for r in done:
        rolling = C.advance(rolling, unsigned(r.checksum))
    if rolling != found.rolling:
        raise ChecksumError("footer checksum differs")
    return done


def assemble(spark: SparkSession, staged: Staged, head: bytes, done: list, tail: bytes) -> None:
    """One file of head, the frames in order and tail, published at once.

    On a file system that is mounted, executors copy the parts to their places; the driver does so only for a small
    output. Other stores write a file from its start to its end, so there the driver copies.
    """
    pieces: list[list] = []  # (path, place in the part, bytes, place in the file)
    to = len(head)
    for r in done:
        if pieces and pieces[-1][0] == r.path and pieces[-1][1] + pieces[-1][2] == r.at:
            pieces[-1][2] += r.n
        else:
            pieces.append([r.path, r.at, r.n, to])
        to += r.n
    fs, target = staged.fs, staged.temporary
    mounted = isinstance(fs, pafs.LocalFileSystem)
    if not mounted or to <= JOINED:
        with staged.open() as out:
            out.write(head)
            for path, at, n, _ in pieces:
                with fs.open_input_file(path) as part:
                    for data in ranges_of(part, at, n):
                        out.write(data)
            out.write(tail)
    else:
        with open(target, "wb") as out:
            out.write(head)
            out.truncate(to)
            out.seek(to)
            out.write(tail)

        def copy(batches):
            for b in batches:
                for path, at, n, place in zip(*(c.to_pylist() for c in b.columns)):
                    with fs.open_input_file(path) as part, open(target, "r+b") as out:
                        out.seek(place)
                        for data in ranges_of(part, at, n):
                            out.write(data)
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

        rows = spark.createDataFrame(pa.table([pa.array(c) for c in zip(*pieces)], names=["path", "at", "n", "place"]))
        rows.repartition(tasks_for(spark, to)).mapInArrow(copy, "n long").agg(F.sum("n")).collect()
    staged.commit()


def ranges_of(f, at: int, n: int) -> Iterator[bytes]:
    f.seek(at)
    while n:
        data = exactly(f, min(n, COPY))
        n -= len(data)
        yield data


def first_reads(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The first reads (SAMPLE_READS of each file at most), numbered in their order; mates in turn."""

    def run(batches):
        for _ in batches:
            for k, path in enumerate(paths):
                n = 0
                for b in parse(open_input(path)):
                    b = b.slice(0, SAMPLE_READS - n)
                    n += b.num_rows
                    number = pa.compute.add(pa.compute.multiply(b.column(1), len(paths)), k)
                    yield pa.RecordBatch.from_arrays([number, *b.columns[2:]], names=["read_no", *b.schema.names[2:]])
                    if n >= SAMPLE_READS:
                        break

    return spark.range(1).repartition(1).mapInArrow(run, "read_no long, id string, comment string, sequence string, quality string")

