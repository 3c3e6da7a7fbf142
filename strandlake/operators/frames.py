"""Frames: bounded runs of reads in their order, their sizes and their memory."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from strandlake.functions import expr as E

#: Bytes that a record costs beside its text while a frame is in memory, twice over.
RECORD_COST = 2 * E.RECORD_BYTES


class Cutter:
    """Cuts a stream of record sizes into frames: a frame ends once it holds the target (and, for pairs, an even count)."""

    def __init__(self, target: int, paired: bool):
        self.target, self.paired = target, paired
        self.frame = self.held = self.count = 0

    def cut(self, sizes: np.ndarray) -> np.ndarray:
        """Frame numbers of the next records."""
        out = np.empty(len(sizes), np.int64)
        total = np.concatenate([[0], np.cumsum(sizes)])
        at = 0
        while at < len(sizes):
            end = int(np.searchsorted(total, total[at] + self.target - self.held)) if self.held < self.target else at + 1
            end = max(end, at + 1)
            if self.paired and (self.count + end - at) % 2:
                end += 1
            full = end <= len(sizes)
            end = min(end, len(sizes))
            out[at:end] = self.frame
            if full:
                self.frame, self.held, self.count = self.frame + 1, 0, 0
            else:
                self.held += int(total[end] - total[at])
                self.count += end - at
            at = end
        return out


def assign_frames(reads: DataFrame, target: int, paired: bool = False, file_col: str | None = None) -> DataFrame:
    """reads with frame_id. Files are cut independently and in parallel; within a file frames follow read_no.

    Where a frame ends depends on all records before it, so one task for each file goes through the sizes
    of its records, two numbers each; the reads themselves are not moved. The first read of each frame
    comes to the driver (one number for each frame) and goes to the tasks that number the reads.
    """
    retained = E.retained_bytes(*[F.col(c) for c in ("id", "comment", "sequence", "quality")])
    file = F.col(file_col).cast("string") if file_col else F.lit(None).cast("string")
    sized = reads.select(file.alias("file"), F.col("read_no"), retained.alias("size"))
    sized = sized.repartition(F.col("file")) if file_col else sized.repartition(1)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, cutter, last = object(), None, None
        for b in batches:
            files, numbers, sizes = b.column(0).to_pylist(), b.column(1).to_numpy(), b.column(2).to_numpy()
            at, out = 0, []
            while at < len(sizes):
                end = at + 1
                while end < len(sizes) and files[end] == files[at]:
                    end += 1
                if cutter is None or files[at] != held:
                    held, cutter, last = files[at], Cutter(target, paired), -1
                frame = cutter.cut(sizes[at:end])
                new = np.flatnonzero(np.append(frame[0] != last, frame[1:] != frame[:-1]))
                last = int(frame[-1])
                out += [(held, int(frame[i]), int(numbers[at + i])) for i in new.tolist()]
                at = end
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64()))], names=["file", "frame_id", "first"])

    found = sized.sortWithinPartitions("file", "read_no").mapInArrow(cut, "file string, frame_id long, first long").collect()
    firsts: dict = {}
    for r in sorted(found, key=lambda r: (r.file or "", r.frame_id)):
        firsts.setdefault(r.file, []).append(r.first)
    firsts = {f: np.array(x) for f, x in firsts.items()}
    schema = StructType([*reads.schema.fields, StructField("frame_id", LongType())])
    names = to_arrow_schema(schema).names

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(names.index("read_no")).to_numpy()
            if file_col:
                files = b.column(names.index(file_col)).cast(pa.string())
                frame = np.zeros(len(n), np.int64)
                for f in files.unique().to_pylist():
                    own = np.array([x == f for x in files.to_pylist()])
                    frame[own] = np.searchsorted(firsts[f], n[own], "right") - 1
            else:
                frame = np.searchsorted(firsts[None], n, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(frame)], names=names)

    return reads.mapInArrow(number, schema)


def exception_positions(reads: DataFrame) -> DataFrame:
    """(read_no, pos, base, delta) of all symbols that two bits cannot hold; the first delta is absolute."""
    runs = reads.select("read_no", F.posexplode(F.split("sequence", "")).alias("pos", "base"))
    found = runs.where(~F.col("base").isin("A", "C", "G", "T", ""))
    before = F.lag("pos", 1, 0).over(Window.partitionBy("read_no").orderBy("pos"))
    return found.withColumn("delta", F.col("pos") - before)


def varint_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + E.varint_size(x.cast("long")))


def exception_deltas(sequence: Column) -> Column:
    """The deltas of a read's exceptions as an array, inside its row."""
    symbols = F.filter(F.transform(F.split(sequence, ""), lambda b, i: F.when(b.isin("A", "C", "G", "T", ""), F.lit(None)).otherwise(i)), lambda x: x.isNotNull())
    return F.transform(F.arrays_zip(symbols.alias("p"), F.concat(F.array(F.lit(0)), symbols).alias("q")), lambda z: z["p"] - z["q"])


def stream_sizes(framed: DataFrame, *groups: str) -> DataFrame:
    """Raw bytes of the three streams of each group, and its bases."""
    size = lambda c: E.varint_size(F.length(c).cast("long")) + F.length(c)
    found = F.length("sequence") - F.length(F.regexp_replace("sequence", "[^ACGT]", ""))
    deltas = F.filter(exception_deltas(F.col("sequence")), lambda x: x.isNotNull())
    exceptions = F.when(found == 0, F.lit(0).cast("long")).otherwise(found + varint_sum(deltas))
    sequence = E.varint_size(F.length("sequence").cast("long")) + E.packed_size(F.length("sequence")) + E.varint_size(found.cast("long")) + exceptions
    n = E.varint_size(F.col("n_reads"))
    sums = framed.groupBy(*groups).agg(
        F.count("*").alias("n_reads"),
        F.sum(size("id") + size("comment")).alias("i"),
        F.sum(sequence).alias("s"),
        F.sum(size("quality")).alias("q"),
        F.sum(F.length("sequence")).alias("bases"),
        F.sum(F.length("id") + F.length("comment") + F.length("sequence") + F.length("quality")).alias("text"),
    )
    return sums.select(*groups, "n_reads", "bases", "text", *[(F.col(c) + n).cast("long").alias(name) for c, name in (("i", "raw_ids"), ("s", "raw_sequences"), ("q", "raw_qualities"))])


def compress_peak(sizes: DataFrame) -> Column:
    """Estimated bytes of memory to encode a frame, from stream_sizes()."""
    raw = [F.col(c) for c in ("raw_ids", "raw_sequences", "raw_qualities")]
    return F.lit(E.RESERVE).cast("long") + F.col("n_reads") * RECORD_COST + F.col("text") + 4 * F.col("n_reads") + sum((c + E.compress_bound(c) for c in raw[1:]), raw[0] + E.compress_bound(raw[0]))


def decompress_peak(n: Column, raw: Column, encoded: Column) -> Column:
    return F.lit(E.RESERVE).cast("long") + n * RECORD_COST + 2 * raw + encoded
