"""Frames as tables: encode reads to frames, decode them, and total them."""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from strandlake.functions import codec as C
from strandlake.functions import expr as E
from strandlake.functions.errors import UsageError

HEADER_FIELDS = tuple(C.FrameHeader.__dataclass_fields__)
ENCODED = StructType([StructField(f, LongType()) for f in (*HEADER_FIELDS, "bases")] + [StructField(c, BinaryType()) for c in ("ids", "seqs", "quals")])
DECODED = "frame_id long, frame_first long, frame_pos long, id string, comment string, sequence string, quality string"


def signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def unsigned(v: int) -> int:
    return v & ((1 << 64) - 1)


def admit(raw: tuple[int, int, int], n: int, text: int, memory: int) -> None:
    limit = min(E.MAX_FRAME, (memory - E.RESERVE) // 4)
    if max(raw) > limit:
        raise UsageError("a stream is larger than the limit")
    bound = sum(x + x + (x >> 8) + ((131072 - x) >> 11 if x < 131072 else 0) for x in raw)
    if E.RESERVE + 2 * E.RECORD_BYTES * n + text + 4 * n + bound > memory:
        raise UsageError("a frame needs more memory than the limit")


def encode_frames(framed: DataFrame, memory: int | None = None) -> DataFrame:
    """One row for each frame of reads with frame_id; a frame is a group of bounded size, encoded by one task.

    With `memory`, frames that would need more than so many bytes fail.
    """

    def encode(table: pa.Table) -> pa.Table:
        table = table.sort_by("read_no")
        h, bases, *data = C.encode_frame(table.column("frame_id")[0].as_py(), C.Records.of_arrow(*(table.column(c) for c in ("id", "comment", "sequence", "quality"))))
        if memory is not None:
            admit((h.raw_ids, h.raw_seq, h.raw_qual), h.record_count, table.nbytes, memory)
        values = [getattr(h, f) for f in HEADER_FIELDS]
        values[-1] = signed(values[-1])
        return pa.table([*(pa.array([v], pa.int64()) for v in (*values, bases)), *(pa.array([x], pa.binary()) for x in data)], names=[f.name for f in ENCODED])

    return framed.select("frame_id", "read_no", "id", "comment", "sequence", "quality").groupBy("frame_id").applyInArrow(encode, ENCODED)


def decode_frames(encoded: DataFrame, *archives: str) -> DataFrame:
    """The records of encoded frames, with their place; frame_first is how many records earlier frames hold.

    `archives` are string columns that tell archives apart; each is numbered by itself.
    """
    before = Window.partitionBy(*archives).orderBy("frame_id").rowsBetween(Window.unboundedPreceding, -1)  # two numbers for each frame
    key = [*archives, "frame_id"]
    first = encoded.select(*key, F.coalesce(F.sum("record_count").over(before), F.lit(0)).alias("frame_first"))
    schema = "".join(f"`{a}` string, " for a in archives) + DECODED
    names = [*archives, *(x.split()[0] for x in DECODED.split(", "))]

    def decode(batches):
        for b in batches:
            for r in b.to_pylist():
                h = C.FrameHeader(*(r[f] for f in HEADER_FIELDS[:-1]), unsigned(r["checksum"]))
                records = C.decode_frame(h, r["ids"], r["seqs"], r["quals"])
                n = len(records)
                own = [pa.array([r[a]] * n, pa.string()) for a in archives]
                yield pa.RecordBatch.from_arrays([*own, pa.array([h.frame_id] * n), pa.array([r["frame_first"]] * n), pa.array(range(n), pa.int64()), *records.arrow()], names=names)

    return encoded.join(first, key).mapInArrow(decode, schema)


def totals(encoded: DataFrame, *archives: str) -> DataFrame:
    """A row for each archive (by string columns; one row without them): frames, records, bases, encoded_bytes and the
    rolling checksum of the footer, which folds the checksums of an archive's frames in order (16 bytes for each frame)."""
    sums = encoded.groupBy(*archives).agg(
        F.count("*").alias("frames"),
        F.coalesce(F.sum("record_count"), F.lit(0)).alias("records"),
        F.coalesce(F.sum("bases"), F.lit(0)).alias("bases"),
        (F.coalesce(F.sum(C.FRAME_HEADER_SIZE + F.col("enc_ids") + F.col("enc_seq") + F.col("enc_qual")), F.lit(0)) + C.HEADER_SIZE + C.FOOTER_SIZE).alias("encoded_bytes"),
        F.transform(F.sort_array(F.collect_list(F.struct("frame_id", "checksum"))), lambda x: x["checksum"]).alias("checksums"),
    )
    kept = [*archives, "frames", "records", "bases", "encoded_bytes"]

    def fold(batches):
        for b in batches:
            rolling = [functools.reduce(lambda g, c: C.advance(g, unsigned(c)), x, 0) for x in b.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(map(signed, rolling), pa.int64())], names=[*kept, "rolling"])

    schema = "".join(f"`{a}` string, " for a in archives) + "frames long, records long, bases long, encoded_bytes long, rolling long"
    return sums.select(*kept, "checksums").mapInArrow(fold, schema)
