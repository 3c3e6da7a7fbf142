"""Shuffles of packed records.

Operators that compare millions of small records (hash, document, place) would spend their time
on rows. Here a task packs its records by bucket into binary blocks, Spark shuffles the blocks to
one partition per bucket, and the bucket's task unpacks them into arrays. Buckets follow hashes or
sampled splitters, so they are of one size whatever the keys; their number grows with the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import kernels as K
from strandlake.llm.common import quoted

BLOCKS = "bucket int, data binary"
#: Records that a task packs at once.
PACK = 1 << 19
#: Bytes of text and rows for each bucket, so that a bucket's records fit in a worker's memory.
TEXT_PER_BUCKET, ROWS_PER_BUCKET = 32 << 20, 200_000

Record = dict[str, np.ndarray]


def bucket_count(docs: DataFrame, text_col: str) -> tuple[int, int]:
    """(rows, buckets), by the bytes of all texts: long texts take as much room as many short ones."""
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length(quoted(text_col).cast("string")).cast("long"))).first()
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return n, max(least, -(-(size or 0) // TEXT_PER_BUCKET), -(-n // ROWS_PER_BUCKET), 1)


def concat(parts: list[Record]) -> Record:
    return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


def pack(records: Record, bucket: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(bucket, kind="stable")
    found, begin = np.unique(bucket[order], return_index=True)
    ends = np.append(begin[1:], len(order))
    columns = [records[c][order] for c in records]
    data = [b"".join(c[a:z].tobytes() for c in columns) for a, z in zip(begin.tolist(), ends.tolist())]
    return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(data, pa.binary())], names=["bucket", "data"])


def packed(parts: Iterable[Record], finish: Callable[[Record], tuple[Record, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Blocks of the records, PACK or more at once. finish gets so many and returns them with their buckets."""
    held, n = [], 0
    for p in parts:
        held.append(p)
        n += len(next(iter(p.values())))
        if n >= PACK:
            yield pack(*finish(concat(held)))
            held, n = [], 0
    if n:
        yield pack(*finish(concat(held)))


def unpacked(batches: Iterable[pa.RecordBatch], kinds: dict[str, type]) -> Record:
    """All records of a bucket."""
    width = sum(np.dtype(t).itemsize for t in kinds.values())
    parts = {c: [] for c in kinds}
    for b in batches:
        for x in b.column(1):
            data = x.as_buffer()
            n, at = data.size // width, 0
            for c, t in kinds.items():
                parts[c].append(np.frombuffer(data, t, n, at))
                at += n * np.dtype(t).itemsize
    return {c: np.concatenate(p) if p else np.zeros(0, kinds[c]) for c, p in parts.items()}


def dealt(blocks: DataFrame, parts: int) -> DataFrame:
    return blocks.repartitionById(parts, F.col("bucket"))


#: Records that go back to their texts.
PLACES = {"d": np.int64, "t": np.int64, "pos": np.int32, "n": np.int32, "kind": np.int8}


def by_text(records: Record, parts: int) -> np.ndarray:
    return text_bucket(records["d"], records["t"], parts)


def text_bucket(d: np.ndarray, t: np.ndarray, parts: int) -> np.ndarray:
    return (K.mix(d.view(np.uint64) + K.mix(t.astype(np.int64).view(np.uint64))) % np.uint64(parts)).astype(np.int64)


def gather_places(blocks: DataFrame, parts: int) -> DataFrame:
    """(_d, _t, _places): for each text its records (pos, n, kind) without repeats, packed by pack_places()."""

    def run(batches):
        r = unpacked(batches, PLACES)
        if not len(r["d"]):
            return
        order = np.lexsort((r["kind"], r["n"], r["pos"], r["t"], r["d"]))
        r = {c: x[order] for c, x in r.items()}
        new = np.append(True, np.logical_or.reduce([r[c][1:] != r[c][:-1] for c in ("d", "t")]))
        fresh = new | np.append(True, np.logical_or.reduce([r[c][1:] != r[c][:-1] for c in ("pos", "n", "kind")]))
        r, new = {c: x[fresh] for c, x in r.items()}, new[fresh]
        begin = np.flatnonzero(new)
        ends = np.append(begin[1:], len(new))
        for low in range(0, len(begin), 10_000):
            a, z = begin[low : low + 10_000], ends[low : low + 10_000]
            data = [pack_places(r["pos"][i:j], r["n"][i:j], r["kind"][i:j]) for i, j in zip(a.tolist(), z.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(r["d"][a]), pa.array(r["t"][a]), pa.array(data, pa.binary())], names=["_d", "_t", "_places"])

    return dealt(blocks, parts).mapInArrow(run, "_d long, _t long, _places binary")


def pack_places(pos: np.ndarray, n: np.ndarray, kind: np.ndarray) -> bytes:
    return pos.tobytes() + n.tobytes() + kind.tobytes()


def places(data: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pos, n, kind) of a text; a null has none."""
    size = len(data or b"") // 9
    pos, n = (np.frombuffer(data or b"", np.int32, size, i * 4 * size).astype(np.int64) for i in (0, 1))
    return pos, n, np.frombuffer(data or b"", np.int8, size, 8 * size)
