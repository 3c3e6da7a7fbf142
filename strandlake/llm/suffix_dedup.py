"""Removal of repeated byte strings by a distributed sparse suffix array.

Suffixes. A full suffix array has a suffix for each byte. Here each window of 400 bytes has one
suffix that stands for it: the one that begins at the place with the smallest hash among the
window's first places. The choice depends on the window's bytes alone, so equal windows stand
under equal suffixes. Windows in a row that share a suffix form a block.

Order. A suffix is the sequence of tokens (its first 8 bytes; the next 8; a hash of its first 209
bytes; a hash of all its block's bytes), so suffixes stand in the order of their bytes, and those
that share 16 bytes by what the hashes say of the rest. Splitters sampled from the data, so many for
each bucket, cut the order into ranges by leading tokens, with a salt behind the last token so that a
frequent suffix spreads over several buckets. Buckets sort their suffixes by multikey quicksort and
compare neighbours; the first and the last suffix of each bucket are then compared across the
boundaries, two rows a bucket in one task. Equal blocks are those whose 128 bits of hash are equal,
which is why their bytes need not be sent: sending all bytes of all suffixes is six times the input.

Result. If a whole block occurs twice, all its windows are repeats. Where one suffix begins blocks
of several kinds, their windows are sorted once more, each as a suffix of its own (of a repeated
block, those of one copy). All else is unique.

Hot keys: of equal suffixes that a task holds at once, one is compared for all. Texts are shuffled once; only those with repeats are written and moved again.

Defined results: null and empty texts have no bytes; texts below 400 bytes lose nothing; rows
that repeat are repeats of one another.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from strandlake.llm import exchange as X
from strandlake.llm import kernels as K
from strandlake.llm.common import Work, quoted, row_keys

LENGTH = 400
SPREAD = 192
GRAM = 16
#: Documents that the splitters are sampled from, in all and for each bucket at least, and suffixes of each.
SAMPLE_DOCS, SAMPLE_PER_BUCKET, SAMPLE_SUFFIXES = 1500, 0.5, 40

KEYS = ["k0", "k1", "k2", "k3"]
#: A suffix: its four tokens, its text, its block's first window and windows. known 0: compare; 1: a repeat already,
#: bears witness; 2: a repeat already.
SUFFIX = {"k0": np.int64, "k1": np.int64, "k2": np.int64, "k3": np.int64, "d": np.int64, "t": np.int64, "pos": np.int32, "n": np.int32, "known": np.int8}
#: Kinds of places: a repeated block or window; an open block.
GONE, OPEN = 0, 1


def multikey_quicksort(keys: list[np.ndarray], small: int = 2048) -> np.ndarray:
    """The order of rows by keys[0], then keys[1] and so on: three-way partitions by one token, of which only
    the equal part goes on to the next token."""
    order = np.arange(len(keys[0]))
    todo = [(0, len(order), 0)]
    while todo:
        a, z, depth = todo.pop()
        if depth == len(keys) or z - a < 2:
            continue
        part = order[a:z]
        if z - a <= small:
            order[a:z] = part[np.lexsort([k[part] for k in keys[:depth:-1]] + [keys[depth][part]])]
            continue
        token = keys[depth][part]
        pivot = np.sort(token[:: max(1, (z - a) // 31)])[len(token[:: max(1, (z - a) // 31)]) // 2]
        less, equal = part[token < pivot], part[token == pivot]
        order[a:z] = np.concatenate([less, equal, part[token > pivot]])
        b, c = a + len(less), a + len(less) + len(equal)
        todo += [(a, b, depth), (b, c, depth + 1), (c, z, depth)]
    return order


def sliding_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """For each place, the first place of the smallest of the next w values (32 bits of each count)."""
    n = len(values)
    packed = (values & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    blocks = np.full(-(-n // w) * w + w, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = packed
    grid = blocks.reshape(-1, w)
    head = np.minimum.accumulate(grid, axis=1).ravel()
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(tail[:n], head[w - 1 : w - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def lead(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes that begin at each place, in an order-keeping long."""
    value = np.zeros(len(at), np.uint64)
    for j in range(8):
        value = (value << np.uint64(8)) | buf[at + j].astype(np.uint64)
    return K.signed(value ^ np.uint64(1 << 63))


def block_suffixes(buf: np.ndarray, offsets: np.ndarray, length: int, spread: int, gram: int):
    """(row, first window, windows, *KEYS) of all blocks of a slice."""
    sizes = np.diff(offsets)
    n_windows = np.maximum(sizes - length + 1, 0)
    if not n_windows.sum():
        return (np.zeros(0, np.int64),) * 7
    row = np.repeat(np.arange(len(sizes)), n_windows)
    at = K.ranges(offsets[:-1], n_windows)
    spans = K.byte_spans(buf)
    places = np.arange(len(buf) - gram + 1)
    where = sliding_argmin(spans(places, places + gram), spread)[at]
    new = np.ones(len(at), bool)
    new[1:] = (where[1:] != where[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(at)))
    low, suffix, row = at[begin], where[begin], row[begin]
    k2 = spans(suffix, suffix + length - spread + 1)
    k3 = K.byte_spans(buf, 1)(low, low + count - 1 + length)
    return row, low - offsets[row], count, lead(buf, suffix), lead(buf, suffix + 8), K.signed(k2), K.signed(k3)


def salt_of(r: X.Record) -> np.ndarray:
    return K.signed(K.mix((r["d"] ^ (r["pos"].astype(np.int64) << 20)).view(np.uint64) + r["t"].astype(np.int64).view(np.uint64)))


def deal(r: X.Record, splitters: np.ndarray) -> tuple[X.Record, np.ndarray]:
    """Suffixes with their buckets; of equal ones one is compared, the others only come along."""
    first, count = K.first_of_each(*(r[c] for c in KEYS))
    known = np.where(count > 1, np.where(first, 1, 2), 0).astype(np.int8)
    salt = salt_of(r)
    bucket = bucket_of([*(r[c] for c in KEYS), salt], splitters)
    loose = (salt.view(np.uint64) % np.uint64(len(splitters) + 1)).astype(np.int64)
    return r | {"known": known}, np.where(known == 2, loose, bucket)


def suffixes(row, pos, n, k0, k1, k2, k3, d, t) -> X.Record:
    return dict(zip(SUFFIX, (k0, k1, k2, k3, d[row], t[row], pos.astype(np.int32), n.astype(np.int32), np.zeros(len(row), np.int8))))


def bucket_of(keys: list[np.ndarray], splitters: np.ndarray) -> np.ndarray:
    """How many splitters (rows of longs, sorted) are not above each key."""
    n, m = len(keys[0]), len(splitters)
    if not m:
        return np.zeros(n, np.int64)
    low, high = np.searchsorted(splitters[:, 0], keys[0], "left"), np.searchsorted(splitters[:, 0], keys[0], "right")
    tied = np.flatnonzero(low < high)
    for i in tied.tolist():  # only keys that share a splitter's first 8 bytes
        key = tuple(int(k[i]) for k in keys)
        a, b = int(low[i]), int(high[i])
        while a < b:
            mid = (a + b) // 2
            if tuple(splitters[mid].tolist()) <= key:
                a = mid + 1
            else:
                b = mid
        high[i] = a
    return high


def block_records(length: int, spread: int, gram: int):
    """Over batches of (_d, _t, _text): the suffixes of all blocks; `most` thins them to so many a text."""

    def run(batches, most=0):
        for b in batches:
            d, t = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for row, end, buf, offsets in K.slices(K.string_column(b.column(2))):
                made = block_suffixes(buf, offsets, length, spread, gram)
                yield suffixes(*(x[:: thin(len(made[0]), end - row, most)] for x in made), d[row:end], t[row:end])

    return run


def window_records(length: int):
    """Over batches of (_d, _t, _text, _places): the suffixes of the windows of open blocks."""

    def run(batches, most=0):
        for b in batches:
            d, t = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            found = b.column(3).to_pylist()
            for row, end, buf, offsets in K.slices(K.string_column(b.column(2))):
                r, at = opened(found[row:end], offsets)
                step = thin(len(at), end - row, most)
                at, r = at[::step], r[::step]
                k2, k3 = (K.signed(K.byte_spans(buf, lane)(at, at + length)) for lane in (0, 1))
                yield suffixes(r, at - offsets[r], np.ones(len(at), np.int64), lead(buf, at), lead(buf, at + 8), k2, k3, d[row:end], t[row:end])

    return run


def opened(found: list[bytes | None], begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts, windows) of the open blocks of texts that begin at these places."""
    own = [(p[k == OPEN], n[k == OPEN]) for p, n, k in map(X.places, found)]
    block = np.repeat(np.arange(len(own)), [len(p) for p, _ in own])
    n = np.concatenate([n for _, n in own])
    return np.repeat(block, n), K.ranges(begin[block] + np.concatenate([p for p, _ in own]), n)


def gone(*found: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts, first windows, windows) of the repeated blocks; found has a list for each sort."""
    own = [(i, p[k == GONE], n[k == GONE]) for places in found for i, x in enumerate(places) for p, n, k in [X.places(x)]]
    return np.repeat([i for i, _, _ in own], [len(p) for _, p, _ in own]), np.concatenate([p for _, p, _ in own]), np.concatenate([n for _, _, n in own])


def thin(n: int, texts: int, most: int) -> int:
    return n // (most * texts) + 1 if most else 1


def sample_splitters(sample: DataFrame, records, parts: int) -> np.ndarray:
    """parts - 1 splitters from at most SAMPLE_SUFFIXES suffixes of each text of a bounded sample."""

    def run(batches):
        for r in records(batches, SAMPLE_SUFFIXES):
            yield pa.RecordBatch.from_arrays([*(pa.array(r[c]) for c in KEYS), pa.array(salt_of(r))], names=[*KEYS, "salt"])

    columns = [*KEYS, "salt"]
    found = sample.mapInArrow(run, ", ".join(f"{c} long" for c in columns)).toArrow()
    keys = np.stack([found.column(c).to_numpy() for c in columns], 1).reshape(-1, len(columns)).astype(np.int64)
    if not len(keys) or parts < 2:
        return np.zeros((0, len(columns)), np.int64)
    keys = keys[np.lexsort(keys.T[::-1])]
    return keys[(np.arange(1, parts) * len(keys)) // parts]


#: What a bucket gives: packed places for the texts (end 0), and its first (1) and last (2) suffix or only one (3).
BUCKET = "bucket int, data binary, end byte, own int, k0 long, k1 long, k2 long, k3 long, d long, t long, pos int, n int, twice boolean, near boolean"


def sort_bucket(parts: int):
    """mapInArrow over one bucket: sort, compare neighbours."""

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        own = batches[0].column(0)[0].as_py()
        r = X.unpacked(batches, SUFFIX)
        loose = r["known"] == 2
        a = {c: x[~loose] for c, x in r.items()}
        order = multikey_quicksort([a[c] for c in KEYS])
        a = {c: x[order] for c, x in a.items()}
        places = [{"d": r["d"][loose], "t": r["t"][loose], "pos": r["pos"][loose], "n": r["n"][loose], "kind": np.full(int(loose.sum()), GONE, np.int8)}]
        if len(order):
            step = [a[c][1:] == a[c][:-1] for c in KEYS]
            like = np.logical_and.reduce(step[:-1])
            equal = like & step[-1]
            twice = neighbours(equal) | (a["known"] == 1)
            # Windows are asked for of each kind of block, once for a repeated one, where a suffix begins several kinds.
            first, group = np.append(True, ~equal), np.cumsum(np.append(True, ~like)) - 1
            size = np.bincount(group)
            several = (np.bincount(group, first) > 1) | np.isin(np.arange(group[-1] + 1), [0, group[-1]])
            near = (first | ~twice) & (several & (size > 1))[group]
            end = np.zeros(len(order), np.int8)
            end[0] |= 1
            end[-1] |= 2
            for hit, kind in ((twice, GONE), (near, OPEN)):
                hit = hit & (end == 0)
                places.append({"d": a["d"][hit], "t": a["t"][hit], "pos": a["pos"][hit], "n": a["n"][hit], "kind": np.full(int(hit.sum()), kind, np.int8)})
            i = np.flatnonzero(end)
            none = pa.nulls(len(i), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(i), pa.int32()), none, pa.array(end[i]), pa.array(np.full(len(i), own, np.int32)), *(pa.array(a[c][i]) for c in (*KEYS, "d", "t", "pos", "n")), pa.array(twice[i]), pa.array(near[i])], names=names)
        out = X.concat(places)
        if len(out["d"]):
            b = X.pack(out, X.by_text(out, parts))
            rest = [pa.nulls(b.num_rows, t) for t in (pa.int32(), *[pa.int64()] * (len(KEYS) + 2), pa.int32(), pa.int32(), pa.bool_(), pa.bool_())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.zeros(b.num_rows, np.int8)), *rest], names=names)

    names = [x.split()[0] for x in BUCKET.split(", ")]
    return run


def neighbours(same: np.ndarray) -> np.ndarray:
    out = np.zeros(len(same) + 1, bool)
    out[1:] |= same
    out[:-1] |= same
    return out


def across_boundaries(ends: DataFrame, parts: int) -> DataFrame:
    """X.BLOCKS of the first and last suffixes of all buckets, compared with their neighbours in the next bucket."""
    order = Window.orderBy("own", "end")  # two rows of a bucket at most

    def like(keys):
        sides = [[F.col(c) == side(c).over(order) for c in keys] for side in (F.lag, F.lead)]
        return functools.reduce(lambda a, b: a | b, [F.coalesce(functools.reduce(lambda a, b: a & b, x), F.lit(False)) for x in sides])

    found = ends.select("d", "t", "pos", "n", (F.col("twice") | like(KEYS)).alias("gone"), (F.col("near") | like(KEYS[:-1])).alias("open"))

    def run(batches):
        for b in batches:
            r = {c: b.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(("d", "t", "pos", "n", "gone", "open"))}
            for c, kind in (("gone", GONE), ("open", OPEN)):
                hit = r[c]
                if hit.any():
                    out = {k: r[k][hit] for k in ("d", "t", "pos", "n")} | {"kind": np.full(int(hit.sum()), kind, np.int8)}
                    yield X.pack(out, X.by_text(out, parts))

    return found.mapInArrow(run, X.BLOCKS)


def suffix_sort(source: DataFrame, records, rows: int, parts: int, work: Work, name: str) -> DataFrame:
    """(_d, _t, _places): of each text the blocks that another block equals (GONE) and those whose windows must be
    asked for (OPEN); a repeated block may be open as a witness for others. It reads the work table `name`."""
    most = max(SAMPLE_DOCS, SAMPLE_PER_BUCKET * parts)
    sample = source.sample(most / rows, 7) if rows > most else source
    splitters = sample_splitters(sample, records, parts)
    blocks = source.mapInArrow(lambda batches: X.packed(records(batches), lambda r: deal(r, splitters)), X.BLOCKS)
    done = work.save(X.dealt(blocks, parts).mapInArrow(sort_bucket(parts), BUCKET), name)
    places = done.where("end = 0").select("bucket", "data")
    return X.gather_places(places.unionByName(across_boundaries(done.where("end > 0"), parts)), parts)


def split(names: list[str], n_keep: int):
    def run(batches):
        for b in batches:
            text, found = K.string_column(b.column(n_keep)), b.column(n_keep + 1)
            has = found.is_valid().to_numpy(zero_copy_only=False)
            sizes, sha = [], []
            for i, busy in enumerate(has):
                data = None if busy else text[i].as_buffer().to_pybytes()
                sizes.append(None if busy else len(data))
                sha.append(None if busy else hashlib.sha256(data).hexdigest())
            kept = pa.compute.if_else(pa.array(has), text, pa.scalar(None, text.type))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n_keep)), kept, found, pa.array(sizes, pa.int64()), pa.array(sha, pa.string())], names=names)

    return run


def cut(n_keep: int, length: int, names: list[str], with_bytes: bool):
    def run(batches):
        for b in batches:
            text = K.string_column(b.column(n_keep))
            found, more = b.column(n_keep + 1).to_pylist(), b.column(n_keep + 2).to_pylist()
            n_bytes, sha = b.column(n_keep + 3).to_pylist(), b.column(n_keep + 4).to_pylist()
            n_removed, n_spans, kept = [0] * len(sha), [0] * len(sha), [None] * len(sha)
            for i in range(len(sha)):
                if sha[i] is not None:
                    continue
                data = np.frombuffer(text[i].as_buffer(), np.uint8)
                _, begin, n = gone([found[i]], [more[i]])
                out = K.covered(len(data), begin, begin + n - 1 + length)
                left = data[~out].tobytes()
                n_bytes[i], n_removed[i], sha[i] = len(data), int(out.sum()), hashlib.sha256(left).hexdigest()
                n_spans[i] = int(out[:1].sum() + (out[1:] & ~out[:-1]).sum())
                kept[i] = left if with_bytes and n_removed[i] else None
            made = [pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n_keep)), *made], names=names)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, length: int = LENGTH, spread: int = SPREAD, gram: int = GRAM, with_bytes: bool = True) -> DataFrame:
    """For each row: the columns `keep` (by default the id), n_bytes, n_removed, n_spans, kept_sha256 and kept_bytes.

    kept_bytes has the remaining bytes where bytes were removed, else null.
    """
    if not 8 <= gram <= length - spread or spread < 1 or length - spread + 1 < 16:
        raise ValueError("gram and spread do not fit the length")
    keep = [id_col] if keep is None else keep
    names = [f"_c{i}" for i in range(len(keep))]
    base = docs.select(*[quoted(c).alias(n) for c, n in zip(keep, names)], *row_keys(id_col, text_col), F.coalesce(quoted(text_col), F.lit("")).alias("_text"))
    texts = base.select("_d", "_t", "_text")
    total, parts = X.bucket_count(docs, text_col)
    work = Work(docs.sparkSession, "suffixes")
    blocks = suffix_sort(texts, block_records(length, spread, gram), total, parts, work, "blocks")
    held = ["_d", "_t", *names]
    step = StructType([base.schema[c] for c in held] + [StructField("_text", StringType()), StructField("_places", BinaryType()), StructField("n_bytes", LongType()), StructField("sha", StringType())])
    joined = base.join(blocks, ["_d", "_t"], "left").select(*held, "_text", "_places")
    settled = work.save(joined.mapInArrow(split(step.names, len(held)), step), "texts")
    work.drop("blocks")
    opened = settled.where("_text is not null").select("_d", "_t", "_text", "_places")
    windows = suffix_sort(opened, window_records(length), opened.count(), parts, work, "windows").withColumnRenamed("_places", "_more")
    last = settled.join(windows, ["_d", "_t"], "left").select(*names, "_text", "_places", "_more", "n_bytes", "sha")
    out = StructType([base.schema[n] for n in names] + [StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("n_spans", LongType()), StructField("kept_sha256", StringType()), StructField("kept_bytes", BinaryType())])
    done = last.mapInArrow(cut(len(names), length, to_arrow_schema(out).names, with_bytes), out)
    return done.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes")


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
h AS (SELECT doc_id, i, md5(b[i:i + 399]) AS h FROM (SELECT doc_id, b, unnest(range(1, n - 398)) AS i FROM d WHERE n >= 400)),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS k FROM h),
o AS (SELECT doc_id, i, coalesce(i > lag(i) OVER by_place + 400, true) AS opens FROM g WHERE k > 1 WINDOW by_place AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
gone AS (SELECT doc_id, run, min(i) AS a, max(i) + 399 AS z FROM r GROUP BY doc_id, run),
gaps AS (SELECT doc_id, run, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY run), 0) + 1 AS a, a - 1 AS z FROM gone
  UNION ALL SELECT doc_id, max(run) + 1, max(z) + 1, 9223372036854775807 FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, unhex(string_agg(CASE WHEN z >= a AND a <= n THEN hex(b[a:least(z, n)]) ELSE '' END, '' ORDER BY run)) AS b FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
t AS (SELECT doc_id, sum(z - a + 1) AS n_removed, count(*) AS n_spans FROM gone GROUP BY doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(coalesce(kept.b, d.b)) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id) LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
