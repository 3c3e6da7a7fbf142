"""Benchmark decontamination by a prefix-filtered set join.

Items are cut into windows of 13 consecutive words (an item of fewer words is one window). A
window is contained in a document only if all its shingles are, so one necessary prefix token
is enough to find it: shingles of up to three words are ordered by how often the whole corpus
has them, and each window is looked up by its rarest one. A match fixes where the window would
begin (positional bound) and end (length bound); the words of the window are then compared.

Items come to the executors in blocks of a fixed size. A benchmark of one block costs two scans
of the corpus and no shuffle of texts; each further block costs two more scans and a written
intermediate table, so the benchmark may be of any size.

Defined results: null or empty texts have no words and no hits; an item without words has no
windows; a null item id is written as the string null; repeated rows are judged one by one.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from strandlake.llm import kernels as K
from strandlake.llm.common import annotate, materialize, quoted

WINDOW = 13
SHINGLE = 3
#: Bytes of item text that one broadcast block holds at most, as long as no single item is longer.
BLOCK_BYTES = 8 << 20

FIELDS = StructType([
    StructField("n_words", LongType()),
    StructField("n_hit", LongType()),
    StructField("n_items", LongType()),
    StructField("items_sha256", StringType()),
    StructField("spans", ArrayType(StructType([StructField("a", LongType()), StructField("b", LongType())]))),
    StructField("items", ArrayType(StringType())),
])


@dataclass
class Block:
    """The windows of a block of items, and for each shingle size the distinct shingles."""

    ids: list[str]
    length: np.ndarray  # of each window
    hash: np.ndarray
    text: bytes  # all words of the items, joined by one space
    text_from: np.ndarray  # text[text_from[w]:text_to[w]] are the words of window w
    text_to: np.ndarray
    item_from: np.ndarray  # items[item_from[w]:item_from[w + 1]] hold window w
    items: np.ndarray
    first: np.ndarray  # tokens of the item in which window w was seen first
    size: np.ndarray  # of the shingles of window w
    keys: dict[int, np.ndarray]  # by size: sorted hashes of distinct shingles
    shingles: np.ndarray  # hashes of shingles that begin at each token, by own window's size


def build_block(rows: list[tuple[str, str]], window: int = WINDOW) -> Block | None:
    ids = [r[0] for r in rows]
    t = K.Tokens(*K.flat(K.string_column(pa.array([r[1] for r in rows], pa.large_string()))), K.ALNUM, lower=True)
    if not len(t):
        return None
    doc, counts = t.doc_of(), t.counts
    length = np.minimum(counts, window)[doc]
    starts = np.flatnonzero(np.arange(len(t)) + length <= t.first[1:][doc])
    length, item = length[starts], doc[starts]
    h0, h1 = (t.spans(lane)(starts, starts + length) for lane in (0, 1))
    new, _ = K.first_of_each(length, h0, h1)
    order = np.lexsort((item, h1, h0, length))
    group = np.cumsum(new[order]) - 1
    pairs = np.unique(np.stack([group, item[order]]), axis=1)
    pick = order[new[order]]
    item_from = np.searchsorted(pairs[0], np.arange(len(pick) + 1))
    size = np.minimum(length[pick], SHINGLE)
    keys, shingles = {}, np.zeros(len(t), np.uint64)
    own = np.minimum(counts, SHINGLE)[doc]
    for s in np.unique(size):
        at = np.flatnonzero((own == s) & (np.arange(len(t)) + s <= t.first[1:][doc]))
        shingles[at] = t.spans()(at, at + s)
        keys[int(s)] = np.unique(shingles[at])
    text, begin, end = t.joined()
    first = starts[pick]
    return Block(ids, length[pick], h0[pick], text, begin[first], end[first + length[pick] - 1], item_from, pairs[1], first, size, keys, shingles)


class Filter:
    """Fast test whether hashes are among a few sorted keys."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(16, min(24, int(len(keys)).bit_length() + 6))
        self.table = np.zeros(1 << self.bits, bool)
        self.table[(keys & np.uint64((1 << self.bits) - 1)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of h are keys, their numbers among the keys)"""
        at = np.flatnonzero(self.table[(h & np.uint64((1 << self.bits) - 1)).astype(np.int64)])
        k = np.searchsorted(self.keys, h[at])
        ok = self.keys[np.minimum(k, len(self.keys) - 1)] == h[at]
        return at[ok], k[ok]


def corpus_counts(docs: DataFrame, text_col: str, block: Block) -> dict[int, np.ndarray]:
    """How often the corpus has each shingle of the block; all documents count."""
    keys = block.keys

    def run(batches):
        filters = {s: Filter(k) for s, k in keys.items()}
        total = {s: np.zeros(len(k), np.int64) for s, k in keys.items()}
        for b in batches:
            for _, _, buf, offsets in K.slices(K.string_column(b.column(0))):
                t = K.Tokens(buf, offsets, K.ALNUM, lower=True)
                for s, f in filters.items():
                    at = t.windows(s)
                    _, k = f.find(t.spans()(at, at + s))
                    total[s] += np.bincount(k, minlength=len(f.keys))
        for s, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), s)), pa.array(at), pa.array(n[at])], names=["s", "k", "n"])

    rows = docs.select(quoted(text_col)).mapInArrow(run, "s long, k long, n long").groupBy("s", "k").agg(F.sum("n").alias("n"))
    counts = {s: np.zeros(len(k), np.int64) for s, k in keys.items()}
    found = rows.toArrow()  # one row for each shingle of the block at most
    s, k, n = (found.column(c).to_numpy() for c in ("s", "k", "n"))
    for size, own in counts.items():
        own[k[s == size]] = n[s == size]
    return counts


def prefix_index(block: Block, counts: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By shingle size: prefix keys, where each one's windows begin, the windows, the prefix's place in them."""
    index = {}
    for s, keys in block.keys.items():
        w = np.flatnonzero(block.size == s)
        best, place = np.full(len(w), np.iinfo(np.int64).max), np.zeros(len(w), np.int64)
        for j in range(int(block.length[w].max()) - s + 1):
            fits = np.flatnonzero(j + s <= block.length[w])
            n = counts[s][np.searchsorted(keys, block.shingles[block.first[w[fits]] + j])]
            better = fits[n < best[fits]]
            best[better], place[better] = n[n < best[fits]], j
        prefix = block.shingles[block.first[w] + place]
        order = np.argsort(prefix, kind="stable")
        found, begin = np.unique(prefix[order], return_index=True)
        index[s] = (found, np.append(begin, len(w)), w[order], place[order])
    return index


def match(t: K.Tokens, block: Block, index: dict, filters: dict[int, Filter]) -> tuple[np.ndarray, np.ndarray]:
    """(first words, windows) of all occurrences of the block's windows."""
    doc_end = np.repeat(t.first[1:], t.counts)
    doc_begin = np.repeat(t.first[:-1], t.counts)
    all_starts, all_windows = [], []
    for s, (_, begin, windows, place) in index.items():
        at = t.windows(s)
        hit, key = filters[s].find(t.spans()(at, at + s))
        at = at[hit]
        n = begin[key + 1] - begin[key]
        k = K.ranges(begin[key], n)
        w, token = windows[k], np.repeat(at, n)
        start = token - place[k]
        fits = (start >= doc_begin[token]) & (start + block.length[w] <= doc_end[token])
        start, w = start[fits], w[fits]
        same = t.spans()(start, start + block.length[w]) == block.hash[w]
        all_starts.append(start[same])
        all_windows.append(w[same])
    starts, windows = np.concatenate(all_starts), np.concatenate(all_windows)
    if not len(starts):
        return starts, windows
    text, begin, end = t.joined()
    places = zip(begin[starts].tolist(), end[starts + block.length[windows] - 1].tolist(), block.text_from[windows].tolist(), block.text_to[windows].tolist())
    same = np.array([text[a:z] == block.text[c:d] for a, z, c, d in places])
    return starts[same], windows[same]


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


def scan(block: Block | None, index: dict):
    """fn for annotate(): counts, spans and items of each text."""

    def fn(column: pa.Array):
        filters = {s: Filter(x[0]) for s, x in index.items()}
        n_words, n_hit, spans, items = [], [], [], []
        for row, end, buf, offsets in K.slices(column):
            t = K.Tokens(buf, offsets, K.ALNUM, lower=True)
            n_words.append(t.counts)
            rows = end - row
            if block is None:
                starts = windows = np.zeros(0, np.int64)
            else:
                starts, windows = match(t, block, index, filters)
            hit = K.covered(len(t), starts, starts + (block.length[windows] if block else 0))
            n_hit.append(np.diff(np.concatenate([[0], np.cumsum(hit)])[t.first]))
            own_spans, own_items = [[] for _ in range(rows)], [set() for _ in range(rows)]
            doc = np.searchsorted(t.first, starts, "right") - 1
            for d in np.unique(doc):
                own = np.flatnonzero(hit[t.first[d] : t.first[d + 1]])
                cut = np.flatnonzero(np.diff(own) > 1)
                own_spans[d] = [{"a": a, "b": b} for a, b in zip(own[np.append(0, cut + 1)].tolist(), (own[np.append(cut, len(own) - 1)] + 1).tolist())]
            for d, w in zip(*np.unique(np.stack([doc, windows]), axis=1)):
                own_items[d].update(block.ids[i] for i in block.items[block.item_from[w] : block.item_from[w + 1]])
            spans += own_spans
            items += [sorted(x) for x in own_items]
        flat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
        return [pa.array(flat(n_words), pa.int64()), pa.array(flat(n_hit), pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([digest(x) for x in items], pa.string()), pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(items, pa.list_(pa.string()))]

    return fn


def blocks(benchmark: DataFrame, item_id: str, item_text: str, block_bytes: int):
    """The items, block by block; only one block is on the driver at a time."""
    items = benchmark.select(F.coalesce(quoted(item_id).cast("string"), F.lit("null")).alias("i"), F.coalesce(quoted(item_text).cast("string"), F.lit("")).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        yield b, n, [(r.i, r.t) for r in part.collect()]


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", keep: list[str] | None = None, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """(the columns `keep` of docs with a struct column of FIELDS, the name of that column).

    spans has the first word and the word after the last of each hit run; items the item ids.
    """
    keep = docs.columns if keep is None else keep
    out, names = docs, []
    for b, n, rows in blocks(benchmark, item_id, item_text, block_bytes):
        block = build_block(rows, window)
        index = prefix_index(block, corpus_counts(docs, text_col, block)) if block else {}
        held = [*keep, *names] if b == n - 1 else list(dict.fromkeys([*keep, text_col, *names]))
        out, name = annotate(out, text_col, FIELDS, scan(block, index), held, "leak")
        names.append(name)
        if b < n - 1:
            out = materialize(out, f"decontaminate-{b}")
    if len(names) == 1:
        return out, names[0]
    spans = F.array_sort(F.flatten(F.array(*[quoted(x)["spans"] for x in names])))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    total = F.aggregate(spans, zero, lambda acc, p: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), p["b"] - F.greatest(p["a"], acc["end"]))).alias("n"), F.greatest(acc["end"], p["b"]).alias("end")))
    items = F.array_sort(F.array_distinct(F.flatten(F.array(*[quoted(x)["items"] for x in names]))))
    merged = F.struct(quoted(names[0])["n_words"].alias("n_words"), total["n"].alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), spans.alias("spans"), items.alias("items"))
    return out.withColumn(names[-1], merged).select(*[quoted(c) for c in [*keep, names[-1]]]), names[-1]


def contaminated(leak):
    """A document is contaminated if a twentieth of its words or more are hit."""
    return (leak["n_hit"] > 0) & (leak["n_hit"] * 20 >= leak["n_words"])


ORACLE_SQL = r"""
WITH t AS (SELECT true AS item, item_id::VARCHAR AS id, text FROM benchmark UNION ALL SELECT false, doc_id::VARCHAR, text FROM documents),
w AS (SELECT item, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS words FROM t),
v AS (SELECT DISTINCT id, least(len(words), 13) AS n, array_to_string(words[i:i + least(len(words), 13) - 1], ' ') AS key
  FROM (SELECT id, words, unnest(range(1, greatest(1, len(words) - 12) + 1)) AS i FROM w WHERE item AND len(words) > 0)),
d AS (SELECT w.id, n, words, unnest(range(1, len(words) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM v) WHERE NOT item AND len(words) >= n),
hit AS (SELECT d.id, i, d.n, v.id AS item_id FROM d JOIN v ON v.n = d.n AND v.key = array_to_string(words[i:i + d.n - 1], ' ')),
spots AS (SELECT id, count(DISTINCT j) AS n_hit FROM (SELECT id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY id),
items AS (SELECT id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT id, item_id FROM hit) GROUP BY id)
SELECT w.id::BIGINT AS doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM w LEFT JOIN spots ON spots.id = w.id LEFT JOIN items ON items.id = w.id WHERE NOT w.item
"""
