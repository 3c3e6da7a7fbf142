"""Removal of repeated word sequences by difference-cover anchors.

D is a difference cover modulo v: for any two places i and j some shift below v moves both into
places that D marks. So if the same 35 words begin at i and at j, the two runs share an aligned
anchor, and it is enough to hash the 35 - v + 1 words that follow marked places (a quarter of
all). Anchors that occur twice are extended to the windows around them. Runs of such windows that
occur twice as a whole are repeats; where runs are only alike (at the ends of a passage), their
windows are hashed in full with 128 bits, and a window whose hash occurs twice is a repeat.

Hot keys: of equal keys that a task holds at once, one asks for all, so a passage that a third of
all documents share gives as many questions as there are tasks. Texts are
shuffled once; only those with a repeated anchor are written and moved again.

Defined results: null and empty texts have no words, remove nothing and hash as the empty string;
texts below 35 words remove nothing; rows that repeat are repeats of one another.
"""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from strandlake.llm import exchange as X
from strandlake.llm import kernels as K
from strandlake.llm import suffix_dedup as S
from strandlake.llm.common import Work, quoted, row_keys

WINDOW = 35
PERIOD = 21

#: Records that ask how often a key occurs. known 0: asks; 1: a repeat already, bears witness; 2: a repeat already.
ASKED = {"k1": np.uint64, "k2": np.uint64, "d": np.int64, "t": np.int64, "pos": np.int32, "known": np.int8}


@cache
def difference_cover(v: int) -> tuple[int, ...]:
    """The smallest set, first in order, whose differences are all residues modulo v."""

    def grow(cover: list[int], size: int):
        if len({(a - b) % v for a in cover for b in cover}) == v:
            return cover
        if len(cover) == size:
            return None
        return next((got for x in range(cover[-1] + 1, v) if (got := grow([*cover, x], size))), None)

    return tuple(next(got for size in range(1, v + 1) if (got := grow([0], size))))


def ask(records: X.Record, parts: int) -> tuple[X.Record, np.ndarray]:
    """Settle what these records tell of themselves: of equal keys one bears witness, the others only come along."""
    first, count = K.first_of_each(records["k1"], records["k2"])
    known = np.where(count > 1, np.where(first, 1, 2), 0).astype(np.int8)
    loose = X.text_bucket(records["d"], records["t"] ^ records["pos"], parts)
    return records | {"known": known}, np.where(known == 2, loose, (records["k1"] % np.uint64(parts)).astype(np.int64))


def repeated(blocks: DataFrame, parts: int) -> DataFrame:
    """(_d, _t, _places) of the records whose key occurs twice or more."""

    def run(batches):
        r = X.unpacked(batches, ASKED)
        witness = r["known"] < 2
        again = ~witness | (r["known"] == 1)
        at = np.flatnonzero(witness)
        again[at] |= K.first_of_each(r["k1"][at], r["k2"][at])[1] > 1
        if again.any():
            n = int(again.sum())
            out = {"d": r["d"][again], "t": r["t"][again], "pos": r["pos"][again], "n": np.ones(n, np.int32), "kind": np.zeros(n, np.int8)}
            yield X.pack(out, X.by_text(out, parts))

    return X.gather_places(X.dealt(blocks, parts).mapInArrow(run, X.BLOCKS), parts)


def asking(h1, h2, d, t, pos) -> X.Record:
    return {"k1": h1, "k2": h2, "d": d, "t": t, "pos": pos.astype(np.int32), "known": np.zeros(len(h1), np.int8)}


def anchor_blocks(window: int, v: int, parts: int):
    """mapInArrow over (_d, _t, _text): the anchors."""
    marked = np.zeros(v, bool)
    marked[list(difference_cover(v))] = True
    length = window - v + 1

    def anchors(batches):
        for b in batches:
            d, t = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for row, end, buf, offsets in K.slices(K.string_column(b.column(2))):
                w = K.Tokens(buf, offsets, K.NON_SPACE, lower=False)
                doc = w.doc_of()
                at = w.windows(length)
                own = doc[at]
                at = at[marked[(at - w.first[own]) % v] & (w.counts[own] >= window)]
                own = doc[at]
                h = w.spans()(at, at + length)
                yield asking(h, np.zeros(len(h), np.uint64), d[row:end][own], t[row:end][own], at - w.first[own])

    return lambda batches: X.packed(anchors(batches), lambda r: ask(r, parts))


def run_records(window: int, v: int):
    """Over batches of (_d, _t, _text, _places): runs of windows around repeated anchors. A window's first v places
    decide by their smallest hash of three words where its run begins, so equal windows lie in alike runs."""
    gram = min(3, window - v + 1)

    def run(batches, most=0):
        for b in batches:
            d, t = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            found = b.column(3).to_pylist()
            for row, end, buf, offsets in K.slices(K.string_column(b.column(2))):
                w = K.Tokens(buf, offsets, K.NON_SPACE, lower=False)
                anchors = [X.places(x)[0] for x in found[row:end]]
                lowest = np.repeat(w.first[:-1], [len(x) for x in anchors])
                anchor = np.concatenate(anchors) + lowest
                near = K.covered(len(w), np.maximum(anchor - v + 1, lowest), anchor + 1)
                at = w.windows(window)
                at = at[near[at]]
                if not len(at):
                    continue
                spans, own = w.spans(), w.doc_of()
                grams = np.arange(len(w) - gram + 1)
                where = S.sliding_argmin(spans(grams, grams + gram), v)[at]
                begin = np.flatnonzero(np.append(True, (where[1:] != where[:-1]) | (at[1:] != at[:-1] + 1) | (own[at[1:]] != own[at[:-1]])))
                count = np.diff(np.append(begin, len(at)))
                low, where = at[begin], where[begin]
                k2, k3 = spans(where, where + window - v + 1), w.spans(1)(low, low + count - 1 + window)
                first = w.hashes()[where]
                second = w.hashes()[where + 1] if window > v else first  # the next word lies in the run if v places do not reach its end
                made = (own[low], low - w.first[own[low]], count, K.signed(first), K.signed(second), K.signed(k2), K.signed(k3))
                yield S.suffixes(*(x[:: S.thin(len(low), end - row, most)] for x in made), d[row:end], t[row:end])

    return run


def window_blocks(window: int, parts: int):
    """mapInArrow over (_d, _t, _text, _places): the windows of open runs."""

    def windows(batches):
        for b in batches:
            d, t = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            found = b.column(3).to_pylist()
            for row, end, buf, offsets in K.slices(K.string_column(b.column(2))):
                w = K.Tokens(buf, offsets, K.NON_SPACE, lower=False)
                own, at = S.opened(found[row:end], w.first)
                yield asking(w.spans(0)(at, at + window), w.spans(1)(at, at + window), d[row:end][own], t[row:end][own], at - w.first[own])

    return lambda batches: X.packed(windows(batches), lambda r: ask(r, parts))


def split(names: list[str], n_keep: int):
    """Settle texts without anchors; pass on the others."""

    def run(batches):
        for b in batches:
            text, anchors = K.string_column(b.column(n_keep)), b.column(n_keep + 1)
            has = anchors.is_valid().to_numpy(zero_copy_only=False)
            n_words, sha = [], []
            for i, busy in enumerate(has):
                words = b"" if busy else text[i].as_buffer().to_pybytes().split()
                n_words.append(None if busy else len(words))
                sha.append(None if busy else hashlib.sha256(b" ".join(words)).hexdigest())
            kept_text = pa.compute.if_else(pa.array(has), text, pa.scalar(None, text.type))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n_keep)), kept_text, anchors, pa.array(n_words, pa.int64()), pa.array(sha, pa.string())], names=names)

    return run


def cut(n_keep: int, window: int, schema, with_text: bool):
    def run(batches):
        for b in batches:
            text = K.string_column(b.column(n_keep))
            runs, more, n_words, sha = (b.column(n_keep + i).to_pylist() for i in (1, 2, 3, 4))
            n_removed, texts = [0] * len(text), [None] * len(text)
            for row, end, buf, offsets in K.slices(text):
                w = K.Tokens(buf, offsets, K.NON_SPACE, lower=False)
                own, begin, n = S.gone(runs[row:end], more[row:end])
                begin += w.first[own]
                gone = K.covered(len(w), begin, begin + n - 1 + window)
                data = buf.tobytes()
                for i in range(row, end):
                    a, z = w.first[i - row], w.first[i - row + 1]
                    if sha[i] is None:
                        left = np.flatnonzero(~gone[a:z]) + a
                        kept = b" ".join(data[s:e] for s, e in zip(w.starts[left].tolist(), w.ends[left].tolist()))
                        n_words[i], n_removed[i], sha[i] = int(z - a), int(z - a) - len(left), hashlib.sha256(kept).hexdigest()
                        texts[i] = kept.decode() if with_text and n_removed[i] else None
            made = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(n_keep)), *made], names=schema.names)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, window: int = WINDOW, v: int = PERIOD, with_text: bool = True) -> DataFrame:
    """For each row: the columns `keep` (by default the id), n_words, n_removed, kept_sha256 and kept_text.

    kept_text has the remaining words joined by one space where words were removed, else null.
    """
    if not 1 <= v <= window:
        raise ValueError("the period must lie between 1 and the window")
    keep = [id_col] if keep is None else keep
    names = [f"_c{i}" for i in range(len(keep))]
    base = docs.select(*[quoted(c).alias(n) for c, n in zip(keep, names)], *row_keys(id_col, text_col), F.coalesce(quoted(text_col), F.lit("")).alias("_text"))
    texts = base.select("_d", "_t", "_text")
    _, parts = X.bucket_count(docs, text_col)
    anchors = repeated(texts.mapInArrow(anchor_blocks(window, v, parts), X.BLOCKS), parts)
    joined = base.join(anchors, ["_d", "_t"], "left")
    held = ["_d", "_t", *names]
    step = StructType([base.schema[c] for c in held] + [StructField("_text", StringType()), StructField("_places", BinaryType()), StructField("n_words", LongType()), StructField("sha", StringType())])
    work = Work(docs.sparkSession, "substrings")
    settled = work.save(joined.select(*held, "_text", "_places").mapInArrow(split(step.names, len(held)), step), "texts")
    near = settled.where("_text is not null")
    runs = S.suffix_sort(near.select("_d", "_t", "_text", "_places"), run_records(window, v), near.count(), parts, work, "runs")
    runs = work.save(runs, "places")
    work.drop("runs")
    opened = near.drop("_places").join(runs, ["_d", "_t"]).select("_d", "_t", "_text", "_places")
    windows = repeated(opened.mapInArrow(window_blocks(window, parts), X.BLOCKS), parts).withColumnRenamed("_places", "_w")
    out = StructType([StructField(c, base.schema[n].dataType) for c, n in zip(names, names)] + [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType()), StructField("kept_text", StringType())])
    last = settled.drop("_places").join(runs, ["_d", "_t"], "left").join(windows, ["_d", "_t"], "left").select(*names, "_text", "_places", "_w", "n_words", "sha")
    done = last.mapInArrow(cut(len(names), window, to_arrow_schema(out), with_text), out)
    return done.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "n_words", "n_removed", "kept_sha256", "kept_text")


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35),
h AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS h FROM p),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM g WHERE n > 1),
each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS j FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS text FROM each ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
