"""Near-duplicate classes by a Jaccard self-join with PartEnum signatures.

Sets fall into size bands [l, r] with r = l / 0.9, so that similar sets lie in the same or in
neighbouring bands. In a band, sets of Jaccard similarity 0.9 differ in at most
k = 2r (1 - 0.9) / (1 + 0.9) shingles. The domain of shingles is cut into n1 first-level and in
each n2 second-level partitions, so that some first-level partition holds at most k2 of the
differences; then all second-level partitions but k2 are equal there, and enumerating the
subsets of n2 - k2 of them finds one on which both sets agree. The hash of a set's part in such a
subset is a signature. A set has signatures for its own band and for the next; see levels().

Equal sets are one class, told apart by 128 bits; only classes are compared. A class has a sketch:
for each of m cells of the domain one bit, whether the number of the set's shingles there is odd.
Sets that differ in d shingles have sketches that differ in d bits at most, so a pair whose
sketches differ in more cannot link, and only pairs that pass are verified on their texts.

The classes under a signature form a group. Its passing pairs are not all verified: a spanning
forest of the closest ones is. If all pairs of the forest link, the group is settled, as any other
passing pair is connected already. Large groups are compared in blocks that share their first
class. What forests leave open - groups with a pair that passed, does not link and is not linked by
others, and groups of several blocks - is compared by finer sketches across the components that the
links make; in groups of several blocks (see `blocks_of`) first the closest pair of each two
components, and then, if one of those does not link, all. No pairs are capped or sampled.

Parts of a set that are empty agree with each other and say nothing; they are signed only for
sets that have so many of them that all signatures two similar sets share could be empty.

Defined results: null texts and texts without words have an empty set, and link to nothing; a
null id never names a component, unless all ids of the component are null.
"""

from __future__ import annotations

import functools
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from strandlake.llm import exchange as X
from strandlake.llm import kernels as K
from strandlake.llm import suffix_dedup as S
from strandlake.llm.common import Work, annotate, free_name, quoted, row_hash, row_keys
from strandlake.llm.components import components

SIZE = 3
PERCENT = 90
#: Classes that are compared at once.
BLOCK = 256
#: Texts for each bucket (and in all, at least) and signatures of each that the splitters are sampled from.
SAMPLE_PER_BUCKET, SAMPLE_DOCS, SAMPLE_SIGNATURES = 0.5, 1500, 40


def bands(percent: int, up_to: int) -> list[tuple[int, int]]:
    """The size bands (l, r) up to the one that holds up_to, and the next."""
    out, low = [], 1
    while len(out) < 2 or out[-2][1] < up_to:
        out.append((low, low * 100 // percent))
        low = out[-1][1] + 1
    return out


@cache
def levels(k: int) -> tuple[int, int, int, int]:
    """(n1, n2, k2, sure) for at most k differences: first- and second-level partitions, differences in the best
    first-level partition, and how many signatures two such sets share at least.

    Of the ways with at most k + 16 signatures, or half as many again as the k + 1 that plain partitions need, it is
    the one whose signatures cover most of a set: for sets with many differences n2 = 3, k2 = 1 and about 1.5 k
    signatures, each over 4 / 3 of what a plain partition covers. Sets that differ much must share two signatures,
    so that a set with one empty part need not sign it.
    """

    def shared(n1: int, n2: int, k2: int) -> int:
        each, more = divmod(k, n1)  # differences that are spread evenly spoil most signatures
        agree = lambda d: comb(n2 - d, n2 - k2) if d <= k2 else 0
        return (n1 - more) * agree(each) + more * agree(each + 1)

    most = max(k + 16, 3 * (k // 2 + 2))
    ways = [(n1, n2, k2) for k2 in range(min(k, 4) + 1) for n1 in (k // (k2 + 1) + 1, k // (k2 + 1) + 2) for n2 in range(k2 + 1, 9)]
    ways = [w for w in ways if w[0] * comb(w[1], w[2]) <= most and shared(*w) >= (2 if k >= 12 else 1)]
    best = max(ways, key=lambda w: ((w[1] - w[2]) / (w[0] * w[1]), -w[0] * comb(w[1], w[2])))
    return *best, shared(*best)


def shingle_sets(t: K.Tokens, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents, shingles, set sizes): each document's distinct shingles, documents in order."""
    doc, n = t.doc_of(), t.counts
    at = t.windows(size)
    few = np.flatnonzero((n > 0) & (n < size))
    start = np.concatenate([at, t.first[few]])
    h = t.spans()(start, np.concatenate([at + size, t.first[few] + n[few]]))
    own = doc[start]
    key = K.mix(h ^ K.mix(own.astype(np.uint64)))
    order = np.argsort(key)
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    first = np.sort(order[new])
    first = first[np.argsort(own[first], kind="stable")]
    return own[first], h[first], np.bincount(own[first], minlength=len(n))


def class_keys(doc: np.ndarray, h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of two longs for each set, whatever the order of its shingles."""
    out = np.zeros((len(sizes), 2), np.uint64)
    for lane, salt in enumerate((0x9E3779B97F4A7C15, 0x2545F4914F6CDD1D)):
        np.add.at(out[:, lane], doc, K.mix(K.mix(h + np.uint64(salt)) ^ np.uint64(salt >> 7)))
        out[:, lane] = K.mix(out[:, lane] + sizes.astype(np.uint64))
    return out


def signatures(doc: np.ndarray, h: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(sets, signatures)"""
    table = bands(percent, int(sizes.max(initial=1)))
    low = np.array([b[0] for b in table])
    ks = np.array([2 * r * (100 - percent) // (100 + percent) for _, r in table])
    band = np.searchsorted(low, sizes, "right") - 1
    sets, found = [], []
    for step in (0, 1):
        own = band + step
        for b in np.unique(own[sizes > 0]):
            k = int(ks[b])
            if k == 0:  # similar sets of so few shingles are equal
                continue
            n1, n2, k2, sure = levels(k)
            chosen = np.flatnonzero((own == b) & (sizes > 0))
            number = np.full(len(sizes), -1)
            number[chosen] = np.arange(len(chosen))
            mine = number[doc]
            hs, mine = h[mine >= 0], mine[mine >= 0]
            part = ((K.mix(hs ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)) % np.uint64(n1 * n2)).astype(np.int64)
            cell = mine * (n1 * n2) + part
            total = np.zeros(len(chosen) * n1 * n2, np.uint64)
            np.add.at(total, cell, K.mix(hs + np.uint64(0xD6E8FEB86659FD93)))
            filled = np.bincount(cell, minlength=len(total)).reshape(-1, n1, n2)
            total = total.reshape(-1, n1, n2)
            subsets = list(combinations(range(n2), n2 - k2))
            sums = np.stack([total[:, :, list(s)].sum(axis=2, dtype=np.uint64) for s in subsets], axis=2)
            some = np.stack([filled[:, :, list(s)].sum(axis=2) for s in subsets], axis=2) > 0
            some |= (~some).sum(axis=(1, 2), keepdims=True) >= sure
            salt = K.mix(np.arange(n1 * len(subsets), dtype=np.uint64) + np.uint64(int(b) << 32)).reshape(n1, -1)
            i, p, s = np.nonzero(some)
            sets.append(chosen[i])
            found.append(K.mix(sums[i, p, s] ^ salt[p, s]))
    if not sets:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(sets), np.concatenate(found)


#: Cells of a sketch: a power of two, COARSE or FINE times the size of the set or more, between these. Most groups are
#: settled by coarse sketches; those that are left open are compared by fine ones, which few pairs pass that do not link.
FEWEST_CELLS, MOST_CELLS = 64, 1 << 17
COARSE, FINE = 1, 4


def sketches(doc: np.ndarray, h: np.ndarray, sizes: np.ndarray, times: int = COARSE) -> list[bytes]:
    """A bit for each cell: whether the set has an odd number of shingles there."""
    cells = np.clip(2 ** np.ceil(np.log2(np.maximum(times * sizes, 1))), FEWEST_CELLS, MOST_CELLS).astype(np.int64)
    begin = np.cumsum(cells) - cells
    cell = (K.mix(h + np.uint64(0xE7037ED1A0B428DB)) >> np.uint64(40)).astype(np.int64) & (cells[doc] - 1)
    odd = (np.bincount(begin[doc] + cell, minlength=int(cells.sum())) & 1).astype(np.uint8)
    data = np.packbits(odd, bitorder="little").tobytes()
    return [data[b : b + n] for b, n in zip((begin // 8).tolist(), (cells // 8).tolist())]


def folded(drawn: list[bytes]) -> np.ndarray:
    """One row of longs for each sketch, of the width of the smallest; cells that fall together add up."""
    width = min(map(len, drawn)) // 8
    if all(len(x) == 8 * width for x in drawn):
        return np.frombuffer(b"".join(drawn), np.uint64).reshape(-1, width)
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, width), axis=0) for x in drawn])


def passing(drawn: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(bits by which the sketches of each pair differ, whether the pair may link)"""
    off = np.bitwise_count(drawn[i] ^ drawn[j]).sum(axis=1, dtype=np.int64)
    return off, off * (100 + percent) <= (sizes[i] + sizes[j]) * (100 - percent)


def may_link(a: bytes, b: bytes, n_a: int, n_b: int, percent: int) -> bool:
    return bool(passing(folded([a, b]), np.array([n_a, n_b]), np.array([0]), np.array([1]), percent)[1][0])


def close_pairs(drawn: np.ndarray, sizes: np.ndarray, percent: int, split: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, bits) of all pairs i < j that may link; with `split` only those with i below it."""
    n = len(drawn)
    if n <= 48:
        i, j = pairs_of(n)
        off, ok = passing(drawn, sizes, i, j, percent)
        return i[ok], j[ok], off[ok]
    found = []
    for x in range(min(n, split or n) - 1 if not split else split):
        j = np.arange(x + 1, n)
        off, ok = passing(drawn, sizes, np.array([x]), j, percent)
        found.append((np.full(int(ok.sum()), x), j[ok], off[ok]))
    return tuple(np.concatenate(x) for x in zip(*found))


@cache
def pairs_of(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def forest(n: int, i: np.ndarray, j: np.ndarray, off: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the closest pairs."""
    if len(i) < 2:
        return list(zip(i.tolist(), j.tolist()))
    far = 1 << 60
    weight = np.full((n, n), far)
    weight[i, j] = weight[j, i] = off
    outside = np.zeros(n, bool)
    outside[i] = outside[j] = True
    best, source, out = np.full(n, far), np.zeros(n, np.int64), []
    for _ in range(int(outside.sum())):
        v = int(np.argmin(np.where(outside, best, far + 1)))
        if best[v] < far:
            out.append((int(source[v]), v))
        outside[v] = False
        nearer = outside & (weight[v] < best)
        best[nearer], source[nearer] = weight[v][nearer], v
    return out


def binaries(rows: np.ndarray) -> pa.Array:
    """Rows of longs as binary values."""
    rows = np.ascontiguousarray(rows)
    width = 8 * rows.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def keys_of(column: pa.Array) -> np.ndarray:
    """The rows of two longs of a column of class keys."""
    return K.flat(column)[0].view(np.uint64).reshape(-1, 2)


#: What the first pass finds of a text: the size of its set, its class (null if empty), the first half of that
#: as a long, its sketches, and signatures with the class's long if the text is in the sample for splitters.
FOUND = StructType([StructField("n_shingles", LongType()), StructField("k", BinaryType()), StructField("c", LongType()), StructField("sketch", BinaryType()), StructField("fine", BinaryType()), StructField("sample", BinaryType())])


def classify(size: int, percent: int, rate: float):
    """fn for annotate()"""

    def fn(column: pa.Array):
        n, keys, drawn, fine, sample = [np.zeros(0, np.int64)], [np.zeros((0, 2), np.uint64)], [], [], []
        for _, _, buf, offsets in K.slices(column):
            doc, h, sizes = shingle_sets(K.Tokens(buf, offsets, K.NON_SPACE, lower=True), size)
            k = class_keys(doc, h, sizes)
            n.append(sizes)
            keys.append(k)
            drawn += sketches(doc, h, sizes)
            fine += sketches(doc, h, sizes, FINE)
            chosen = np.random.default_rng(int(k[:, 0].sum(dtype=np.uint64))).random(len(sizes)) < rate
            i, s = signatures(doc[chosen[doc]], h[chosen[doc]], np.where(chosen, sizes, 0), percent)
            own = [s[i == x] for x in range(len(sizes))] if chosen.any() else []
            thin = lambda x: x[:: len(x) // SAMPLE_SIGNATURES + 1]
            sample += [np.stack([thin(x), np.full(len(thin(x)), k[d, 0])], 1).tobytes() if chosen[d] else None for d, x in enumerate(own)] or [None] * len(sizes)
        n, keys = np.concatenate(n), np.concatenate(keys)
        empty = pa.array(n == 0)
        blank = lambda x: pa.compute.if_else(empty, pa.scalar(None, x.type), x)
        return [pa.array(n, pa.int64()), blank(binaries(keys)), blank(pa.array(K.signed(keys[:, 0]))), blank(pa.array(drawn, pa.binary())), blank(pa.array(fine, pa.binary())), pa.array(sample, pa.binary())]

    return fn


#: A signature and a class that has it.
SIGNED = {"s": np.int64, "c": np.int64}


def sign(size: int, percent: int):
    """Over batches of texts: their signatures; of equal sets of a slice one signs for all."""

    def run(batches):
        for b in batches:
            for _, _, buf, offsets in K.slices(K.string_column(b.column(0))):
                doc, h, sizes = shingle_sets(K.Tokens(buf, offsets, K.NON_SPACE, lower=True), size)
                keys = class_keys(doc, h, sizes)
                once = K.first_of_each(keys[:, 0], keys[:, 1])[0]
                mine = once[doc]
                i, s = signatures(doc[mine], h[mine], np.where(once, sizes, 0), percent)
                yield {"s": K.signed(s), "c": K.signed(keys[i, 0])}

    return run


def splitters_of(sample: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(parts - 1 splitters (s, c) from rows (s, c), the signatures that several splitters have).

    Buckets part between signatures; only a signature so frequent that several splitters have it is cut, by classes.
    """
    if not len(sample) or parts < 2:
        return np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    sample = sample[np.lexsort(sample.T[::-1])]
    found = sample[(np.arange(1, parts) * len(sample)) // parts]
    s, n = np.unique(found[:, 0], return_counts=True)
    found[~np.isin(found[:, 0], s[n > 1]), 1] = np.iinfo(np.int64).min
    return found, s[n > 1]


#: Groups of classes under a signature, block by block; `open` if the group has several blocks.
GROUPS = "s long, block long, c long, open boolean"


def shared_signatures(texts: DataFrame, sample: np.ndarray, parts: int, size: int, percent: int) -> DataFrame:
    """GROUPS of two classes or more. Of the groups of a bucket that have the same classes one stands for all."""
    splitters, cut = splitters_of(sample, parts)

    def deal(r):
        first, _ = K.first_of_each(r["s"], r["c"])
        r = {c: x[first] for c, x in r.items()}
        return r, S.bucket_of([r["s"], r["c"]], splitters)

    def group(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        own, r = batches[0].column(0)[0].as_py(), X.unpacked(batches, SIGNED)
        order = np.lexsort((r["c"], r["s"]))
        s, c = r["s"][order], r["c"][order]
        fresh = np.append(True, (s[1:] != s[:-1]) | (c[1:] != c[:-1]))
        s, c = s[fresh], c[fresh]
        begin = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        n = np.diff(np.append(begin, len(s)))
        hot = np.isin(s[begin], cut)
        print_of = np.add.reduceat(K.mix(c.view(np.uint64)), begin)
        chosen = np.flatnonzero((n > 1) & ~hot)
        chosen = chosen[K.first_of_each(print_of[chosen], n[chosen])[0]]
        chosen = np.sort(np.concatenate([chosen, np.flatnonzero(hot)]))
        at = K.ranges(begin[chosen], n[chosen])
        group, place = np.repeat(chosen, n[chosen]), at - np.repeat(begin[chosen], n[chosen])
        block, several = place // BLOCK, (n[group] > BLOCK) | hot[group]
        # The first class of a group is in all of its blocks.
        more = chosen[n[chosen] > BLOCK]
        blocks = (n[more] - 1) // BLOCK
        again = np.repeat(begin[more], blocks)
        block = np.concatenate([block, K.ranges(np.ones(len(more), np.int64), blocks)]) + (own << 32) * np.concatenate([hot[group], np.repeat(hot[more], blocks)])
        at, several = np.concatenate([at, again]), np.concatenate([several, np.ones(len(again), bool)])
        yield pa.RecordBatch.from_arrays([pa.array(s[at]), pa.array(block.astype(np.int64)), pa.array(c[at]), pa.array(several)], names=["s", "block", "c", "open"])

    blocks = texts.mapInArrow(lambda batches: X.packed(sign(size, percent)(batches), deal), X.BLOCKS)
    return X.dealt(blocks, parts).mapInArrow(group, GROUPS)


PAIRS = "s long, a binary, b binary"


def pair_batch(s: list, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Pairs of class keys, the smaller (by its first long) first."""
    swap = (a[:, :1] > b[:, :1]) | ((a[:, :1] == b[:, :1]) & (a[:, 1:] > b[:, 1:]))
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    return pa.RecordBatch.from_arrays([pa.array(s, pa.int64()), binaries(a), binaries(b)], names=["s", "a", "b"])


def members_of(column: pa.ListArray):
    """(keys, sizes, sketches, roots or None) of each list of (k, n, sketch[, root])."""
    offsets, flat = column.offsets.to_pylist(), column.values
    keys, sizes, drawn = keys_of(flat.field("k")), flat.field("n").to_numpy(), flat.field("sketch").to_pylist()
    roots = keys_of(flat.field("root")) if flat.type.get_field_index("root") >= 0 else None
    base = flat.offset
    assert base == 0
    for a, z in zip(offsets, offsets[1:]):
        yield keys[a:z], sizes[a:z], drawn[a:z], None if roots is None else roots[a:z]


def forests(percent: int):
    """mapInArrow over (s, x), blocks of groups: the pairs of their forests."""

    def run(batches):
        for batch in batches:
            signature = batch.column(0).to_pylist()
            out, left, right = [], [], []
            for s, (keys, sizes, drawn, _) in zip(signature, members_of(batch.column(1))):
                if len(keys) < 2:
                    continue
                i, j, off = close_pairs(folded(drawn), sizes, percent)
                for a, b in forest(len(keys), i, j, off):
                    out.append(s)
                    left.append(keys[a])
                    right.append(keys[b])
            if out:
                yield pair_batch(out, np.stack(left), np.stack(right))

    return run


def pair_sizes(a: pa.Array, b: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of intersection and union of the texts' sets, row by row."""
    both, union = [], []
    row = 0
    while row < len(a):
        end, total = row, 0
        while end < len(a) and (end == row or total < K.SLICE_BYTES):
            total += a[end].as_buffer().size + b[end].as_buffer().size
            end += 1
        left, right = (shingle_sets(K.Tokens(*K.flat(x.slice(row, end - row)), K.NON_SPACE, lower=True), size) for x in (a, b))
        key = np.concatenate([K.mix(h ^ K.mix(d.astype(np.uint64))) for d, h, _ in (left, right)])
        doc = np.concatenate([left[0], right[0]])
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        common = np.bincount(doc[order[:-1][same]], minlength=end - row)
        both.append(common)
        union.append(left[2] + right[2] - common)
        row = end
    return (np.concatenate(both), np.concatenate(union)) if both else (np.zeros(0, np.int64),) * 2


def verify(size: int, percent: int):
    """mapInArrow over (a, b, texts): whether the pair links."""

    def run(batches):
        for batch in batches:
            both, union = pair_sizes(K.string_column(batch.column(2)), K.string_column(batch.column(3)), size)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(100 * both >= percent * union)], names=["a", "b", "linked"])

    return run


def of_class(size: int):
    """mapInArrow over (k, text): the texts that are of the class."""

    def run(batches):
        for batch in batches:
            ok = [np.zeros(0, bool)]
            text, keys = K.string_column(batch.column(1)), keys_of(batch.column(0))
            for row, end, buf, offsets in K.slices(text):
                ok.append((class_keys(*shingle_sets(K.Tokens(buf, offsets, K.NON_SPACE, lower=True), size)) == keys[row:end]).all(axis=1))
            yield batch.filter(pa.array(np.concatenate(ok)))

    return run


MEMBERS = "array<struct<k:binary,n:bigint,sketch:binary,root:binary>>"
BLOCKS = f"s long, b long, low binary, high binary, x {MEMBERS}"


def blocks_of(labelled: DataFrame, parts: int) -> DataFrame:
    """BLOCKS of open groups, in the order of signature and component: (low, high) are a block's first and last component.

    A group of one block and one component needs no more.
    """

    def run(batches):
        number, held = 0, None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held.num_rows >= 1 << 14:
                s = held.column("s").to_numpy()
                last = int(np.searchsorted(s, s[-1]))  # what may go on stays, but for whole blocks
                last += (len(s) - last) // BLOCK * BLOCK
                yield from cut(held.slice(0, last), number)
                number, held = number + last, held.slice(last)
        if held is not None and held.num_rows:
            yield from cut(held, number)

    def cut(table, number):
        if not table.num_rows:
            return
        table = table.combine_chunks()
        s = table.column("s").to_numpy()
        begin = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        n = np.diff(np.append(begin, len(s)))
        per = -(-n // BLOCK)
        at = np.repeat(begin, per) + K.ranges(np.zeros(len(per), np.int64), per) * BLOCK
        ends = np.minimum(at + BLOCK, np.repeat(begin + n, per))
        batch = table.to_batches()[0]
        flat = pa.StructArray.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in ("k", "n", "sketch", "root")], names=["k", "n", "sketch", "root"])
        x = pa.ListArray.from_arrays(pa.array(np.append(at, ends[-1]).astype(np.int32)), flat)
        root = batch.column(batch.schema.get_field_index("root"))
        yield pa.RecordBatch.from_arrays([pa.array(s[at]), pa.array(number + at), root.take(pa.array(at)), root.take(pa.array(ends - 1)), x], names=["s", "b", "low", "high", "x"])

    dealt = labelled.repartitionByRange(parts, "s", "root", "k").sortWithinPartitions("s", "root", "k")
    found = dealt.select("s", "k", "n", "sketch", "root").mapInArrow(run, BLOCKS)
    return found.withColumn("b", F.spark_partition_id().cast("long") * (1 << 40) + F.col("b"))


def block_pairs(percent: int, closest: bool):
    """mapInArrow over pairs of blocks (s, x, y; y null for a block and itself): the pairs of different components that
    may link, or only the closest of each two components."""

    def run(batches):
        for batch in batches:
            out, left, right = [], [], []
            members = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist())
            for s, x, y in members:
                rows = x + (y or [])
                keys, roots = (np.frombuffer(b"".join(r[c] for r in rows), np.uint64).reshape(-1, 2) for c in ("k", "root"))
                sizes = np.array([r["n"] for r in rows])
                i, j, off = close_pairs(folded([r["sketch"] for r in rows]), sizes, percent, len(x) if y else 0)
                apart = (roots[i] != roots[j]).any(axis=1) & ((i < len(x)) & (j >= len(x)) if y else True)
                i, j, off = i[apart], j[apart], off[apart]
                if closest and len(i):
                    number = np.unique(roots, axis=0, return_inverse=True)[1].reshape(-1)
                    low, high = np.minimum(number[i], number[j]), np.maximum(number[i], number[j])
                    order = np.lexsort((off, high, low))
                    new = np.append(True, (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1]))
                    i, j = i[order][new], j[order][new]
                out += [s] * len(i)
                left.append(keys[i])
                right.append(keys[j])
            if out:
                yield pair_batch(out, np.concatenate(left), np.concatenate(right))

    return run


def across(blocks: DataFrame, percent: int, closest: bool) -> DataFrame:
    """The distinct pairs (a, b) of block_pairs() over all blocks of each group."""
    x = blocks.select("s", "b", "low", "high", "x")
    y = blocks.select("s", *[F.col(c).alias(f"{c}2") for c in ("b", "low", "high")], F.col("x").alias("y"))
    one = (F.col("low") == F.col("high")) & (F.col("low2") == F.col("high2")) & (F.col("low") == F.col("low2"))
    pairs = x.join(y, "s").where((F.col("b") <= F.col("b2")) & ~one)
    rows = pairs.select("s", "x", F.when(F.col("b") < F.col("b2"), F.col("y")).alias("y"))
    return rows.mapInArrow(block_pairs(percent, closest), PAIRS).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """For each row: the columns `keep` (by default the id), n_shingles, component_id and _root, the class that
    stands for its component (null: empty set)."""
    keep = [id_col] if keep is None else keep
    names = [f"_k{i}" for i in range(len(keep))]
    work = Work(docs.sparkSession, "jaccard")
    base = docs.select(*[quoted(c).alias(n) for c, n in zip(keep, names)], quoted(id_col).alias("_id"), quoted(text_col).alias("_text"), row_keys(id_col, text_col)[1])
    rows, parts = X.bucket_count(docs, text_col)
    rate = max(SAMPLE_DOCS, SAMPLE_PER_BUCKET * parts) / max(rows, 1)
    found, s = annotate(base, "_text", FOUND, classify(size, percent, rate), [*names, "_id", "_t"], "_s")
    found = work.save(found.select(*names, "_id", "_t", F.col(f"{s}.*")), "found")
    sample = [np.frombuffer(r.as_py(), np.int64).reshape(-1, 2) for r in found.where("sample is not null").select("sample").toArrow().column(0)]
    sample = np.concatenate([np.zeros((0, 2), np.int64), *sample])
    shared = work.save(shared_signatures(base.select("_text"), sample, parts, size, percent), "shared")
    least = [F.min("_id").alias("m"), F.min("_t").alias("t"), F.min("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("fine").alias("fine")]
    classes = work.save(found.where("k is not null").groupBy("c", "k").agg(*least), "classes")
    drawn = classes.select("c", "k", "n", "sketch")
    member = F.struct("k", "n", "sketch")
    groups = shared.join(drawn, "c").groupBy("s", "block").agg(F.collect_list(member).alias("x")).select("s", "x")
    pairs = work.save(groups.mapInArrow(forests(percent), PAIRS), "forests")
    several = shared.where("open").select("s").distinct()
    large = not several.isEmpty()
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("k"))
    if large:
        wanted = wanted.unionByName(drawn.join(shared.where("open").select("c").distinct(), "c").select("k"))
    holders = classes.join(wanted.distinct(), "k").select(F.col("t").alias("_t"), "k")
    # One plan at every size: the table of holders grows with the corpus, so it is never broadcast.
    texts = base.select("_t", F.col("_text").alias("text")).join(holders.hint("merge"), "_t").select("k", "text")
    texts = work.save(texts.mapInArrow(of_class(size), "k binary, text string").dropDuplicates(["k"]), "texts")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        sides = [texts.select(F.col("k").alias(x), F.col("text").alias(f"t{x}")) for x in ("a", "b")]
        both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "ta", "tb")
        return work.save(both.mapInArrow(verify(size, percent), "a binary, b binary, linked boolean"), name)

    checked = verified(pairs.select("a", "b").distinct(), "checked")
    links = checked.where("linked").select("a", "b")
    roots = components(links, work, "roots")
    # A pair that does not link matters only if no other links connect it.
    root_of = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    failed = checked.where("not linked").join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
    failed = work.save(failed.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"), "failed")
    fine = classes.select("c", "k", "n", F.col("fine").alias("sketch"))
    rooted_as = lambda t: t.join(roots.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    rest = []
    if large:
        labelled = work.save(shared.where("open").select("s", "c").distinct().join(fine, "c").select("s", "k", "n", "sketch"), "open")
        blocks = work.save(blocks_of(rooted_as(labelled), parts), "blocks-0")
        more = verified(across(blocks, percent, True), "more-0")
        links = links.unionByName(more.where("linked").select("a", "b"))
        roots = components(links, work, "roots-0")
        if not more.where("not linked").isEmpty():
            blocks = work.save(blocks_of(rooted_as(labelled), parts), "blocks-1")
            rest.append(across(blocks, percent, False))
    if not failed.isEmpty():
        # A pair of the forest that failed is the closest of its two components, so all are asked for at once. Of a
        # group of one block only classes that pass with another can link, and its forest has all of those.
        again = pairs.join(failed, ["a", "b"]).select("s").distinct().join(several, "s", "left_anti")
        members = pairs.join(again, "s").select("s", F.explode(F.array("a", "b")).alias("k")).distinct()
        held = rooted_as(members.join(fine.drop("c"), "k")).groupBy("s").agg(F.collect_list(F.struct("k", "n", "sketch", "root")).alias("x"))
        rest.append(held.select("s", "x", F.lit(None).cast(MEMBERS).alias("y")).mapInArrow(block_pairs(percent, False), PAIRS).select("a", "b"))
    if rest:
        more = verified(functools.reduce(DataFrame.unionByName, rest).distinct(), "more-1")
        links = links.unionByName(more.where("linked").select("a", "b"))
        roots = components(links, work, "roots-1")
    rooted = classes.select("k", "m").join(roots.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    lowest = work.save(rooted.groupBy("root").agg(F.min("m").alias("component_id")), "lowest")
    named = work.save(rooted.join(lowest, "root").select("k", "component_id", F.col("root").alias("_root")), "named")
    work.drop("shared", "classes", "forests", "texts", "checked", "failed", "open", "lowest", *[f"{x}-{i}" for x in ("blocks", "more") for i in (0, 1)])
    out = found.select(*names, "_id", "n_shingles", "k").join(named, "k", "left").withColumn("component_id", F.coalesce("component_id", "_id"))
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "n_shingles", "component_id", "_root")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the one with the smallest id stays (a null id only
    if there is no other), of rows that agree in id and text one, by a hash of all columns, and every row with an empty set."""
    row, key = free_name(docs, "_row"), ["_d", "_t"]
    columns = F.struct(*[quoted(c) for c in docs.columns])
    keyed = docs.select(columns.alias(row), *row_keys(id_col, text_col), quoted(id_col).alias("_i"), quoted(text_col).alias("_x"), row_hash(docs.schema).alias("_h"))
    found = near_duplicates(keyed.select(*key, "_i", "_x"), "_i", "_x", [*key, "_i"], size, percent)
    order = F.struct(F.isnull("_i").alias("no_id"), F.col("_i"), *key)
    chosen = found.where("_root is not null").groupBy("_root").agg(F.min(order).alias("k")).select("k._d", "k._t", F.lit(False).alias("empty"))
    empty = found.where("_root is null").select(*key, F.lit(True).alias("empty")).distinct()
    chosen = Work(docs.sparkSession, "jaccard").save(chosen.unionByName(empty), "chosen")
    held = keyed.select(row, *key, "_h").join(chosen, key)
    turn = F.row_number().over(Window.partitionBy(*key).orderBy("empty", "_h"))
    return held.withColumn("turn", turn).where("empty or turn = 1").select(f"{row}.*")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(words[i:i + 2], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - 2) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT r.doc_id, links.b FROM r JOIN links ON links.a = r.c)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
"""
