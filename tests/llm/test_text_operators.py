"""Operators on texts against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from math import comb

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandlake.llm import decontaminate, jaccard_join, kernels, substring_dedup, suffix_dedup
from strandlake.llm.common import Work
from strandlake.llm.components import components

key = lambda r: tuple((x is None, str(x)) for x in r)
lower = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")
words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@given(st.lists(st.text("aA é\n\x00日", max_size=12), max_size=6))
@settings(max_examples=100, deadline=None)
def test_tokens(texts):
    column = pa.array(texts, pa.string())
    for _, _, buf, offsets in kernels.slices(column, 10):
        pass
    t = kernels.Tokens(*kernels.flat(column), kernels.NON_SPACE, lower=True)
    got = [[t.word(i).decode() for i in range(a, b)] for a, b in zip(t.first, t.first[1:])]
    assert got == [words(lower(x)) for x in texts]


def test_difference_cover():
    for v in (3, 7, 13, 21):
        d = substring_dedup.difference_cover(v)
        assert {(a - b) % v for a in d for b in d} == set(range(v))


@pytest.mark.parametrize("window, v", [(35, 21), (35, 13), (5, 3)])
def test_substring_removal(docs, rows, window, v):
    found = substring_dedup.remove_repeats(docs, window=window, v=v).collect()
    texts = [(i, words(t)) for i, t in rows]
    count = Counter(tuple(w[a : a + window]) for _, w in texts for a in range(len(w) - window + 1))
    want = []
    for i, w in texts:
        gone = {p for a in range(len(w) - window + 1) if count[tuple(w[a : a + window])] > 1 for p in range(a, a + window)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept if gone else None))
    same(found, want)


@pytest.mark.parametrize("length, spread", [(400, 192), (40, 16), (40, 1)])
def test_suffix_removal(docs, rows, length, spread):
    found = suffix_dedup.remove_repeats(docs, length=length, spread=spread, gram=8).collect()
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(t[a : a + length] for _, t in texts for a in range(len(t) - length + 1))
    want = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for a in range(len(t) - length + 1):
            if count[t[a : a + length]] > 1:
                gone[a : a + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        want.append((i, len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept if gone.any() else None))
    same([(*r[:5], None if r[5] is None else bytes(r[5])) for r in found], want)


def test_multikey_quicksort():
    r = np.random.default_rng(1)
    keys = [r.integers(0, n, 20_000) for n in (3, 50, 1000)]
    order = suffix_dedup.multikey_quicksort(keys, small=64)
    rows = list(zip(*(k[order].tolist() for k in keys)))
    assert rows == sorted(zip(*(k.tolist() for k in keys)))


def shingles(text, size):
    w = words(lower(text))
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80), (1, 60)])
def test_near_duplicates(docs, rows, size, percent):
    found = jaccard_join.near_duplicates(docs, size=size, percent=percent).drop("_root").collect()
    sets = [shingles(t, size) for _, t in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    want = [(d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]
    same(found, want)
    kept = jaccard_join.one_of_each(docs, size=size, percent=percent)
    assert kept.columns == docs.columns
    groups = {root(i) for i, s in enumerate(sets) if s}
    assert kept.count() == len(groups) + sum(not s for s in sets)


def test_signatures_never_miss_a_link():
    r = np.random.default_rng(2)
    pool = r.integers(0, 1 << 63, 4000, dtype=np.uint64)
    for n in (1, 5, 10, 19, 20, 21, 40, 77, 300):
        for _ in range(15):
            a = r.choice(pool, n, replace=False)
            changes = int(r.integers(0, max(1, n // 18) + 1))
            b = np.concatenate([a[changes:], r.choice(pool, int(r.integers(0, changes + 1)), replace=False)])
            b = np.unique(b)
            both = len(np.intersect1d(a, b))
            if not len(b) or 100 * both < 90 * (n + len(b) - both):
                continue
            doc = np.repeat([0, 1], [n, len(b)])
            h, sizes = np.concatenate([a, b]), np.array([n, len(b)])
            i, s = jaccard_join.signatures(doc, h, sizes, 90)
            assert set(a.tolist()) == set(b.tolist()) or set(s[i == 0].tolist()) & set(s[i == 1].tolist())
            sk = jaccard_join.sketches(doc, h, sizes)
            assert jaccard_join.may_link(sk[0], sk[1], n, len(b), 90)


def test_large_sets_enumerate_subsets():
    """Sets that may differ in many shingles sign subsets of second-level partitions, about 1.5 for each difference."""
    for k in (40, 100, 1000):
        n1, n2, k2, sure = jaccard_join.levels(k)
        assert n2 > 1 and k2 > 0 and sure >= 2 and n1 * comb(n2, k2) <= 1.5 * k + 8


def test_sketches_bound_the_difference():
    r = np.random.default_rng(3)
    for n, m in ((5, 5), (60, 70), (300, 900), (40_000, 35_000)):
        a = r.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate([a[: n // 2], r.integers(0, 1 << 63, m, dtype=np.uint64)])
        doc = np.repeat([0, 1], [len(a), len(b)])
        drawn = jaccard_join.folded(jaccard_join.sketches(doc, np.concatenate([a, b]), np.array([len(a), len(b)])))
        assert np.bitwise_count(drawn[0] ^ drawn[1]).sum() <= n - n // 2 + m


def thue_morse(n, a, b):
    """A sequence and its complement, which polynomials modulo a power of two cannot tell apart."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return [a if x else b for x in bits], [b if x else a for x in bits]


@pytest.mark.parametrize("n", [64, 1024])
def test_regular_sequences_do_not_collide(spark, n):
    """Long words and long texts of two symbols: each is another text for every operator."""
    x, y = ("".join(t) for t in thue_morse(n, "a", "b"))
    filler = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"{x} same words {filler}"), (2, f"{y} same words")], "doc_id long, text string")
    one = spark.createDataFrame([(1, " ".join([x, "u", "v"])), (2, " ".join([y, "u", "v"]))], "doc_id long, text string")
    assert {r.component_id for r in jaccard_join.near_duplicates(one).collect()} == {1, 2}
    found = substring_dedup.remove_repeats(docs, window=3, v=2).collect()
    assert [r.n_removed for r in found] == [0, 0]
    bench = spark.createDataFrame([("q", f"{x} same words")], "item_id string, text string")
    found, leak = decontaminate.decontaminate(docs, bench, keep=["doc_id"], window=3)
    assert {r.doc_id: r[leak].n_hit for r in found.collect()} == {1: 3, 2: 0}
    docs = spark.createDataFrame([(1, x), (2, y)], "doc_id long, text string")
    assert [r.n_removed for r in suffix_dedup.remove_repeats(docs, length=n, spread=n // 2, gram=8, with_bytes=False).collect()] == [0, 0]
    left, right = (" ".join(t) for t in thue_morse(n, "alpha", "beta"))
    docs = spark.createDataFrame([(1, left), (2, right)], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.remove_repeats(docs, window=n, v=n // 2 if n < 100 else 7).collect()] == [0, 0]


def test_components_by_tables(spark):
    """The way of large link tables against the way of small ones, for longs and binaries."""
    r = np.random.default_rng(6)
    rows = [(int(a), int(b)) for a, b in r.integers(0, 400, (330, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, None), (9, 9)]
    for kind in ("long", "binary"):
        links = spark.createDataFrame(rows, "a long, b long").select(F.col("a").cast("string").cast(kind).alias("a"), F.col("b").cast("string").cast(kind).alias("b"))
        by = [sorted((x.node, x.root) for x in components(links, Work(spark, "test"), f"c{n}", local_links=n).collect()) for n in (0, 1 << 20)]
        assert by[0] == by[1] and len(by[0]) > 300


@pytest.mark.parametrize("block", [4, 16])
def test_groups_of_several_blocks(spark, monkeypatch, block):
    """Groups of more classes than a block, and signatures that several buckets hold, lose no link."""
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    r = np.random.default_rng(8)
    rows = []
    for g in range(3):
        base = [f"w{g}x{i}" for i in range(150)]
        for i in range(70):
            w = list(base)
            for p in r.choice(150, int(r.integers(0, 4)), replace=False):
                w[p] = f"x{r.integers(0, 9)}"
            rows.append((100 * g + i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: shingles(t, 3) for i, t in rows}
    group = {i: i for i in sets}
    for i in sets:
        for j in [j for j in sets if j < i]:
            if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                low, high = sorted((group[i], group[j]))
                group = {k: low if x == high else x for k, x in group.items()}
    assert {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs).collect()} == group


def test_signatures_that_several_buckets_hold(spark, monkeypatch):
    """With more buckets than signatures, splitters cut frequent signatures by classes; links across the cuts are found."""
    cuts = []
    real = jaccard_join.splitters_of
    monkeypatch.setattr(jaccard_join, "splitters_of", lambda *a: cuts.append(real(*a)) or cuts[-1])
    r = np.random.default_rng(14)
    base, rows = [f"w{i}" for i in range(90)], []
    for i in range(120):
        w = list(base)
        for p in r.choice(90, int(r.integers(0, 4)), replace=False):
            w[p] = f"x{r.integers(0, 40)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    sets = {i: shingles(t, 3) for i, t in rows}
    group = {i: i for i in sets}
    for i in sets:
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                low, high = sorted((group[i], group[j]))
                group = {k: low if x == high else x for k, x in group.items()}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(cuts[0][1]) > 0 and got == group


def test_ids_of_any_type(spark):
    """Ids that are no numbers, for all operators that keep rows apart."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [("x-1", text), ("x-2", text), (None, text), ("é", "other words"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert sorted(r.doc_id or "" for r in jaccard_join.one_of_each(docs).collect()) == ["", "x-1", "é"]
    assert sorted(r.n_removed for r in substring_dedup.remove_repeats(docs).collect()) == [0, 0, 60, 60, 60]
    assert sorted(r.n_spans for r in suffix_dedup.remove_repeats(docs, length=100, spread=40).collect()) == [0, 0, 1, 1, 1]
    assert {r.component_id for r in jaccard_join.near_duplicates(docs).collect()} == {"x-1", "é", None}


def test_long_texts(spark):
    """Texts of several MB, longer than what is worked on at once."""
    r = np.random.default_rng(9)
    words_of = lambda n: " ".join(f"w{x}" for x in r.integers(0, 1 << 30, n))
    passage, long = words_of(60), words_of(300_000)
    docs = spark.createDataFrame([(1, long), (2, f"{long} end"), (3, f"{words_of(250_000)} {passage}"), (4, f"{passage} {words_of(30)}")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs, with_text=False).collect()} == {1: 300_000, 2: 300_000, 3: 60, 4: 60}
    gone = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(docs, with_bytes=False).collect()}
    assert gone[1] == gone[2] == len(long) and gone[3] == gone[4] >= len(passage)


def test_large_groups_are_linked(spark):
    """Far copies of one text: no star holds them all, so the remainder must find the links."""
    r = np.random.default_rng(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for p in r.choice(120, int(r.integers(0, 7)), replace=False):
            w[p] = f"x{r.integers(0, 3)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: shingles(t, 3) for i, t in rows}
    group = dict.fromkeys(sets)
    for i in sets:
        group[i] = i
    for i in sets:
        for j in range(i):
            a, b = sets[i], sets[j]
            if 100 * len(a & b) >= 90 * len(a | b):
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    got = {r.doc_id: r.component_id for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == group


@pytest.mark.parametrize("block_bytes", [8 << 20, 200])
def test_decontamination(spark, docs, rows, texts, block_bytes):
    item_words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    items = [("q1", texts[10][:200]), ("q2", "alpha BETA"), ("q3", None), ("q4", "日本"), (None, texts[13][50:300]), ("q5", "again again again"), ("q1", "zeta eta")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    found, leak = decontaminate.decontaminate(docs, bench, keep=["doc_id"], block_bytes=block_bytes)
    windows = {}
    for i, t in items:
        w = item_words(t)
        for a in range(max(1, len(w) - 12)):
            if w:
                windows.setdefault(tuple(w[a : a + 13]), set()).add(i or "null")
    want = []
    for i, t in rows:
        w, hit, ids = item_words(t), set(), set()
        for x, own in windows.items():
            for a in range(len(w) - len(x) + 1):
                if tuple(w[a : a + len(x)]) == x:
                    hit |= set(range(a, a + len(x)))
                    ids |= own
        want.append((i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()))
    same(found.select("doc_id", f"{leak}.n_words", f"{leak}.n_hit", f"{leak}.n_items", f"{leak}.items_sha256").collect(), want)


def test_texts_without_an_id_are_told_apart(spark):
    """Texts whose 32-bit hashes agree, without ids: none is dropped and none gets what the other has removed."""
    text = F.concat_ws(" ", *[F.concat(F.lit(x), F.col("id")) for x in "abcdef"])
    hashed = spark.range(400_000).select(text.alias("text")).withColumn("h", F.hash("text", F.lit(None).cast("long")))
    alike = hashed.groupBy("h").agg(F.sort_array(F.collect_list("text")).alias("x")).where("size(x) > 1").orderBy("h").limit(2).collect()
    assert alike
    pairs = [t for r in alike for t in r.x[:2]]
    docs = spark.createDataFrame([(None, t) for t in pairs], "doc_id long, text string")
    assert sorted(r.text for r in jaccard_join.one_of_each(docs, size=3).collect()) == sorted(pairs)
    a, b = alike[0].x[:2]
    docs = spark.createDataFrame([(None, a), (None, b), (1, f"{a} g")], "doc_id long, text string")
    for found, kept in ((substring_dedup.remove_repeats(docs, window=5, v=3), ["", b, "g"]), (suffix_dedup.remove_repeats(docs, length=20, spread=1, gram=8), ["", b, " g"])):
        want = Counter(hashlib.sha256(t.encode()).hexdigest() for t in kept)
        assert Counter(r[-2] for r in found.collect()) == want


def test_empty_tables(docs, spark):
    none = docs.limit(0)
    assert substring_dedup.remove_repeats(none).count() == suffix_dedup.remove_repeats(none).count() == jaccard_join.near_duplicates(none).count() == jaccard_join.one_of_each(none).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(none, bench)[0].count() == 0
    found, leak = decontaminate.decontaminate(docs, bench)
    assert found.where(f"{leak}.n_hit > 0").count() == 0 and found.count() == docs.count()
    assert set(docs.columns) < set(found.columns)
