"""The registered queries over whole tables against brute force."""

from __future__ import annotations

import hashlib
import html
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import html_extract, license_scan, queries
from tests.conftest import SF
from tests.llm.test_corpus_operators import benchmark_windows, plain_components
from tests.llm.test_text_operators import lower, shingles, words

D = str(SF.parent / "sf0.01")


@pytest.fixture(scope="module")
def table(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()}


def found(spark, name):
    rows = queries.queries()[name](spark, D).collect()
    out = {r.doc_id: r for r in rows}
    assert len(out) == len(rows)
    return out


def test_op5(spark, table):
    sets = {i: shingles(t, 3) for i, t in table.items()}
    least = plain_components(sets, 90)
    got = found(spark, "op5_jaccard_join")
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(x), least.get(i, i)) for i, x in sets.items()}
    assert len(set(least.values())) < len(least)


def test_op7(spark, table):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    windows = benchmark_windows(t for _, t in items)
    own = {}
    for i, t in items:
        for held in benchmark_windows([t]).values():
            for x in held:
                own.setdefault(x, set()).add(str(i))
    want = {}
    for i, t in table.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        hit, ids = set(), set()
        for n, held in windows.items():
            for a in range(len(w) - n + 1):
                if (x := tuple(w[a : a + n])) in held:
                    hit.update(range(a, a + n))
                    ids |= own[x]
        want[i] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    got = found(spark, "op7_decontaminate")
    assert {i: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for i, r in got.items()} == want
    assert any(w[-1] for w in want.values())


def test_op8(spark, table):
    texts = {i: (t or "").encode() for i, t in table.items()}
    digests = {i: [hashlib.blake2b(t[a : a + 400], digest_size=16).digest() for a in range(len(t) - 399)] for i, t in texts.items()}
    count = Counter(x for own in digests.values() for x in own)
    want = {}
    for i, t in texts.items():
        gone = np.zeros(len(t) + 1, np.int64)
        for a, x in enumerate(digests[i]):
            if count[x] > 1:
                gone[a] += 1
                gone[a + 400] -= 1
        out = np.cumsum(gone)[:-1] > 0
        kept = np.frombuffer(t, np.uint8)[~out].tobytes()
        want[i] = (len(t), int(out.sum()), int(out[:1].sum() + (out[1:] & ~out[:-1]).sum()), hashlib.sha256(kept).hexdigest())
    got = found(spark, "op8_suffix_dedup")
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == want
    assert sum(w[1] > 0 for w in want.values()) > 100


def test_op10(spark, table):
    texts = {i: words(t) for i, t in table.items()}
    count = Counter(tuple(w[a : a + 35]) for w in texts.values() for a in range(len(w) - 34))
    want = {}
    for i, w in texts.items():
        gone = {p for a in range(len(w) - 34) if count[tuple(w[a : a + 35])] > 1 for p in range(a, a + 35)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        want[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    got = found(spark, "op10_substring_dedup")
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == want
    assert sum(w[1] > 0 for w in want.values()) > 100


def test_op1(spark, table):
    rows = queries.op1_sharding(spark, D).collect()
    n_chars = {r.doc_id: r.n_chars for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    assert Counter((r.doc_id, r.n_chars) for r in rows) == Counter(n_chars.items())
    shards = {(r.shard, r.tier, r.shard_bytes) for r in rows}
    assert len({s for s, _, _ in shards}) == len(shards) > 1 and len({r.version for r in rows}) == 1
    tiers = Counter(t for _, t, _ in shards)
    assert all(n < 4 for t, n in tiers.items() if t)


def test_op2(spark, table):
    """Every document has a score; the held-out part follows the contract."""
    import zlib

    got = found(spark, "op2_toxicity")
    assert set(got) == set(table)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)


def plain_article(page):
    """The blocks of a page whose article holds only headings, paragraphs, bold text and line breaks."""
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", body)
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", b))).split()) for b in blocks]
    return "\n\n".join(t for t in texts if t)


def test_op4(spark):
    pages = spark.read.parquet(f"{D}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.op4_html_extract(spark, D).collect()}
    assert len(got) == len(pages)
    for p in pages:
        want = plain_article(p.html)
        assert (got[p.page_id].url, got[p.page_id].text, got[p.page_id].n_chars) == (p.url, want, len(want))


def page_of(r: random.Random, wrap: str):
    """(page, its article) of a made page with all kinds of surroundings."""
    prose = lambda n: " ".join(r.choice("alpha beta gamma delta omega river mountain Straße été 12 x<y & so".split()) for _ in range(n))
    links = lambda n: "".join(f"<li><a href='/{i}'>{prose(2)[:20]}</a></li>".replace("<y", "") for i in range(n))
    texts = [prose(6), *[prose(r.randint(25, 90)) for _ in range(r.randint(4, 12))]]
    around = [
        f"<nav><ul>{links(8)}</ul></nav>", f"<header class='site-header'><a href='/'>{'Home page'}</a></header>", f"<div class='sidebar'><p>{html.escape(prose(30))}</p></div>",
        "<div id='cookie-banner'>We use cookies. <button>Accept</button></div>", f"<div class=ad>{html.escape(prose(20))}</div>", "<form><label>Mail</label><input><button>Send</button></form>",
        f"<section class='comments'><h2>Comments</h2><article><p>{html.escape(prose(40))}</p></article></section>", "<script>var a = '<p>' + \"</article>\";</script>", "<style>p > a { color: red }</style>", f"<footer>&copy; {html.escape(prose(12))}</footer>", "<!-- a comment <p>not text</p> -->",
    ]
    marked = [html.escape(t) for t in texts]
    marked[2] = marked[2].replace(" ", " <b>bold</b> ", 1)
    texts[2] = texts[2].replace(" ", " bold ", 1)
    inner = f"<h1>{marked[0]}</h1>" + "".join(f"<p>{x}</p>" if r.random() < 0.8 else f"<p>{x}" for x in marked[1:])
    before, after = r.sample(around[:6] + around[7:9], r.randint(1, 5)), r.sample(around[2:], r.randint(1, 6))
    inside = r.choice(["", around[4], around[7], around[10]]) if wrap else ""
    body = f"{wrap and f'<{wrap}>'}{inner}{inside}{wrap and f'</{wrap.split()[0]}>'}"
    return f"<!DOCTYPE html><html><head><title>{marked[0]}</title></head><body class='single has-sidebar'>{''.join(before)}{body}{''.join(after)}</body></html>", "\n\n".join(" ".join(t.split()) for t in texts)


@pytest.mark.parametrize("wrap", ["article", "main class=with-sidebar", ""])
def test_made_pages(wrap):
    """Pages that mark their article, and pages that do not: all of the article and nothing else."""
    r = random.Random(11)
    for _ in range(150):
        page, want = page_of(r, wrap)
        assert html_extract.extract(page) == want, page


def test_licences_are_inherited_as_by_a_plain_walk(spark):
    """Directories at random, one of them with most of the files."""
    r = random.Random(21)
    mit, apache = license_scan.TEMPLATES["MIT"][2], "Licensed under the Apache License, Version 2.0."
    folders = ["", "a", "a/b", "a/b/c", "a/d", "e", "e/f", "e/f/g", "h", "hot", "hot/x"]
    rows = []
    for i in range(400):
        folder = "hot" if r.random() < 0.5 else r.choice(folders)
        text = r.choice([mit, apache]) if i % 25 == 0 else r.choice(["nothing of this kind", "", None, "plain words here"])
        rows.append((f"{folder}/{i}" if folder else str(i), text))
    docs = spark.createDataFrame(rows, "path string, text string")
    got = {x.path: (x.license, x.basis, x.license_dir) for x in license_scan.scan(docs, F.col("path")).collect()}
    own = {p: "MIT" if t == mit else "Apache-2.0" if t == apache else None for p, t in rows}
    by_folder = {}
    score = {x.path: x.score for x in license_scan.scan(docs, F.col("path")).collect()}
    for p, name in own.items():
        if name:
            folder = p.rpartition("/")[0]
            by_folder[folder] = min(by_folder.get(folder, (0, "~")), (-score[p], name))
    for p, name in own.items():
        want = (name, "own", None) if name else (None, None, None)
        folder = p.rpartition("/")[0]
        while not name:
            if folder in by_folder:
                want = (by_folder[folder][1], "inherited", folder)
                break
            if not folder:
                break
            folder = folder.rpartition("/")[0]
        assert got[p] == want, p


def test_clashing_columns_and_empty_tables(spark):
    """Columns whose names operators use, and tables without rows, for those that keep columns."""
    docs = spark.createDataFrame([(1, "words of a text", "s", 1, 2, 3, 4, "p")], "doc_id long, text string, source string, score int, toxicity int, extracted int, row int, path string")
    from strandlake.llm import mixing, quality_rules, toxicity

    model = toxicity.Model({}, [0.0] * 3, [1.0] * 3, [0.0] * 4)
    for t in (docs, docs.limit(0)):
        n = t.count()
        found, s = toxicity.toxicity(t, model)
        assert set(t.columns) < set(found.columns) and s not in t.columns and found.count() == n
        found, s = html_extract.extract_text(t, "text")
        assert set(t.columns) < set(found.columns) and s not in t.columns and found.count() == n
        for f in (license_scan.scan(t, F.col("path")), quality_rules.ledger(t), mixing.mix(t)):
            assert f.count() == n and f.select("row.*").columns == t.columns
