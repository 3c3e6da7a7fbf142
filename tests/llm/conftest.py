from __future__ import annotations

import random

import pytest

#: Texts with all that the operators must stand: nulls, empty texts, repeats, ties, long and odd ones.
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon Ünï日本 a1 b-2 C##".split()


def prose(r: random.Random, n: int) -> str:
    return "".join(w + r.choice([" ", " ", " ", "\n", "  ", "\t"]) for w in r.choices(WORDS, k=n)).strip()


@pytest.fixture(scope="session")
def texts():
    r = random.Random(5)
    base = [prose(r, n) for n in (5, 13, 35, 36, 60, 200, 900)]
    passage = prose(r, 80)
    rows = [None, "", "   \n", "one", "one two", *base, base[4], base[4], passage, prose(r, 20) + " " + passage + " " + prose(r, 30), passage + " " + prose(r, 9)]
    rows += [" ".join(["again"] * 50), prose(r, 10) * 5, "x" * 900, "y" + "x" * 500]
    for i in range(12):  # near copies of one text
        words = base[5].split()
        for _ in range(i):
            words[r.randrange(len(words))] = f"w{r.randrange(5)}"
        rows.append(" ".join(words))
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts under ids; the last rows repeat a row, have no id, or no source. Extra columns clash with names in use."""
    rows = [(i, t, "en", f"s{i % 4}", 0.5, 7) for i, t in enumerate(texts)]
    rows += [rows[5], (None, texts[9], None, None, None, None), (None, None, None, None, None, None), (1000, texts[9], "en", None, 1.0, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, _d int").repartition(3).cache()


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]
