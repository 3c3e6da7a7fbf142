"""Toxicity scores from a weighted lexicon matched by Aho-Corasick.

Texts are folded first: lower case, letters of other scripts that look Latin, and digits or signs
that stand for letters inside words. The lexicon has word beginnings and whole words; each is
weighted by how much more often toxic training texts have it. One pass of an automaton finds all
entries; a word counts with its heaviest entry, and not at all inside an exception phrase. The
weights are summed and normalised by the text's length, and a logistic curve makes a score.

Training reads labels of at most MAX_TRAIN rows, chosen by a hash of the id, never the label,
language, source or id as an input. Everything that is collected is bounded by that number.

Defined results: null and empty texts have no hits and get the lowest score; with no labelled rows
of either kind all scores are the share of toxic ones; rows that repeat score alike; an id without
a label trains nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from strandlake.llm.common import annotate, materialize, quoted
from strandlake.llm.kernels import string_column

MAX_TRAIN = 20_000
THRESHOLD = 0.7
#: Phrases in which entries are harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "class clown", "sore loser")
#: Least and greatest length of a word beginning.
SHORTEST, LONGEST = 3, 9
#: An entry is in this many toxic training texts at least, at any size of the training set.
FEWEST = 4
#: Chernoff's bound on the chance that a feature which says nothing has so many toxic among its texts is this at most.
CHANCE = 1e-5
#: How often a feature counts in one text at most when it is weighted, so that a text that repeats a word says no more.
MOST_PER_TEXT = 4
#: Least logarithm of the ratio of rates, and how much more a longer beginning must have than a shorter.
RATIO, GAIN = 2.0, 1.0

#: Letters of other scripts that look like these Latin ones.
LOOKALIKES = {
    "a": "аαɑａ", "b": "вβｂ", "c": "сϲｃ", "d": "ԁｄ", "e": "еεｅ",
    "g": "ɡｇ", "h": "һｈ", "i": "іιıｉ", "j": "јｊ", "k": "кκｋ",
    "l": "ӏｌ", "m": "мｍ", "n": "ηｎ", "o": "оοｏ", "p": "рρｐ",
    "q": "ԛｑ", "r": "гｒ", "s": "ѕｓ", "t": "тτｔ", "u": "υｕ",
    "v": "νｖ", "w": "ԝωｗ", "x": "хχｘ", "y": "уｙ", "z": "ｚ",
}
#: Digits and signs that stand for letters.
DIGITS = str.maketrans("013457@$8", "oieastasb")

_FOLD = {ord(x): k for k, xs in LOOKALIKES.items() for x in xs} | {0x200B: None, 0x200C: None, 0x200D: None, 0xAD: None}
_MIXED = re.compile(r"\w*[0-9@$][\w@$]*\w")
_WORD = re.compile(r"\w+")


def fold(text: str) -> str:
    text = text.lower()
    if not text.isascii():
        text = text.translate(_FOLD)
    return _MIXED.sub(_letters, text)


def _letters(m: re.Match) -> str:
    word = m[0]
    letters = sum(c.isalpha() for c in word)
    return word.translate(DIGITS) if letters >= 2 and letters > sum(c.isdigit() for c in word) else word


def features(word: str) -> list[str]:
    """A word's beginnings, and ^word$ for the whole."""
    return ["^" + word[:k] for k in range(SHORTEST, min(len(word), LONGEST) + 1)] + (["^" + word + "$"] if SHORTEST <= len(word) <= 24 else [])


@dataclass
class Model:
    lexicon: dict[str, float]  # features() -> weight
    mean: list[float]
    scale: list[float]
    weights: list[float]  # the last one is the constant
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self):
        entries: dict[str, list] = {}
        for f, w in self.lexicon.items():
            whole = f.endswith("$")
            e = entries.setdefault(f.strip("^$"), [len(f.strip("^$")), 0.0, 0.0, False])
            e[2 if whole else 1] = w
        for x in self.exceptions:
            entries.setdefault(fold(x), [len(fold(x)), 0.0, 0.0, False])[3] = True
        a = ahocorasick.Automaton()
        for k, e in entries.items():
            a.add_word(k, tuple(e))
        if len(a):
            a.make_automaton()
        return a


def hits(automaton, text: str) -> tuple[float, int]:
    """(sum of the weights, number of words) of a text."""
    best: dict[int, float] = {}
    spans = []
    t = fold(text)
    if len(automaton):
        for end, (n, start_weight, whole_weight, exception) in automaton.iter(t):
            begin = end - n + 1
            if begin and t[begin - 1].isalnum():
                continue
            closed = end + 1 == len(t) or not t[end + 1].isalnum()
            if exception and closed:
                spans.append((begin, end))
            w = max(start_weight, whole_weight if closed else 0.0)
            if w > best.get(begin, 0.0):
                best[begin] = w
    if spans:
        best = {b: w for b, w in best.items() if not any(x <= b <= y for x, y in spans)}
    return sum(best.values()), len(text.split())


def measure(total: float, n: int) -> tuple[float, ...]:
    return total / (n + 20), math.log1p(total), total / math.sqrt(n + 1)


def score(model: Model, total: np.ndarray, n: np.ndarray) -> np.ndarray:
    x = np.array([measure(a, b) for a, b in zip(total.tolist(), n.tolist())]).reshape(-1, 3)
    z = ((x - model.mean) / model.scale) @ np.array(model.weights[:-1]) + model.weights[-1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


SCORED = StructType([StructField("score", DoubleType()), StructField("hit_weight", DoubleType()), StructField("n_words", LongType())])


def scorer(model: Model):
    """fn for annotate()."""
    cache = []

    def fn(column: pa.Array):
        if not cache:
            cache.append(model.automaton())
        found = [hits(cache[0], x.as_py()) for x in column]  # one text at a time
        total, n = np.array([x for x, _ in found], float), np.array([x for _, x in found], np.int64)
        return [pa.array(score(model, total, n)), pa.array(total), pa.array(n)]

    return fn


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, most: int) -> DataFrame:
    """(text, y) of at most `most` labelled rows outside the held-out part, by a hash of the id."""
    rows = labels.select(quoted(id_col).alias("i"), quoted(label_col).cast("int").alias("y")).where("i is not null and y is not null")
    rows = rows.where(~held_out(F.col("i"))).groupBy("i").agg(F.max("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(most)
    rows = materialize(rows, "toxicity-labels")  # at most `most` pairs of numbers, so it can be broadcast
    texts = docs.select(quoted(id_col).alias("i"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    return materialize(texts.join(F.broadcast(rows), "i").select("text", "y"), "toxicity-training")


#: Features that a task counts before it passes its counts on.
HELD = 150_000


def count_terms(batches):
    """mapInArrow over (text, y): how often (see MOST_PER_TEXT) and in how many texts of a kind each feature is.

    A feature may come several times from one task; the counts are sums.
    """
    counts: dict[str, list[int]] = {}  # n0, n1, t0, t1

    def passed_on():
        keys = list(counts)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([counts[k][i] for k in keys], pa.int64()) for i in range(4))], names=["f", "n0", "n1", "t0", "t1"])

    for b in batches:
        for text, y in zip(b.column(0), b.column(1).to_pylist()):
            y = int(bool(y))
            seen = Counter()
            for word, times in Counter(_WORD.findall(fold(text.as_py()))).items():
                for f in features(word):
                    seen[f] += times
            seen[""] = 0
            for f, times in seen.items():
                c = counts.setdefault(f, [0, 0, 0, 0])
                c[y] += min(times, MOST_PER_TEXT)
                c[2 + y] += 1
            if len(counts) >= HELD:
                yield passed_on()
                counts.clear()
    if counts:
        yield passed_on()


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = MAX_TRAIN) -> Model:
    rows = training_rows(docs, labels, id_col, text_col, label_col, most)
    counts = materialize(rows.mapInArrow(count_terms, "f string, n0 long, n1 long, t0 long, t1 long").groupBy("f").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "t0", "t1")]), "toxicity-terms")
    whole = counts.where("f = ''").first()
    if whole is None or not whole.t0 or not whole.t1:
        share = 0.0 if whole is None or not whole.t1 else 1.0
        return Model({}, [0.0] * 3, [1.0] * 3, [0.0] * 3 + [30.0 * (2 * share - 1)])
    ratio = F.log((F.col("n1") + 0.5) / F.lit(float(whole.t1))) - F.log((F.col("n0") + 1.0) / F.lit(float(whole.t0)))
    n, p = F.col("t0") + F.col("t1"), whole.t1 / (whole.t0 + whole.t1)
    excess = F.col("t1") * F.log(F.col("t1") / (n * p)) + F.when(F.col("t0") > 0, F.col("t0") * F.log(F.col("t0") / (n * (1 - p)))).otherwise(0.0)
    terms = counts.where((F.col("f") != "") & (F.col("t1") >= FEWEST)).withColumn("w", ratio).where((F.col("w") > RATIO) & (excess >= -math.log(CHANCE)))
    lexicon: dict[str, float] = {}
    for r in sorted(terms.select("f", "w").collect(), key=lambda r: (len(r.f), r.f)):
        shorter = [lexicon[r.f[:k]] for k in range(2, len(r.f)) if r.f[:k] in lexicon]
        if not shorter or r.w >= max(shorter) + GAIN:
            lexicon[r.f] = r.w
    model = Model(lexicon, [0.0] * 3, [1.0] * 3, [0.0] * 4)

    def measured(batches):
        automaton = model.automaton()
        for b in batches:
            found = [measure(*hits(automaton, x.as_py())) for x in string_column(b.column(0))]
            yield pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in found], pa.float64()) for i in range(3)), b.column(1)], names=["x0", "x1", "x2", "y"])

    got = rows.mapInArrow(measured, "x0 double, x1 double, x2 double, y int").toArrow()  # at most `most` rows
    x, y = np.stack([got.column(i).to_numpy() for i in range(3)], 1), (got.column(3).to_numpy() > 0).astype(float)
    order = np.lexsort((y, *x.T))  # the sums do not depend on the order of rows
    model.mean, model.scale = x[order].mean(0).tolist(), (x[order].std(0) + 1e-9).tolist()
    model.weights = logistic((x[order] - model.mean) / model.scale, y[order]).tolist()
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    x = np.c_[x, np.ones(len(x))]
    w, penalty = np.zeros(x.shape[1]), ridge * np.diag([*np.ones(x.shape[1] - 1), 1e-3])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x.T * (p * (1 - p))) @ x / len(y) + penalty, x.T @ (p - y) / len(y) + penalty @ w)
    return w


def toxicity(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """(the columns `keep` of docs, by default all, with a struct column of SCORED, its name)."""
    return annotate(docs, text_col, SCORED, scorer(model), docs.columns if keep is None else keep, "toxicity")
