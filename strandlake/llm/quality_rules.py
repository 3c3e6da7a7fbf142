"""Quality rules as a ledger of failure bits, with DataFrame functions only.

ledger() measures every text once, with one bit for each rule that the text fails, and stored()
writes measurements and bits, without the texts. Policies are versioned sets of rules; applying one is a bitwise test on the stored
bits, so a new policy never reads a text again. ablation() counts from the same bits what each
rule of a policy costs.

Everything about a text is computed in its row, so nothing is shuffled and no key can be hot. The
windows of a text are hashed with 64 bits; only texts with equal windows are sorted, in
n log n steps.

Defined results: null and empty texts have no words and fail the word count; lines without a word
never count as repeated; ratios of a text without words are 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import materialize, quoted

WINDOW = 8

#: Rules in bit order, as conditions on the measurements under which a text fails.
RULES = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 25 * n_words",
    "repeated_lines": "n_lines > 3 and 10 * n_dup_lines > 3 * n_lines",
    "capitals": "2 * n_capitals > word_chars",
    "exclamations": "4 * n_exclamations > n_words",
    "many_words": "n_words > 1000000",
    "stutter": "5 * n_stutter > n_words",
}
BASE = ("few_words", "repeated_words")
POLICIES = {
    1: BASE,
    2: (*BASE, "symbols", "short_words", "long_words", "repeated_lines", "capitals", "exclamations", "many_words", "stutter"),
}
CURRENT = 2
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutter", "n_capitals", "n_exclamations")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def mask(names) -> int:
    order = list(RULES)
    return sum(1 << order.index(n) for n in names)


def repeated_words(h: Column, k: int = WINDOW) -> Column:
    """How many words, given by their hashes, lie in windows of k words that the text has twice or more."""

    def of_windows(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(p: Column) -> Column:
            again = F.filter(p, lambda x, j: F.coalesce(x["h"] == F.get(p, j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(p, j + 1)["h"], F.lit(False)))
            return let(F.sort_array(F.transform(again, lambda x: x["i"])), lambda at: F.aggregate(F.transform(at, lambda x, j: F.least(F.lit(k), F.coalesce(F.get(at, j + 1) - x, F.lit(k)))), F.lit(0), lambda a, b: a + b))

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(pairs, twice))

    windows = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
    return F.when(F.size(h) < k, F.lit(0)).otherwise(let(windows, of_windows)).cast("long")


def stutter(h: Column) -> Column:
    """How many words equal the word before."""
    return F.size(F.filter(h, lambda x, i: F.coalesce(x == F.get(h, i - 1), F.lit(False)))).cast("long")


def measures(text: Column) -> Column:
    """A struct of MEASURES."""
    text = F.coalesce(text, F.lit(""))
    only = lambda kind: F.length(F.regexp_replace(text, f"[^{kind}]+", "")).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
            let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.struct(repeated_words(h).alias("n_repeat_words"), stutter(h).alias("n_stutter"))).alias("h"),
        )

    by_word = let(F.array_remove(F.split(text, "[ \\t-\\r]+"), ""), of_words)
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return F.struct(by_word.alias("w"), by_line.alias("l"), only("#*$%&|<>").alias("n_symbols"), only("A-Z").alias("n_capitals"), only("!").alias("n_exclamations"))


def ledger(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (by default all) as a struct `row`, the measurements, and `failed`, the bits of the rules."""
    keep = docs.columns if keep is None else keep
    m = docs.select(F.struct(*[quoted(c) for c in keep]).alias("row"), measures(quoted(text_col)).alias("m"))
    m = m.select("row", "m.w.n_words", "m.w.word_chars", "m.w.h.*", "m.l.*", "m.n_symbols", "m.n_capitals", "m.n_exclamations")
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, rule in enumerate(RULES.values())]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return m.select("row", *MEASURES, failed.alias("failed"))


def stored(led: DataFrame) -> DataFrame:
    """The ledger as a written table, which policies and ablations read instead of the texts."""
    return materialize(led, "quality-ledger")


def passes(failed: Column, version: int = CURRENT) -> Column:
    return failed.bitwiseAND(F.lit(mask(POLICIES[version]))) == 0


def ablation(led: DataFrame, version: int = CURRENT) -> DataFrame:
    """For each rule of a policy: the rows it fails, those that fail by it alone, and what is kept without it."""
    policy = mask(POLICIES[version])
    groups = led.groupBy(F.col("failed").bitwiseAND(F.lit(policy)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(mask([n])).cast("long").alias("bit")) for n in POLICIES[version]])
    each = groups.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    others = F.col("bits").bitwiseAND(F.bitwise_not("bit"))
    count = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)).cast("long")
    return each.groupBy("rule").agg(
        count(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("failed"),
        count(F.col("bits") == F.col("bit")).alias("failed_alone"),
        count(others == 0).alias("kept_without"),
        count(F.col("bits") == 0).alias("kept"),
    )


MEASURED_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT doc_id, unnest(range(1, len(words) - 6)) AS i, words FROM w WHERE len(words) >= 8),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i:i + 7]) AS n FROM p),
c AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS j FROM g WHERE n > 1) GROUP BY doc_id),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        length(regexp_replace(text, '[^A-Z]+', '', 'g'))::BIGINT AS n_capitals,
        length(regexp_replace(text, '[^!]+', '', 'g'))::BIGINT AS n_exclamations,
        len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        len(list_filter(words, lambda x, i: i > 1 AND x = words[i - 1]))::BIGINT AS n_stutter,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN c USING (doc_id))
"""

#: The bits of all rules, in their order.
FAILED_SQL = "(" + " + ".join(f"CASE WHEN {rule} THEN {1 << i} ELSE 0 END" for i, rule in enumerate(RULES.values())) + ")::BIGINT"

ORACLE_SQL = f"""{MEASURED_SQL}, f AS (SELECT *, {FAILED_SQL} AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 25 * n_words
    OR (n_lines > 3 AND 10 * n_dup_lines > 3 * n_lines) OR 2 * n_capitals > word_chars
    OR 4 * n_exclamations > n_words OR n_words > 1000000 OR 5 * n_stutter > n_words) AS kept
FROM f
"""

ABLATION_SQL = f"""{MEASURED_SQL}, f AS (SELECT {FAILED_SQL} AS bits FROM m),
rules AS (SELECT * FROM (VALUES {", ".join(f"({v}, '{n}', {mask([n])}, {mask(names)})" for v, names in POLICIES.items() for n in names)}) AS t(version, rule, bit, policy))
SELECT version::BIGINT AS version, rule, count(*) FILTER (bits & bit <> 0)::BIGINT AS failed, count(*) FILTER (bits & policy = bit)::BIGINT AS failed_alone,
  count(*) FILTER (bits & policy & ~bit = 0)::BIGINT AS kept_without, count(*) FILTER (bits & policy = 0)::BIGINT AS kept
FROM f, rules GROUP BY version, rule
"""
