"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Targets: sources in the order of their names weigh 1, 2, 3 and again 1, and share all words by
weight; a target stops at three times its source's size and the excess goes to the others by
weight. Draws: each document has a uniform number u from its id, a quality weight w and the key
-ln(u) / w; a source's documents in the order of their keys are a weighted draw without
replacement. A source first gives whole epochs (every document once) and then the documents whose
running sum of words comes nearest to the rest of its target.

No source is sorted in one task: keys are dealt to about sqrt(n / LEAST) buckets of a source, bucket sums
give the bucket in which the target is met, and only that bucket is ordered. Keys are brought to
(0, 1) so that whatever the weights no bucket expects more than 1 / LEAST times its share. Sources
themselves are ranked and summed in ranges of their order, so they may be many. What decides about a
source is one row (epochs and the last key it takes), so documents are not shuffled; the rows of
sources are broadcast while they are at most MAX_BROADCAST, and joined otherwise.

Defined results: null and empty texts have size 0, which takes 0; a null source is a source of its
own and comes last; rows that agree in id and text are taken alike; without an id the text decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import materialize, quoted

WEIGHTS = (1, 2, 3)
MOST = 3
#: Rows of the table of sources that may be broadcast.
MAX_BROADCAST = 100_000
#: The least quality weight; the greatest is 1.
LEAST = 0.1


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+"))).cast("long")


def quality(text: Column, size: Column) -> Column:
    """From 0.1 to 1: how few characters of markup or stress there are for each word."""
    marks = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "[^#*$%&|<>!]+", ""))
    return F.greatest(F.lit(LEAST), 1.0 - marks / F.greatest(size, F.lit(1)))


def uniform(id_col: Column, text: Column) -> Column:
    """A number in (0, 1) from the id, or from the text if there is no id."""
    name = F.coalesce(id_col.cast("string"), F.xxhash64(text).cast("string"))
    return (F.conv(F.substring(F.md5(name.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def before(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with running sums of what stands before each in the order, range by range: what the ranges before hold
    (a row for each range) and what stands before it in its own."""
    dealt = materialize(rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "mix-ranges")
    run = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    zero = F.lit(0).cast("long")
    held = dealt.groupBy("_p").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    held = held.select("_p", *[F.coalesce(F.sum(f"_{n}").over(run), zero).alias(f"_{n}") for n in sums])
    own = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = [F.coalesce(F.sum(c).over(own), zero).alias(f"_in_{n}") for n, c in sums.items()]
    found = dealt.select("*", *inside).join(F.broadcast(held), "_p")  # at most as many rows as shuffle partitions
    return found.select(*[quoted(c) for c in rows.columns], *[(F.col(f"_in_{n}") + F.col(f"_{n}")).alias(n) for n in sums])


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size) with `target`: shares by weight, stopped at MOST times the size, excess reshared.

    The table has one row for each source. Sources that stop first have the least room for their weight, so
    running sums in that order tell which stop.
    """
    name, one = F.col("source").asc_nulls_last(), F.lit(1).cast("long")
    ranked = before(sources, [name], {"rank": one})
    weights = F.array(*[F.lit(x).cast("long") for x in WEIGHTS])
    t = ranked.withColumn("w", F.element_at(weights, (F.col("rank") % len(WEIGHTS) + 1).cast("int"))).drop("rank")
    most = F.col("source_size") * MOST
    t = materialize(before(t, [most / F.col("w"), name], {"most_before": most, "w_before": F.col("w")}), "mix-order")
    every = t.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w")).first()  # one row
    t = t.withColumn("left", F.lit(every.size or 0).cast("long") - F.col("most_before")).withColumn("w_left", F.lit(every.w or 0).cast("long") - F.col("w_before"))
    t = t.withColumn("stops", most * F.col("w_left") <= F.col("w") * F.col("left"))
    left = t.where("not stops").agg(F.max(F.struct("w_left", "left")).alias("x")).first().x  # one row
    share = (F.col("w") * F.lit(left.left if left else 0).cast("long")).cast("double") / F.lit(float(left.w_left if left else 1))
    return t.select("source", "source_size", F.when(F.col("stops"), most.cast("double")).otherwise(share).alias("target"))


def plan(keys: DataFrame) -> DataFrame:
    """For each source of (source, size, key): target, epochs and `last`, the key of the last document taken on top.

    `key` is a struct whose first field, u, is the draw key brought to (0, 1).
    """
    sources = keys.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    t = targets(sources.select("source", "source_size")).withColumnRenamed("source", "s")
    t = t.join(sources.select(F.col("source").alias("s2"), "n"), F.col("s").eqNullSafe(F.col("s2"))).drop("s2")
    epochs = F.when(F.col("source_size") == 0, 0).otherwise(F.least(F.lit(MOST), F.floor(F.col("target") / F.col("source_size")))).cast("int")
    t = t.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).withColumn("k", F.ceil(F.sqrt(F.col("n") / LEAST)).cast("long"))
    t = materialize(t, "mix-sources")
    bucketed = with_sources(keys, t.select("s", "k", "rest")).withColumn("b", F.floor(F.col("key.u") * F.col("k")).cast("long"))
    sums = materialize(bucketed.groupBy("source", "b").agg(F.sum("size").alias("size"), F.first("rest").alias("rest")), "mix-buckets")
    run = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    met = sums.withColumn("before", F.coalesce(F.sum("size").over(run), F.lit(0).cast("long"))).where("before < rest and before + size >= rest")
    inside = bucketed.drop("rest").join(met.select(F.col("source").alias("s3"), F.col("b").alias("b3"), "before", "rest"), F.col("source").eqNullSafe(F.col("s3")) & (F.col("b") == F.col("b3")))
    place = Window.partitionBy("s3").orderBy("key")
    at = F.col("before") + F.coalesce(F.sum("size").over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    taken = inside.withColumn("at", at).where(F.col("at") + F.col("size") / 2 <= F.col("rest"))
    last = taken.groupBy("s3").agg(F.max("key").alias("in_bucket"))
    t = t.join(last, F.col("s").eqNullSafe(F.col("s3")), "left").drop("s3")
    edge = met.select(F.col("source").alias("s3"), F.col("b").alias("edge"))
    return t.join(edge, F.col("s").eqNullSafe(F.col("s3")), "left").select("s", "source_size", "target", "epochs", "rest", "k", "edge", "in_bucket")


def with_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """The rows with their source's row."""
    if sources.count() <= MAX_BROADCAST:
        sources = F.broadcast(sources)
    return rows.join(sources, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """For each row: a struct `row` of the columns `keep` (by default all), size, source_size, target, copies and taken."""
    keep = docs.columns if keep is None else keep
    text = quoted(text_col)
    base = docs.select(F.struct(*[quoted(c) for c in keep]).alias("row"), quoted(source_col).cast("string").alias("source"), word_count(text).alias("size"), quality(text, word_count(text)).alias("_w"), uniform(quoted(id_col), text).alias("_u"), quoted(id_col).alias("_id"), F.xxhash64(text).alias("_h"))
    key = F.struct((1.0 - F.pow(F.col("_u"), LEAST / F.col("_w"))).alias("u"), F.col("_id").alias("id"), F.col("_h").alias("h"))
    base = base.select("row", "source", "size", key.alias("key"))
    if text_col not in keep:
        base = materialize(base, "mix-rows")
        keys = base.select("source", "size", "key")
    else:
        keys = materialize(base.select("source", "size", "key"), "mix-keys")
    sources = materialize(plan(keys), "mix-plan")
    b = F.floor(F.col("key.u") * F.col("k")).cast("long")
    on_top = (F.col("rest") > 0) & F.when(F.col("edge").isNull(), False).otherwise((b < F.col("edge")) | ((b == F.col("edge")) & F.coalesce(F.col("key") <= F.col("in_bucket"), F.lit(False))))
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("epochs") + on_top.cast("int")).cast("int")
    out = with_sources(base, sources).withColumn("copies", copies)
    return out.select("row", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
z AS (SELECT doc_id, source, len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
        length(regexp_replace(text, '[^#*$%&|<>!]+', '', 'g')) AS marks,
        (('0x' || substr(md5(doc_id::VARCHAR), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u FROM d),
k AS (SELECT doc_id, source, size, 1.0::DOUBLE - pow(u, 0.1::DOUBLE / greatest(0.1::DOUBLE, 1.0::DOUBLE - marks::DOUBLE / greatest(size, 1))) AS key FROM z),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM s),
r AS (SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS l, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS wl FROM w
      WINDOW before AS (ORDER BY 3 * source_size / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
o AS (SELECT *, (3 * source_size * wl <= w * l) AS stops FROM r),
f AS (SELECT wl, l FROM o WHERE NOT stops ORDER BY wl DESC LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN stops THEN (3 * source_size)::DOUBLE ELSE (w * (SELECT l FROM f))::DOUBLE / (SELECT wl FROM f)::DOUBLE END AS target FROM o),
e AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(3, floor(target / source_size)) END::BIGINT AS epochs FROM t),
a AS (SELECT k.*, e.source_size, target, epochs, coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_it
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN before_it + size / 2.0 <= target - epochs * source_size AND target - epochs * source_size > 0 THEN 1 ELSE 0 END))::BIGINT AS taken FROM a
"""
