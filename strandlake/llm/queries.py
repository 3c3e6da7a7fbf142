"""The opN_<name> queries: each operator with production parameters over its whole table."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import (
    decontaminate,
    html_extract,
    jaccard_join,
    license_scan,
    mixing,
    quality_rules,
    sharding,
    substring_dedup,
    suffix_dedup,
    toxicity,
)
from strandlake.llm.common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the shard it ends up in."""
    return sharding.placed(*sharding.shard(table(spark, sf_dir, "documents")), keep=["doc_id", "n_chars"])


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    found, s = toxicity.toxicity(docs, model, keep=["doc_id"])
    score = F.col(s)["score"]
    return found.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest policy, read from the stored bits."""
    led = quality_rules.stored(quality_rules.ledger(table(spark, sf_dir, "documents"), keep=["doc_id"]))
    base = F.lit(quality_rules.mask(quality_rules.BASE))
    return led.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("failed").bitwiseAND(base) != 0).alias("base_failed"), quality_rules.passes(F.col("failed")).alias("kept"), "failed")


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy costs, from the stored bits."""
    led = quality_rules.stored(quality_rules.ledger(table(spark, sf_dir, "documents"), keep=["doc_id"]))
    found = [quality_rules.ablation(led, v).withColumn("version", F.lit(v).cast("long")) for v in quality_rules.POLICIES]
    return functools.reduce(DataFrame.unionByName, found)


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, s = html_extract.extract_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return found.select("page_id", "url", F.col(s)["text"].alias("text"), F.col(s)["n_chars"].alias("n_chars"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents")).drop("_root")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no path, so the source is a repository and ranges of ids are its directories."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.floor(F.col("doc_id") / 1000), F.floor(F.col("doc_id") / 50), "doc_id")
    return license_scan.scan(table(spark, sf_dir, "documents"), path, keep=["doc_id"]).select("row.doc_id", "path", "license", "score", "basis", "license_dir")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found, leak = decontaminate.decontaminate(docs, bench, keep=["doc_id"])
    s = F.col(leak)
    return found.select("doc_id", *[s[c].alias(c) for c in ("n_words", "n_hit", "n_items", "items_sha256")], decontaminate.contaminated(s).alias("contaminated"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_bytes=False).drop("kept_bytes")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("row.doc_id", "size", "source_size", "target", "taken")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)} | {"quality_ablation": quality_ablation}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_quality_rules": quality_rules.ORACLE_SQL,
        "op4_html_extract": html_extract.ORACLE_SQL,
        "op5_jaccard_join": jaccard_join.ORACLE_SQL,
        "op7_decontaminate": decontaminate.ORACLE_SQL,
        "op8_suffix_dedup": suffix_dedup.ORACLE_SQL,
        "op9_mixing": mixing.ORACLE_SQL,
        "op10_substring_dedup": substring_dedup.ORACLE_SQL,
        "quality_ablation": quality_rules.ABLATION_SQL,
    }
