"""A corpus pipeline of five stages, each of which works on all that the stage before has kept.

Toxic documents go, one of each group of near-duplicates stays, contaminated documents go, sources
are mixed to their target weights (a document that is taken twice is there twice), and the mix is
written as shards. All stages but the last return the columns of documents; the last adds shard,
tier, shard_bytes and version.

Defined results: null and empty texts are never toxic, near-duplicates or contaminated, and have no
words, so the mix, which counts words, takes none of them; of rows that agree in id and text one
stays; a null id never stays where a component has another; a null source is a source of its own;
a table without rows gives one without rows and a store whose versions hold nothing; all columns
of documents come through as they are, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import decontaminate, jaccard_join, mixing, sharding, toxicity
from strandlake.llm.common import quoted, shared_dir, table

#: Near-duplicates by word shingles.
SHINGLE_WORDS, PERCENT = 5, 80

ORACLE_SQL = None  # models, sets and files are beyond SQL; tests compare each stage with brute force


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    found, s = toxicity.toxicity(docs, model)
    return found.where(F.col(s)["score"] < toxicity.THRESHOLD).select(*[quoted(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, size=SHINGLE_WORDS, percent=PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found, leak = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~decontaminate.contaminated(F.col(leak))).select(*[quoted(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(docs).where("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def write_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.placed(*sharding.shard(docs), keep=docs.columns)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", write_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_dir(spark)}/strandlake/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{root}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
