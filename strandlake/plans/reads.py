"""Reads for the relational queries: derived row by row from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

READS = """SELECT event_id AS read_no, concat('read_', cast(event_id AS {S})) AS id,
  CASE WHEN event_id % 3 = 0 THEN event_type ELSE '' END AS comment,
  substr(translate(md5(cast(event_id AS {S})),'0123456789abcdef','ACGTACGTACGTNRYa'),1,cast(8+event_id%25 AS int)) AS sequence,
  substr(translate(md5(concat('q',cast(event_id AS {S}))),'0123456789abcdef','!#+5:?@ABDEFGHI~'),1,cast(8+event_id%25 AS int)) AS quality
FROM events"""
MATES = READS.replace("md5(cast(event_id AS {S}))", "md5(concat('m',cast(event_id AS {S})))")

DUCK = f"WITH reads AS ({READS.format(S='varchar')}), mates AS ({MATES.format(S='varchar')}) "


def reads(spark: SparkSession, sf_dir: str, sql: str = READS) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    return spark.sql(sql.format(S="string").replace("FROM events", "FROM {events}"), events=events)


def mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir, MATES)
