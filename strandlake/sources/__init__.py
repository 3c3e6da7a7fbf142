"""Readers and writers; register() makes them known to a session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def register(spark: SparkSession) -> None:
    from strandlake.sources.fastq import FastqSource
    from strandlake.sources.frames import FramesSource

    spark.dataSource.register(FastqSource)
    spark.dataSource.register(FramesSource)
