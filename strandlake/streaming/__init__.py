"""Archives of arriving FASTQ files: each micro-batch of file names becomes one archive for each file.

An extension for continuous ingest. The stream lists new files of a folder; foreachBatch compresses
them to the output folder under their own names, several at a time. A batch that is tried again
overwrites what it wrote, so every file has exactly one archive.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from itertools import islice

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandlake.plans import commands

#: Files that are compressed at the same time.
AT_ONCE = 8


def archive_arrivals(spark: SparkSession, folder: str, output: str, checkpoint: str, profile: str | None = None, glob: str = "*.{fastq,fq,gz}") -> StreamingQuery:
    """Start a stream that archives every file that appears in folder."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).load(folder)

    def batch(df, _):
        def one(path):
            commands.compress(df.sparkSession, path, f"{output}/{path.rsplit('/', 1)[1]}.arc", profile=profile, force=True)

        paths = (r.path for r in df.select("path").distinct().orderBy("path").toLocalIterator())
        with ThreadPoolExecutor(AT_ONCE) as pool:
            while some := list(islice(paths, AT_ONCE)):
                list(pool.map(one, some))

    return files.select("path", F.lit(None).alias("x")).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
