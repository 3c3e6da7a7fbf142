"""Shared pieces of the operators: shared storage, row keys, table access."""

from __future__ import annotations

import contextlib
import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import AtomicType, StructField, StructType

from strandlake.llm.kernels import string_column


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver share.

    It is what spark.checkpoint.dir names. Only where that is unset and all runs on one machine
    (tests) a folder in /tmp is set instead; a cluster without it fails.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file:///tmp/strandlake-shared"
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


@contextlib.contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A setting of the session that holds inside the block."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def give_back() -> None:
    """Return to the system what a Python worker no longer holds, at the end of its task.

    Workers live on beside the executor's JVM, which may need the room in stages without Python.
    """
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


#: Spark deletes the shuffle files of a query as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Work:
    """Work tables of one operator call in the shared folder.

    A step that is written and read again cuts the lineage: a lost executor costs its running
    tasks, not the steps before. Steps that nothing reads any more are deleted by drop().
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/strandlake/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        for n in names:
            at = path(f"{self.root}/{n}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """One work table that stays until the shared folder is emptied."""
    return Work(df.sparkSession, name).save(df, "table")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_keys(id_col: str, text_col: str) -> list[Column]:
    """_d and _t, 128 bits of the id (of any type) and the text, tell rows apart also where ids repeat or are null.

    Rows that agree in id and text share them.
    """
    name, text = quoted(id_col).cast("string"), quoted(text_col)
    return [F.xxhash64(F.lit(1), name, F.isnull(name), text).alias("_d"), F.xxhash64(F.lit(2), text, F.isnull(text), name).alias("_t")]


def row_hash(schema: StructType, seed: int = 0) -> Column:
    """64 bits of all columns of simple types, which order rows that agree in their keys alike at every run."""
    simple = [f.name for f in schema.fields if isinstance(f.dataType, AtomicType)]
    return F.xxhash64(F.lit(seed), *[quoted(c) for c in simple])


def free_name(df: DataFrame, wanted: str) -> str:
    """`wanted`, with underscores before it until no column of df is called so."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def annotate(df: DataFrame, column: str, fields: StructType, fn, keep: list[str], out: str) -> tuple[DataFrame, str]:
    """The columns `keep` of df and a struct with what fn makes of the text column, without a shuffle.

    fn gets an Arrow string array without nulls and returns one Arrow array for each field.
    The struct is called `out`, or _out and so on if df has such a column.
    """
    name = free_name(df, out)
    names = list(dict.fromkeys([*keep, column]))
    # Columns have plain names on the way through Python, as theirs may have dots and quotes.
    source = df.select(*[quoted(c).alias(f"c{i}") for i, c in enumerate(names)])
    places = [names.index(c) for c in keep]
    schema = StructType([StructField(f"k{j}", source.schema[i].dataType) for j, i in enumerate(places)] + [StructField("made", fields)])
    kinds = list(to_arrow_schema(schema).field(len(keep)).type)

    def run(batches):
        for b in batches:
            made = fn(string_column(b.column(names.index(column))))
            struct = pa.StructArray.from_arrays([x.cast(f.type) for x, f in zip(made, kinds)], fields=kinds)
            yield pa.RecordBatch.from_arrays([b.column(i) for i in places] + [struct], names=schema.names)
        b = made = struct = None
        give_back()

    done = source.mapInArrow(run, schema)
    return done.select(*[F.col(f"k{j}").alias(c) for j, c in enumerate(keep)], F.col("made").alias(name)), name
