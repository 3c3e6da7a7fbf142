"""Shards under size-tiered compaction with versioned manifests.

A store is a folder in shared storage: data/ has immutable Parquet shards, manifests/ one JSON file
for each version. A version's file says which shards it adds and removes; every CHECKPOINT-th lists
all live shards, so that a commit writes what changes and a reader reads a bounded number of files.

append() writes an arrival as small shards. compact() takes runs of similar size (a tier holds sizes
that differ by less than FANOUT) and, once a tier has FANOUT shards, merges them into shards of the
target size; shards near the target are sealed and never written again, so each row is written
once for each tier it climbs. Neither shuffles: merging reads whole shards and coalesces them by
size, whatever their keys. vacuum() deletes shards that the last versions no longer list.

A version is committed by renaming a written file to the next number, which fails if another
writer was first; that writer's work is then kept and the commit is tried again on top of it, or
given up if it merged the same shards. A job that dies leaves files that no manifest lists.

The driver holds a line for each live shard (bytes / target, and under FANOUT for each tier below);
where a row lies is read from its file, not joined.

Defined results: an append without rows commits a version without new shards; rows that repeat are
kept; all columns are kept as they are, whatever their names.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandlake.llm.common import free_name, quoted, row_hash, setting, shared_dir

TARGET_BYTES = 128 << 20
#: Rows of an arrival shard at most.
SMALL_ROWS = 20_000
FANOUT = 4
#: A shard of this share of the target is sealed.
SEALED = 0.75
#: Versions between two that list all live shards.
CHECKPOINT = 16
#: How many files a task may write side by side; by default Spark sorts its rows and writes one after the other.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
#: Bytes that one merging job takes on at most; a longer list is merged job by job.
JOB_BYTES = 1 << 40


@dataclass(frozen=True)
class Shard:
    path: str  # below the store
    run: str
    tier: int
    rows: int
    bytes: int


class Conflict(RuntimeError):
    """Another writer has merged the same shards."""


class Store:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        if target_bytes < 1 or fanout < 2:
            raise ValueError("the target must be positive and the fan-out 2 or more")
        self.spark, self.root, self.target, self.fanout = spark, root.rstrip("/"), target_bytes, fanout
        jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    # manifests

    def version(self) -> int:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return max([int(n.removesuffix(".json")) for n in names if n.endswith(".json")], default=0)

    def _load(self, version: int) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/manifests/{version:012d}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> tuple[StructType | None, list[Shard]]:
        """(schema, live shards) of a version, by default the newest; version 0 is empty."""
        version = self.version() if version is None else version
        if not version:
            return None, []
        files = [self._load(version)]
        while "live" not in files[-1] and files[-1]["version"] > 1:
            files.append(self._load(files[-1]["version"] - 1))
        live: dict[str, Shard] = {x["path"]: Shard(**x) for x in files[-1].get("live", [])}
        for f in reversed(files):
            if "live" not in f:
                for path in f["removed"]:
                    live.pop(path, None)
                live |= {x["path"]: Shard(**x) for x in f["added"]}
        return StructType.fromJson(files[0]["schema"]), list(live.values())

    def commit(self, schema: StructType, added: list[Shard], removed: list[Shard]) -> int:
        """The new version. Fails with Conflict if a shard to remove is no longer live."""
        jvm = self.spark._jvm
        none = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        options = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = none
        while True:
            base = self.version()
            _, live = self.manifest(base)
            if missing := {s.path for s in removed} - {s.path for s in live}:
                raise Conflict(f"no longer live: {sorted(missing)[:3]}")
            gone = {s.path for s in removed}
            body = {"version": base + 1, "schema": schema.jsonValue(), "added": [asdict(s) for s in added], "removed": sorted(gone)}
            if (base + 1) % CHECKPOINT == 0:
                body["live"] = [asdict(s) for s in live if s.path not in gone] + body["added"]
            draft = self._path(f"{self.root}/manifests/_{uuid.uuid4().hex}")
            out = self._fs.create(draft, False)
            try:
                out.write(bytearray(json.dumps(body).encode()))
            finally:
                out.close()
            try:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self._fs.getUri(), self._conf)
                context.rename(draft, self._path(f"{self.root}/manifests/{base + 1:012d}.json"), options)
                return base + 1
            except Exception as e:
                self._fs.delete(draft, False)
                if "FileAlreadyExists" not in str(e):
                    raise

    # shards

    def _write(self, df: DataFrame, run: str, **options) -> list[Shard]:
        df.write.options(compression="zstd", **options).parquet(f"{self.root}/data/{run}")
        return self._written(run, df.schema)

    def _written(self, run: str, schema: StructType) -> list[Shard]:
        """The shards of a run that hold rows."""
        files = [s for s in self._fs.listStatus(self._path(f"{self.root}/data/{run}")) if s.getPath().getName().endswith(".parquet")]
        if not files:
            return []
        name = F.element_at(F.split(F.input_file_name(), "/"), -1)  # a row for each file comes to the driver
        rows = {r.f: r.n for r in self.spark.read.schema(schema).parquet(f"{self.root}/data/{run}").groupBy(name.alias("f")).agg(F.count("*").alias("n")).collect()}
        names = [(s.getPath().getName(), s.getLen()) for s in files]
        return [Shard(f"data/{run}/{n}", run, self.tier(size), rows[n], size) for n, size in sorted(names) if n in rows]

    def tier(self, size: int) -> int:
        """0 for the target and above, 1 below it by the fan-out, and so on: as many merges as are left."""
        return max(0, math.ceil(math.log(max(1.0, SEALED * self.target / max(size, 1)), self.fanout)))

    def append(self, df: DataFrame, max_rows: int = SMALL_ROWS) -> int:
        """Write an arrival as shards of at most max_rows and commit them."""
        return self.commit(df.schema, self._write(df, uuid.uuid4().hex, maxRecordsPerFile=max_rows), [])

    def append_all(self, df: DataFrame, arrival: Column, n: int, max_rows: int = SMALL_ROWS) -> int:
        """Write n arrivals in one pass, by their number (from 0), and commit and compact one after the other.

        A task holds a writer open for each arrival, so rows are not sorted by arrival in its memory before.
        """
        name, run = free_name(df, "arrival"), uuid.uuid4().hex
        with setting(self.spark, WRITERS, str(n)):
            df.withColumn(name, arrival).write.partitionBy(name).options(compression="zstd", maxRecordsPerFile=max_rows).parquet(f"{self.root}/data/{run}")
        for i in range(n):
            folder = f"{run}/{name}={i}"
            there = self._fs.exists(self._path(f"{self.root}/data/{folder}"))
            self.commit(df.schema, self._written(folder, df.schema) if there else [], [])
            self.compact()
            self.vacuum()
        return self.version()

    def compact(self) -> int:
        """Merge tiers, those of the smallest shards first, until none has FANOUT shards."""
        while True:
            schema, live = self.manifest()
            tiers: dict[int, list[Shard]] = {}
            for s in live:
                if s.tier:
                    tiers.setdefault(s.tier, []).append(s)
            chosen = next((tiers[t] for t in sorted(tiers, reverse=True) if len(tiers[t]) >= self.fanout), [])
            merged = False
            for group in batches(chosen, JOB_BYTES):
                n = max(1, round(sum(s.bytes for s in group) / self.target))
                if len(group) <= n:
                    continue
                df = self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.path}" for s in group])
                self.commit(schema, self._write(df.coalesce(n), uuid.uuid4().hex), group)
                merged = True
            if not merged:
                return self.version()

    def vacuum(self, versions: int = 1) -> int:
        """Delete the shards that no version from the last `versions` on lists; how many. Older versions go with them."""
        upto, gone = self.version() - versions + 1, set()
        mark = lambda v: self._path(f"{self.root}/manifests/{v:012d}.vacuumed")
        v = upto
        while v > 0 and not self._fs.exists(mark(v)):
            gone |= set(self._load(v)["removed"])
            v -= 1
        for path in gone:
            self._fs.delete(self._path(f"{self.root}/{path}"), False)
        if upto > 0:
            self._fs.create(mark(upto), True).close()
        return len(gone)

    def read(self, version: int | None = None) -> DataFrame:
        schema, live = self.manifest(version)
        if schema is None:
            raise ValueError("the store is empty")
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{s.path}" for s in live]) if live else self.spark.createDataFrame([], schema)


def batches(shards: list[Shard], most: int) -> list[list[Shard]]:
    out, size = [], most
    for s in shards:
        if size + s.bytes > most:
            out.append([])
            size = 0
        out[-1].append(s)
        size += s.bytes
    return out


#: Arrivals that shard() parts a table into; the first holds half of it, the next a half of the rest and so on.
ARRIVALS = 8


def shard(docs: DataFrame, target_bytes: int = TARGET_BYTES, small_rows: int = SMALL_ROWS, root: str | None = None, arrivals: int = ARRIVALS) -> tuple[Store, int]:
    """Bring a table to a new store in arrivals of different sizes, compacting after each: (store, version).

    A row's arrival follows the bits of a hash of its columns.
    """
    root = root or f"{shared_dir(docs.sparkSession)}/strandlake/shards-{uuid.uuid4().hex}"
    store = Store(docs.sparkSession, root, target_bytes)
    draw = row_hash(docs.schema, 1).bitwiseAND(F.lit((1 << (arrivals - 1)) - 1))
    zeros = F.length(F.regexp_extract(F.lpad(F.bin(draw), arrivals - 1, "0"), "(0*)$", 1)) if arrivals > 1 else F.lit(0)
    return store, store.append_all(docs, zeros.cast("int"), arrivals, small_rows)


def placed(store: Store, version: int, keep: list[str]) -> DataFrame:
    """For each row of a version: the columns `keep`, shard (its path in the store), tier, shard_bytes and version.

    All of it is read with the row from its file, so nothing is joined.
    """
    rows = store.read(version)
    if not store.manifest(version)[1]:
        name, size = F.lit(None).cast("string"), F.lit(None).cast("long")
    else:
        file = rows.metadataColumn("_metadata")
        name, size = F.regexp_extract(file["file_path"], ".*/(data/.+)$", 1), file["file_size"]
    tier = F.greatest(F.lit(0), F.ceil(F.log(F.greatest(F.lit(1.0), SEALED * store.target / size)) / math.log(store.fanout))).cast("int")
    return rows.select(*[quoted(c) for c in keep], name.alias("shard"), tier.alias("tier"), size.alias("shard_bytes"), F.lit(version).cast("long").alias("version"))
