"""Connected components of a link table, by alternating star operations on tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from strandlake.llm.common import Work

#: Links that one task may join by itself: 16 MB of ids. More are joined by tables.
LOCAL_LINKS = 1 << 20


def union_find(kind: pa.DataType):
    """mapInArrow over all links (u, v), for tables of at most LOCAL_LINKS rows."""

    def run(batches):
        parent: dict = {}

        def root(x):
            parent.setdefault(x, x)
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for b in batches:
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                u, v = root(u), root(v)
                parent[max(u, v)] = min(u, v)
        nodes = sorted(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], names=["node", "root"])

    return run


def components(links: DataFrame, work: Work, name: str = "components", a: str = "a", b: str = "b", local_links: int = LOCAL_LINKS) -> DataFrame:
    """(node, root) for each node of the links (longs or binaries); root is the smallest node of its component.

    Up to local_links distinct links one task joins them. Beyond, each round links the larger
    neighbours of a node to its smallest neighbour, then the smaller ones, until nothing changes;
    rounds are written tables, and only sums come to the driver. Self-links and nulls are left out;
    no links give no rows.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    pairs, before = work.save(pairs, f"{name}-0"), None
    if pairs.count() <= local_links:
        kind = pairs.schema["u"].dataType
        out = StructType([StructField("node", kind), StructField("root", kind)])
        return work.save(pairs.repartition(1).mapInArrow(union_find(to_arrow_type(kind)), out), f"{name}-roots")
    for i in range(1, 100):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = pairs.join(least.withColumnRenamed("u", "v"), "v").select("u", F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        again = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        pairs = work.save(again.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), f"{name}-{i}")
        work.drop(f"{name}-{i - 1}")
        sums = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(sums) == before:
            break
        before = tuple(sums)
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
