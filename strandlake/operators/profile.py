"""Technology profile and pair operators over (read_no, id, comment, sequence, quality)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import expr as E

# What the headers of each technology contain, and the limits of short reads.
ONT = ("runid=", " ch=", "channel=")
HIFI = ("/ccs", "hifi")
CLR = ("pacbio", "subread")
SAMPLE_READS = 50_000
SHORT_MAX, SHORT_MEAN = 1000, 500


def header_flags(id_: Column, comment: Column) -> tuple[Column, Column, Column]:
    """(ont, hifi, clr) of a header; a header may be of several kinds."""
    header = E.lower_ascii(F.concat(id_, F.lit(" "), comment))
    movie = id_.startswith("m") & (E.count_char(id_, "/") >= 2) & ~header.contains("/ccs")
    return E.contains_any(header, ONT), E.contains_any(header, HIFI), E.contains_any(header, CLR) | movie


def profile_sample(reads: DataFrame, limit_bases: int, pairs: bool = False) -> DataFrame:
    """The first reads, up to SAMPLE_READS and until limit_bases are reached; pairs stay together.

    Only a prefix of SAMPLE_READS rows is taken before sums are run over it.
    """
    first = reads.orderBy("read_no").limit(SAMPLE_READS)
    step = F.floor((F.col("read_no")) / 2) if pairs else F.col("read_no")
    before = F.coalesce(F.sum(F.length("sequence")).over(Window.orderBy(step).rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return first.withColumn("bases_before", before.cast("long")).where(F.col("bases_before") < limit_bases)


def detect_profile(reads: DataFrame, *groups: str) -> DataFrame:
    """profile for each group (or overall): majorities first, then the length rule; null where neither holds."""
    ont, hifi, clr = header_flags(F.col("id"), F.col("comment"))
    n, length = F.count("*"), F.length("sequence")
    counts = reads.groupBy(*groups).agg(
        n.alias("n_reads"),
        *[F.sum(c.cast("long")).alias(name) for c, name in ((ont, "n_ont"), (hifi, "n_hifi"), (clr, "n_clr"))],
        F.sum(length).alias("n_bases"),
        F.max(length).cast("long").alias("longest"),
    )
    counts = counts.fillna(0, ["n_ont", "n_hifi", "n_clr", "n_bases", "longest"])
    majority = F.floor((F.col("n_reads") + 1) / 2)
    short = (F.col("longest") <= SHORT_MAX) & (F.floor(F.col("n_bases") / F.col("n_reads")) <= SHORT_MEAN)
    profile = F.when(F.col("n_reads") == 0, "illumina").when(F.col("n_hifi") >= majority, "pacbio-hifi").when(F.col("n_ont") >= majority, "ont").when(F.col("n_clr") >= majority, "pacbio-clr").when(short, "illumina")
    return counts.withColumn("profile", profile)


def pair_zip(r1: DataFrame, r2: DataFrame, key: str = "read_no") -> DataFrame:
    """Mates side by side by their ordinal (columns of the second with the suffix _2); ids are not compared."""
    second = r2.select(*[F.col(c).alias(c if c == key else f"{c}_2") for c in r2.columns])
    return r1.withColumn("in_1", F.lit(True)).join(second.withColumn("in_2", F.lit(True)), key, "full_outer")


def unpaired(zipped: DataFrame) -> DataFrame:
    """Rows with only one mate; any such row means that the inputs differ in length."""
    return zipped.where(F.col("in_1").isNull() | F.col("in_2").isNull())


def interleave(zipped: DataFrame, fields=("id", "comment", "sequence", "quality"), key: str = "read_no") -> DataFrame:
    """Both mates of each pair in order: places 2k and 2k + 1. One row becomes two without a shuffle."""
    mate = lambda i, s: F.struct((F.col(key) * 2 + i).alias("read_no"), *[F.col(f + s).alias(f) for f in fields])
    return zipped.select(F.explode(F.array(mate(0, ""), mate(1, "_2"))).alias("r")).select("r.*")
