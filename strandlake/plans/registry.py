"""All queries of the reference's operators with their SQL; flagship() is the headline query."""

from __future__ import annotations

import functools
import gzip
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions import codec, errors
from strandlake.functions import expr as E
from strandlake.operators import frames, profile
from strandlake.plans import archive, commands
from strandlake.plans.reads import DUCK, mates, reads
from strandlake.sources import register
from strandlake.sources.frames import inspect
from strandlake.sources.storage import locate, scratch
from strandlake.streaming import archive_arrivals

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

RECORD = ("id", "comment", "sequence", "quality")
cols = lambda: [F.col(c) for c in RECORD]


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = DUCK + sql
        return f

    return add


def pick(values: tuple, key):
    """The element of values that key modulo their number says."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def duck_pick(values: tuple, key: str) -> str:
    return "list_extract([" + ", ".join(f"'{v}'" for v in values) + f"], ({key} % {len(values)} + 1)::INT)"


HEADS = ("1F8B08", "425A6839", "FD377A585A00", "28B52FFD04", "40", "4052", "")
PATHS = (".fastq", ".fastq.gz", ".FQ.GZIP", ".bz2", ".tar.BZIP2", ".xz", ".lzma", ".zst", ".d/zstd", "")
FORMATS = ("none", "gzip", "bzip2", "xz", "zstd", "unknown")


@query("SELECT read_no, rtrim(concat(id, repeat(chr(13), (read_no % 3)::INT)), chr(13)) AS line FROM reads")
def trim_cr(spark, d):
    return reads(spark, d).select("read_no", E.trim_cr(F.concat("id", F.expr("repeat('\\r', cast(read_no % 3 AS int))"))).alias("line"))


@query("""SELECT read_no, split_part(h, ' ', 1) AS head_id, CASE WHEN instr(h, ' ') > 0 THEN substr(h, instr(h, ' ') + 1) ELSE '' END AS head_comment
FROM (SELECT read_no, concat(id, CASE WHEN comment = '' THEN '' ELSE concat(' ', comment, ' x') END) AS h FROM reads)""")
def header_split(spark, d):
    line = E.header_line(F.col("id"), F.when(F.col("comment") == "", "").otherwise(F.concat("comment", F.lit(" x"))))
    return reads(spark, d).select("read_no", line.alias("h")).select("read_no", E.header_id(F.col("h")).alias("head_id"), E.header_comment(F.col("h")).alias("head_comment"))


@query(f"""SELECT read_no, h AS head, CASE WHEN h LIKE '1F8B%' THEN 'gzip' WHEN h LIKE '425A68%' THEN 'bzip2' WHEN h LIKE 'FD377A585A00%' THEN 'xz'
WHEN h LIKE '28B52FFD%' THEN 'zstd' ELSE 'none' END AS format FROM (SELECT read_no, {duck_pick(HEADS, 'read_no')} AS h FROM reads)""")
def detect_magic(spark, d):
    return reads(spark, d).select("read_no", pick(HEADS, F.col("read_no")).alias("head")).withColumn("format", E.detect_magic(F.col("head")))


@query(f"""SELECT read_no, path, CASE lower(regexp_extract(path, '(\\.[^./]*)$', 1)) WHEN '.gz' THEN 'gzip' WHEN '.gzip' THEN 'gzip' WHEN '.bz2' THEN 'bzip2'
WHEN '.bzip2' THEN 'bzip2' WHEN '.xz' THEN 'xz' WHEN '.lzma' THEN 'xz' WHEN '.zst' THEN 'zstd' WHEN '.zstd' THEN 'zstd' ELSE 'none' END AS format
FROM (SELECT read_no, concat('data/', id, {duck_pick(PATHS, 'read_no')}) AS path FROM reads)""")
def detect_extension(spark, d):
    path = F.concat(F.lit("data/"), "id", pick(PATHS, F.col("read_no")))
    return reads(spark, d).select("read_no", path.alias("path")).withColumn("format", E.detect_extension(F.col("path")))


@query(f"""SELECT format, count(*) AS n, CASE format WHEN 'gzip' THEN '.gz' WHEN 'bzip2' THEN '.bz2' WHEN 'xz' THEN '.xz' WHEN 'zstd' THEN '.zst' ELSE '' END AS extension
FROM (SELECT {duck_pick(FORMATS, 'read_no')} AS format FROM reads) GROUP BY format""")
def format_names(spark, d):
    n = reads(spark, d).groupBy(pick(FORMATS, F.col("read_no")).alias("format")).agg(F.count("*").alias("n"))
    return n.withColumn("extension", E.format_extension(F.col("format")))


@query(f"SELECT format, count(*) AS n, format IN ('none', 'gzip') AS supported FROM (SELECT {duck_pick(FORMATS, 'read_no')} AS format FROM reads) GROUP BY format")
def supported_formats(spark, d):
    n = reads(spark, d).groupBy(pick(FORMATS, F.col("read_no")).alias("format")).agg(F.count("*").alias("n"))
    return n.withColumn("supported", E.supported(F.col("format")))


@query("SELECT read_no, concat('@', id, CASE WHEN comment = '' THEN '' ELSE concat(' ', comment) END, chr(10), sequence, chr(10), '+', chr(10), quality, chr(10)) AS record FROM reads")
def render_fastq(spark, d):
    return reads(spark, d).select("read_no", E.render_fastq(*cols()).alias("record"))


BROKEN = """SELECT read_no, CASE WHEN read_no % 11 = 0 THEN '' WHEN read_no % 11 = 1 THEN concat(id, ' x') ELSE id END AS id,
  CASE WHEN read_no % 11 = 2 THEN concat('a', chr(10)) ELSE comment END AS comment,
  CASE WHEN read_no % 11 = 3 THEN '' WHEN read_no % 11 = 4 THEN concat(sequence, 'Z') WHEN read_no % 11 = 5 THEN concat(sequence, chr(10)) ELSE sequence END AS sequence,
  CASE WHEN read_no % 11 = 3 THEN '' WHEN read_no % 11 = 6 THEN concat(quality, ' ') WHEN read_no % 11 IN (4, 5) THEN concat(quality, '!') ELSE quality END AS quality FROM """


def broken(spark, d):
    """Reads of which some break each rule."""
    return spark.sql(BROKEN.replace("FROM ", "FROM {r}"), r=reads(spark, d))


@query(f"""SELECT read_no, length(id) > 0 AND length(sequence) > 0 AND length(sequence) = length(quality) AND NOT regexp_matches(id, '[ \\r\\n]') AND NOT regexp_matches(comment, '[\\r\\n]') AS valid
FROM ({BROKEN} reads)""")
def valid_shape(spark, d):
    return broken(spark, d).select("read_no", E.valid_shape(*cols()).alias("valid"))


@query(f"SELECT read_no, length(id) > 0 AND length(sequence) > 0 AND length(sequence) = length(quality) AS valid FROM ({BROKEN} reads)")
def is_record(spark, d):
    return broken(spark, d).select("read_no", E.is_record(F.col("id"), F.col("sequence"), F.col("quality")).alias("valid"))


@query(f"SELECT read_no, regexp_matches(sequence, '^[{E.IUPAC}]+\\z') AS valid FROM ({BROKEN} reads)")
def valid_iupac(spark, d):
    return broken(spark, d).select("read_no", E.valid_iupac(F.col("sequence")).alias("valid"))


@query(f"SELECT read_no, regexp_matches(quality, '^[!-~]+\\z') AS valid FROM ({BROKEN} reads)")
def valid_quality(spark, d):
    return broken(spark, d).select("read_no", E.valid_quality(F.col("quality")).alias("valid"))


@query("SELECT p, p BETWEEN 1 AND 4 AS valid, count(*) AS n FROM (SELECT read_no % 7 AS p FROM reads) GROUP BY p")
def valid_profile(spark, d):
    return reads(spark, d).groupBy((F.col("read_no") % 7).alias("p")).agg(F.count("*").alias("n")).withColumn("valid", F.col("p").between(1, 4))


@query("""SELECT a.read_no, a.id = b.id AND a.comment = b.comment AND a.sequence = b.sequence AND a.quality = b.quality AS same FROM reads a JOIN mates b USING (read_no)""")
def record_equality(spark, d):
    z = profile.pair_zip(reads(spark, d), mates(spark, d))
    same = F.lit(True)
    for c in RECORD:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_2"))
    return z.select("read_no", same.alias("same"))


TECH = """SELECT read_no, read_no % 4 AS tech, sequence, CASE read_no % 4 WHEN 1 THEN concat('m', id, '/12/0_2000') WHEN 2 THEN concat('m', id, '/12/ccs') ELSE id END AS id,
  CASE WHEN read_no % 4 = 3 AND read_no % 8 = 3 THEN 'RunID=ab ch=7' WHEN read_no % 4 = 3 THEN 'x channel=3' WHEN read_no % 12 = 0 THEN 'HiFi subread' ELSE comment END AS comment FROM """


def decorated(spark, d):
    """Reads with headers of several technologies, in the column tech."""
    return spark.sql(TECH.replace("FROM ", "FROM {r}"), r=reads(spark, d))


FLAGS = f"""flags AS (SELECT read_no, tech, sequence, h LIKE '%runid=%' OR h LIKE '% ch=%' OR h LIKE '%channel=%' AS ont, h LIKE '%/ccs%' OR h LIKE '%hifi%' AS hifi,
  h LIKE '%pacbio%' OR h LIKE '%subread%' OR (id LIKE 'm%' AND length(id) - length(replace(id, '/', '')) >= 2 AND h NOT LIKE '%/ccs%') AS clr
  FROM (SELECT *, lower(concat(id, ' ', comment)) AS h FROM ({TECH} reads))) """


@query(f"SELECT read_no, ont, hifi, clr FROM (WITH {FLAGS} SELECT * FROM flags)")
def header_needles(spark, d):
    ont, hifi, clr = profile.header_flags(F.col("id"), F.col("comment"))
    return decorated(spark, d).select("read_no", ont.alias("ont"), hifi.alias("hifi"), clr.alias("clr"))


@query("SELECT read_no, length(sequence)::BIGINT AS n_bases FROM reads")
def read_length(spark, d):
    return reads(spark, d).select("read_no", F.length("sequence").cast("long").alias("n_bases"))


NUMBER = "read_no * read_no * read_no * (read_no % 5)"


@query(f"""SELECT read_no, v, CASE WHEN v < 128 THEN 1 WHEN v < 16384 THEN 2 WHEN v < 2097152 THEN 3 WHEN v < 268435456 THEN 4 WHEN v < 34359738368 THEN 5
WHEN v < 4398046511104 THEN 6 WHEN v < 562949953421312 THEN 7 ELSE 8 END::INT AS size FROM (SELECT read_no, {NUMBER} AS v FROM reads)""")
def varint_size(spark, d):
    return reads(spark, d).select("read_no", F.expr(NUMBER).alias("v")).withColumn("size", E.varint_size(F.col("v")))


@query(f"""SELECT read_no, upper(array_to_string(list_transform(range(n), lambda i: lpad(to_hex(((v >> (7 * i)::INT) & 127) + CASE WHEN i < n - 1 THEN 128 ELSE 0 END), 2, '0')), '')) AS varint
FROM (SELECT read_no, v, CASE WHEN v < 128 THEN 1 WHEN v < 16384 THEN 2 WHEN v < 2097152 THEN 3 WHEN v < 268435456 THEN 4 WHEN v < 34359738368 THEN 5
WHEN v < 4398046511104 THEN 6 ELSE 7 END AS n FROM (SELECT read_no, {NUMBER} AS v FROM reads))""")
def varint_hex(spark, d):
    return reads(spark, d).select("read_no", E.varint_hex(F.expr(NUMBER)).alias("varint"))


@query(f"SELECT read_no, {NUMBER} AS v FROM reads")
def varint_decode(spark, d):
    """Numbers written as varints one after the other and read again."""

    def run(batches):
        for b in batches:
            data, _ = codec.varints(b.column(1).to_numpy())
            data, at, out = data.tobytes(), 0, []
            while at < len(data):
                v, at = codec.read_varint(data, at)
                out.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], names=["read_no", "v"])

    return reads(spark, d).select("read_no", F.expr(NUMBER).alias("v")).mapInArrow(run, "read_no long, v long")


@query(f"""SELECT read_no, upper(array_to_string(list_transform(range(8), lambda i: lpad(to_hex((v >> (8 * i)::INT) & 255), 2, '0')), '')) AS u64,
upper(array_to_string(list_transform(range(4), lambda i: lpad(to_hex((read_no >> (8 * i)::INT) & 255), 2, '0')), '')) AS u32 FROM (SELECT read_no, {NUMBER} AS v FROM reads)""")
def le_hex(spark, d):
    return reads(spark, d).select("read_no", E.le_hex(F.expr(NUMBER), 8).alias("u64"), E.le_hex(F.col("read_no"), 4).alias("u32"))


@query("SELECT read_no, upper(concat(lpad(to_hex(length(id)), 2, '0'), hex(encode(id)))) AS bytes FROM reads")
def prefixed_string_hex(spark, d):
    return reads(spark, d).select("read_no", E.prefixed_hex(F.col("id")).alias("bytes"))


CODED = "translate(sequence, 'CGTRYSWKMBDHVNacgtryswkmbdhvnA', '123000000000000000000000000000')"
PACKED = f"""packed AS (SELECT read_no, upper(string_agg(lpad(to_hex(b), 2, '0'), '' ORDER BY g)) AS packed FROM (
  SELECT read_no, i // 4 AS g, sum(cast(substr(c, cast(i + 1 AS int), 1) AS int) << cast(2 * (i % 4) AS int))::bigint AS b
  FROM (SELECT read_no, {CODED} AS c, unnest(range(length(sequence))) AS i FROM reads) GROUP BY 1, 2) GROUP BY 1)"""


@query(f", {PACKED} SELECT read_no, packed, ((length(sequence) + 3) // 4)::INT AS size FROM packed JOIN reads USING (read_no)".replace(", packed AS", "", 0))
def pack2bit_hex(spark, d):
    return reads(spark, d).select("read_no", E.pack_hex(F.col("sequence")).alias("packed"), E.packed_size(F.length("sequence")).alias("size"))


@query("SELECT read_no, translate(sequence, 'RYSWKMBDHVNacgtryswkmbdhvn', repeat('A', 26)) AS bases FROM reads")
def unpack2bit(spark, d):
    packed = reads(spark, d).select("read_no", E.pack_hex(F.col("sequence")).alias("p"), F.length("sequence").alias("n"))
    return packed.select("read_no", E.unpack_hex(F.col("p"), F.col("n")).alias("bases"))


EXC = """exc AS (SELECT read_no, i::INT AS pos, b AS base FROM (SELECT read_no, i, substr(sequence, cast(i + 1 AS int), 1) AS b
  FROM (SELECT read_no, sequence, unnest(range(length(sequence))) AS i FROM reads)) WHERE b NOT IN ('A', 'C', 'G', 'T'))"""


@query(f", {EXC} SELECT read_no, pos, base FROM exc")
def exceptions(spark, d):
    return frames.exception_positions(reads(spark, d)).select("read_no", "pos", "base")


@query(f", {EXC} SELECT read_no, pos, (pos - coalesce(lag(pos) OVER (PARTITION BY read_no ORDER BY pos), 0))::INT AS delta FROM exc")
def exception_delta(spark, d):
    return frames.exception_positions(reads(spark, d)).select("read_no", "pos", "delta")


@query(f", {EXC} SELECT read_no, base, pos::BIGINT AS place FROM exc")
def exception_positions(spark, d):
    run = Window.partitionBy("read_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return frames.exception_positions(reads(spark, d)).select("read_no", "base", F.sum("delta").over(run).alias("place"))


@query("SELECT read_no, sequence FROM reads")
def exception_overlay(spark, d):
    """Bases from their packed form with the exceptions laid over them give the sequence again."""
    r = reads(spark, d)
    listed = frames.exception_positions(r).groupBy("read_no").agg(F.map_from_entries(F.collect_list(F.struct("pos", "base"))).alias("e"))
    bases = r.select("read_no", E.unpack_hex(E.pack_hex(F.col("sequence")), F.length("sequence")).alias("bases"))
    laid = F.transform(F.filter(F.split("bases", ""), lambda b: b != ""), lambda b, i: F.coalesce(F.try_element_at("e", i), b))
    return bases.join(listed, "read_no", "left").select("read_no", F.array_join(laid, "").alias("sequence"))


@query(f"SELECT read_no, lower(concat(id, ' ', comment)) AS header FROM ({TECH} reads)")
def lower_header(spark, d):
    return decorated(spark, d).select("read_no", E.lower_ascii(F.concat("id", F.lit(" "), "comment")).alias("header"))


@query("SELECT read_no, (length(id) + length(comment) + length(sequence) + length(quality) + 6 + CASE WHEN comment = '' THEN 0 ELSE 1 END)::BIGINT AS n_bytes FROM reads")
def canonical_bytes(spark, d):
    return reads(spark, d).select("read_no", E.canonical_bytes(*cols()).alias("n_bytes"))


@query("SELECT read_no, (length(id) + length(comment) + length(sequence) + length(quality) + 132)::BIGINT AS n_bytes FROM reads")
def retained_bytes(spark, d):
    return reads(spark, d).select("read_no", E.retained_bytes(*cols()).alias("n_bytes"))


@query(f"SELECT read_no, (length(id) - length(replace(id, '/', '')))::INT AS n FROM ({TECH} reads)")
def slash_count(spark, d):
    return decorated(spark, d).select("read_no", E.count_char(F.col("id"), "/").alias("n"))


@query(f"SELECT name, count(*) AS n, CASE name WHEN 'illumina' THEN 1 WHEN 'ont' THEN 2 WHEN 'pacbio-hifi' THEN 3 WHEN 'pacbio-clr' THEN 4 END::INT AS code FROM (SELECT {duck_pick((*E.PROFILES, 'auto'), 'read_no')} AS name FROM reads) GROUP BY name")
def profile_names(spark, d):
    n = reads(spark, d).groupBy(pick((*E.PROFILES, "auto"), F.col("read_no")).alias("name")).agg(F.count("*").alias("n"))
    return n.withColumn("code", E._map(E.PROFILES, F.col("name"), None).cast("int"))


@query("SELECT code, count(*) AS n, CASE WHEN code = 17 THEN 3 WHEN code BETWEEN 0 AND 5 THEN code ELSE 1 END::INT AS exit_code FROM (SELECT list_extract([0, 1, 2, 3, 4, 5, 17], (read_no % 7 + 1)::INT)::INT AS code FROM reads) GROUP BY code")
def exit_codes(spark, d):
    n = reads(spark, d).groupBy(pick(tuple(E.ERRORS), F.col("read_no")).alias("code")).agg(F.count("*").alias("n"))
    return n.withColumn("exit_code", E._map({k: v[1] for k, v in E.ERRORS.items()}, F.col("code"), 1).cast("int"))


@query("""SELECT read_no, least(536870912, (m - 16777216) // 4)::BIGINT AS max_frame, least(67108864, (m - 16777216) // 8)::BIGINT AS target_frame, least(536870912, (m - 16777216) // 8)::BIGINT AS sample
FROM (SELECT read_no, (64 + read_no) * 1048576 AS m FROM reads)""")
def frame_limits(spark, d):
    m = (F.col("read_no") + 64) * E.MIB
    return reads(spark, d).select("read_no", E.max_frame_bytes(m).alias("max_frame"), E.target_frame_bytes(m, F.lit(64 * E.MIB)).alias("target_frame"), E.sample_limit_bytes(m).alias("sample"))


@query(f"""SELECT *, CASE WHEN n_hifi >= (n_reads + 1) // 2 THEN 'pacbio-hifi' WHEN n_ont >= (n_reads + 1) // 2 THEN 'ont' WHEN n_clr >= (n_reads + 1) // 2 THEN 'pacbio-clr'
WHEN longest <= 1000 AND n_bases // n_reads <= 500 THEN 'illumina' END AS profile FROM (WITH {FLAGS} SELECT tech, count(*) AS n_reads, count(*) FILTER (ont) AS n_ont, count(*) FILTER (hifi) AS n_hifi,
count(*) FILTER (clr) AS n_clr, sum(length(sequence))::BIGINT AS n_bases, max(length(sequence))::BIGINT AS longest FROM flags GROUP BY tech)""")
def detect_profile(spark, d):
    return profile.detect_profile(decorated(spark, d), "tech")


FRAME_READS = 100
VS = lambda x: f"(CASE WHEN {x} < 128 THEN 1 WHEN {x} < 16384 THEN 2 ELSE 3 END)"
SIZES = f"""{EXC}, delta AS (SELECT read_no, count(*) AS e, sum({VS('d')} + 1) AS bytes FROM (SELECT read_no, pos - coalesce(lag(pos) OVER (PARTITION BY read_no ORDER BY pos), 0) AS d FROM exc) GROUP BY read_no),
sizes AS (SELECT read_no // {FRAME_READS} AS frame_id, count(*) AS n_reads, sum(length(sequence))::BIGINT AS bases, sum(length(id) + length(comment) + length(sequence) + length(quality))::BIGINT AS text,
({VS('count(*)')} + sum({VS('length(id)')} + length(id) + {VS('length(comment)')} + length(comment)))::BIGINT AS raw_ids,
({VS('count(*)')} + sum({VS('length(sequence)')} + (length(sequence) + 3) // 4 + {VS('coalesce(e, 0)')} + coalesce(bytes, 0)))::BIGINT AS raw_sequences,
({VS('count(*)')} + sum({VS('length(quality)')} + length(quality)))::BIGINT AS raw_qualities FROM reads LEFT JOIN delta USING (read_no) GROUP BY 1)"""


def sized(spark, d):
    return frames.stream_sizes(reads(spark, d).withColumn("frame_id", F.floor(F.col("read_no") / FRAME_READS)), "frame_id")


@query(f", {SIZES} SELECT frame_id, n_reads, bases, raw_ids, raw_sequences, raw_qualities FROM sizes")
def stream_sizes(spark, d):
    return sized(spark, d).drop("text")


BOUND = lambda x: f"({x} + ({x} >> 8) + CASE WHEN {x} < 131072 THEN (131072 - {x}) >> 11 ELSE 0 END)"


@query(f", {SIZES} SELECT frame_id, (16777216 + 256 * n_reads + text + 4 * n_reads + raw_ids + raw_sequences + raw_qualities + {BOUND('raw_ids')} + {BOUND('raw_sequences')} + {BOUND('raw_qualities')})::BIGINT AS peak FROM sizes")
def compress_peak(spark, d):
    s = sized(spark, d)
    return s.select("frame_id", frames.compress_peak(s).alias("peak"))


@query(f", {SIZES} SELECT frame_id, (16777216 + 256 * n_reads + 2 * (raw_ids + raw_sequences + raw_qualities) + n_reads * 40)::BIGINT AS peak FROM sizes")
def decompress_peak(spark, d):
    raw = F.col("raw_ids") + F.col("raw_sequences") + F.col("raw_qualities")
    return sized(spark, d).select("frame_id", frames.decompress_peak(F.col("n_reads"), raw, F.col("n_reads") * 40).alias("peak"))


@query(f"SELECT count(DISTINCT read_no // {FRAME_READS}) AS frames, count(*) AS records, sum(length(sequence))::BIGINT AS bases, sum(length(id) + length(comment) + length(sequence) + length(quality) + 6 + CASE WHEN comment = '' THEN 0 ELSE 1 END)::BIGINT AS logical_bytes FROM reads")
def archive_stats(spark, d):
    per = reads(spark, d).groupBy(F.floor(F.col("read_no") / FRAME_READS).alias("f")).agg(F.count("*").alias("n"), F.sum(F.length("sequence")).alias("b"), F.sum(E.canonical_bytes(*cols())).alias("l"))
    return per.agg(F.count("*").alias("frames"), F.sum("n").alias("records"), F.sum("b").alias("bases"), F.sum("l").alias("logical_bytes"))


@query(f", {SIZES} SELECT 'illumina' AS profile, count(*) AS frames, sum(n_reads)::BIGINT AS records, sum(bases)::BIGINT AS bases, (72 + sum(72 + raw_ids + raw_sequences + raw_qualities))::BIGINT AS raw_archive_bytes FROM sizes")
def operation_stats(spark, d):
    """Totals of an archive whose streams would be stored as they are."""
    total = sized(spark, d).agg(F.count("*").alias("frames"), F.sum("n_reads").alias("records"), F.sum("bases").alias("bases"), (72 + F.sum(72 + F.col("raw_ids") + F.col("raw_sequences") + F.col("raw_qualities"))).alias("raw_archive_bytes"))
    return total.crossJoin(profile.detect_profile(reads(spark, d)).select("profile"))


@query("SELECT a.read_no, a.id AS id_1, b.id AS id_2, a.sequence AS sequence_1, b.sequence AS sequence_2 FROM reads a JOIN mates b USING (read_no)")
def pair_zip(spark, d):
    z = profile.pair_zip(reads(spark, d), mates(spark, d))
    return z.select("read_no", F.col("id").alias("id_1"), "id_2", F.col("sequence").alias("sequence_1"), "sequence_2")


@query("SELECT count(*) AS unpaired FROM reads a FULL JOIN (SELECT * FROM mates WHERE read_no % 100 <> 7) b USING (read_no) WHERE a.id IS NULL OR b.id IS NULL")
def pair_mismatch(spark, d):
    z = profile.pair_zip(reads(spark, d), mates(spark, d).where("read_no % 100 <> 7"))
    return profile.unpaired(z).agg(F.count("*").alias("unpaired"))


@query("SELECT 2 * read_no AS read_no, id, comment, sequence, quality FROM reads UNION ALL SELECT 2 * read_no + 1, id, comment, sequence, quality FROM mates")
def interleave(spark, d):
    return profile.interleave(profile.pair_zip(reads(spark, d), mates(spark, d)))


@query("SELECT read_no, bases_before FROM (SELECT read_no, coalesce(sum(length(sequence)) OVER (ORDER BY read_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bases_before FROM (SELECT * FROM reads ORDER BY read_no LIMIT 50000)) WHERE bases_before < 100000")
def profile_sample(spark, d):
    return profile.profile_sample(reads(spark, d), 100_000).select("read_no", "bases_before")


TARGET = 600


@query(f""", RECURSIVE_MARK
sz AS (SELECT row_number() OVER (ORDER BY read_no) AS k, read_no, length(id) + length(comment) + length(sequence) + length(quality) + 132 AS b FROM reads),
walk AS (SELECT k, read_no, 0::BIGINT AS frame_id, b AS held FROM sz WHERE k = 1 UNION ALL
  SELECT sz.k, sz.read_no, CASE WHEN held >= {TARGET} THEN frame_id + 1 ELSE frame_id END, CASE WHEN held >= {TARGET} THEN b ELSE held + b END FROM walk JOIN sz ON sz.k = walk.k + 1)
SELECT read_no, frame_id FROM walk""")
def assign_frames(spark, d):
    return frames.assign_frames(reads(spark, d), TARGET).select("read_no", "frame_id")


@query(f"SELECT frame_id, frame_id = row_number() OVER (ORDER BY frame_id) - 1 AS in_order FROM (SELECT DISTINCT read_no // {FRAME_READS} AS frame_id FROM reads)")
def frame_id_check(spark, d):
    ids = reads(spark, d).select(F.floor(F.col("read_no") / FRAME_READS).alias("frame_id")).distinct()
    return ids.withColumn("in_order", F.col("frame_id") == F.row_number().over(Window.orderBy("frame_id")) - 1)


@query("SELECT event_type, median(value) AS middle FROM events GROUP BY event_type")
def median_repeat(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").groupBy("event_type").agg(F.median("value").alias("middle"))


def framed(spark, d):
    return frames.assign_frames(reads(spark, d), 64 << 10)


@query()
def frame_checksum(spark, d):
    return archive.encode_frames(framed(spark, d)).select("frame_id", "record_count", "checksum")


@query()
def rolling_checksum(spark, d):
    return archive.totals(archive.encode_frames(framed(spark, d)))


@query("SELECT read_no, id, comment, sequence, quality FROM reads")
def roundtrip_frames(spark, d):
    """Reads encoded to frames and decoded again; read_no is counted within the archive and so made anew."""
    back = archive.decode_frames(archive.encode_frames(framed(spark, d)))
    start = reads(spark, d).agg(F.min("read_no").alias("first"))
    return back.crossJoin(start).select((F.col("frame_first") + F.col("frame_pos") + F.col("first")).alias("read_no"), *RECORD)


@query()
def zstd_ratio(spark, d):
    e = archive.encode_frames(framed(spark, d))
    return e.agg(F.sum(F.col("raw_ids") + F.col("raw_seq") + F.col("raw_qual")).alias("raw"), F.sum(F.col("enc_ids") + F.col("enc_seq") + F.col("enc_qual")).alias("encoded"))


# Queries over files: the reads are written by the engine's own sinks and read by its sources


def written_fastq(spark, rows, name: str) -> str:
    """One FASTQ file of the rows in the order of read_no."""
    register(spark)
    path = f"{scratch(spark)}/{name}.fastq"
    rows.orderBy("read_no").select(F.lit(0).alias("file_no"), "read_no", *RECORD).write.format("fastq").mode("append").save(path)
    return path


def written_archive(spark, d, paired: bool = False) -> str:
    source = written_fastq(spark, reads(spark, d), "reads")
    mate = written_fastq(spark, mates(spark, d), "mates") if paired else None
    target = f"{scratch(spark)}/reads.arc"
    commands.compress(spark, source, target, mate=mate, profile="illumina", frame_mib=1)
    return target


def load(spark, kind: str, path: str):
    register(spark)
    return spark.read.format(kind).load(path).select("read_no", *RECORD)


NUMBERED = "SELECT row_number() OVER (ORDER BY read_no) - 1 AS read_no, id, comment, sequence, quality FROM reads"


@query(NUMBERED)
def fastq_scan(spark, d):
    """A FASTQ file written and parsed: records, order and counters."""
    return load(spark, "fastq", written_fastq(spark, reads(spark, d), "reads"))


@query(NUMBERED)
def fastq_parts_scan(spark, d):
    """A folder of parts in their order, read like one file."""
    register(spark)
    path = f"{scratch(spark)}/parts"
    reads(spark, d).orderBy("read_no").select(F.lit(0).alias("file_no"), "read_no", *RECORD).write.format("fastq").mode("append").option("layout", "parts").save(path)
    return load(spark, "fastq", path)


@query("SELECT id, comment, sequence, quality FROM reads")
def gzip_scan(spark, d):
    """Compressed FASTQ files with Windows line ends."""
    register(spark)
    path = f"{scratch(spark)}/gzip"
    text = F.replace(E.render_fastq(*cols()), F.lit("\n"), F.lit("\r\n"))
    reads(spark, d).select(text.alias("value")).write.option("compression", "gzip").text(path)
    names = [r.p for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select(F.col("path").alias("p")).orderBy("p").collect()]
    return spark.read.format("fastq").load(",".join(names)).select(*RECORD)


@query(NUMBERED)
def gzip_members(spark, d):
    """A file of several gzip members, which is the text of all of them."""
    source, path = written_fastq(spark, reads(spark, d), "reads"), f"{scratch(spark)}/members.gz"
    fs, name = locate(source)
    with fs.open_input_file(name) as f, fs.open_output_stream(locate(path)[1], compression=None) as out:
        while data := f.read(1 << 16):
            out.write(gzip.compress(data))
    return load(spark, "fastq", path)


@query("SELECT id, comment, sequence, quality FROM reads")
def arrivals(spark, d):
    """Files that arrive in a folder become an archive each."""
    register(spark)
    folder, output, state = scratch(spark), scratch(spark), scratch(spark)
    for i in range(3):
        part = reads(spark, d).where(f"read_no % 3 = {i}").orderBy("read_no").select(F.lit(0).alias("file_no"), "read_no", *RECORD)
        part.write.format("fastq").mode("append").save(f"{folder}/{i}.fastq")
    archive_arrivals(spark, folder, output, state, profile="illumina").awaitTermination()
    found = [spark.read.format("readframes").load(f"{output}/{i}.fastq.arc").select(*RECORD) for i in range(3)]
    return functools.reduce(DataFrame.unionByName, found)


@query("SELECT 'illumina' AS profile, count(*) AS records FROM reads")
def detected_profile(spark, d):
    """The profile that an archive gets from the first reads of its file."""
    source, target = written_fastq(spark, reads(spark, d), "reads"), f"{scratch(spark)}/reads.arc"
    commands.compress(spark, source, target)
    a = inspect(target)
    return spark.createDataFrame([(a.profile, a.records)], "profile string, records long")


@query(NUMBERED)
def archive_scan(spark, d):
    """An archive written and read as a table."""
    return load(spark, "readframes", written_archive(spark, d))


@query(NUMBERED)
def restored_reads(spark, d):
    """An archive restored to FASTQ, and that parsed."""
    source, target = written_archive(spark, d), f"{scratch(spark)}/back.fastq"
    commands.decompress(spark, source, target)
    return load(spark, "fastq", target)


@query("""SELECT row_number() OVER (ORDER BY read_no, mate) - 1 AS read_no, id, comment, sequence, quality
FROM (SELECT *, 0 AS mate FROM reads UNION ALL SELECT *, 1 AS mate FROM mates)""")
def paired_archive_scan(spark, d):
    """An archive of two files of mates."""
    return load(spark, "readframes", written_archive(spark, d, paired=True))


WALK = """, RECURSIVE_MARK
sz AS (SELECT row_number() OVER (ORDER BY read_no) AS k, read_no, length(id) + length(comment) + length(sequence) + length(quality) + 132 AS b FROM reads),
walk AS (SELECT k, read_no, 0::BIGINT AS frame_id, b AS held FROM sz WHERE k = 1 UNION ALL
  SELECT sz.k, sz.read_no, CASE WHEN held >= TARGET THEN frame_id + 1 ELSE frame_id END, CASE WHEN held >= TARGET THEN b ELSE held + b END FROM walk JOIN sz ON sz.k = walk.k + 1)"""
MIB_WALK = WALK.replace("TARGET", "1048576")
RAW_SIZES = f"""SELECT frame_id, count(*) AS record_count, ({VS('count(*)')} + sum({VS('length(id)')} + length(id) + {VS('length(comment)')} + length(comment)))::BIGINT AS raw_ids,
({VS('count(*)')} + sum({VS('length(quality)')} + length(quality)))::BIGINT AS raw_qual FROM walk JOIN reads USING (read_no) GROUP BY frame_id"""


@query(f"""{MIB_WALK} SELECT 'illumina' AS profile, false AS paired, count(DISTINCT frame_id) AS frames, count(*) AS records, sum(length(sequence))::BIGINT AS bases
FROM walk JOIN reads USING (read_no)""")
def archive_footer(spark, d):
    """What header and footer of an archive say."""
    a = inspect(written_archive(spark, d))
    return spark.createDataFrame([(a.profile, a.paired, len(a.headers), a.records, a.bases)], "profile string, paired boolean, frames long, records long, bases long")


@query(f"{MIB_WALK} {RAW_SIZES}")
def frame_headers(spark, d):
    """What the headers of an archive's frames say."""
    rows = [(h.frame_id, h.record_count, h.raw_ids, h.raw_qual) for _, h in inspect(written_archive(spark, d)).headers]
    return spark.createDataFrame(rows, "frame_id long, record_count long, raw_ids long, raw_qual long")


@query("SELECT count(*) AS records, sum(length(sequence))::BIGINT AS bases, sum(length(id) + length(comment) + length(sequence) + length(quality) + 6 + CASE WHEN comment = '' THEN 0 ELSE 1 END)::BIGINT AS text_bytes FROM reads")
def verify_totals(spark, d):
    """Totals of an archive of which every frame was checked and decoded."""
    s = commands.verify(spark, written_archive(spark, d))
    return spark.createDataFrame([(s.records, s.bases, s.output_bytes)], "records long, bases long, text_bytes long")


@query(f"{WALK.replace('TARGET', '65536')} {RAW_SIZES}")
def zstd_streams(spark, d):
    """Streams compressed and inflated again, as long as they were."""

    def inflate(batches):
        for b in batches:
            rows = b.to_pylist()
            sizes = [[len(codec.decompress(r[c], r[f"raw_{n}"])) for r in rows] for c, n in (("ids", "ids"), ("quals", "qual"))]
            yield pa.RecordBatch.from_arrays([b.column("frame_id"), b.column("record_count"), *(pa.array(x, pa.int64()) for x in sizes)], names=["frame_id", "record_count", "raw_ids", "raw_qual"])

    return archive.encode_frames(framed(spark, d)).mapInArrow(inflate, "frame_id long, record_count long, raw_ids long, raw_qual long")


@query(f"{MIB_WALK} SELECT count(DISTINCT frame_id) AS frames, true AS holds, 1::BIGINT AS found FROM walk")
def archive_checksums(spark, d):
    """The checksums of header, frames and footer hold, and one that is wrong is found."""
    path = written_archive(spark, d)
    a = inspect(path)
    rows = [archive.signed(h.checksum) for _, h in a.headers]
    rolling = functools.reduce(lambda g, c: codec.advance(g, archive.unsigned(c)), rows, 0)
    fs, name = locate(path)
    with fs.open_input_file(name) as f:
        data = bytearray(f.read(codec.HEADER_SIZE))
    holds = codec.parse_header(bytes(data)) == (a.profile, a.paired) and rolling == a.rolling
    data[-1] ^= 1
    try:
        codec.parse_header(bytes(data))
        found = 0
    except errors.ChecksumError:
        found = 1
    return spark.createDataFrame([(len(rows), holds, found)], "frames long, holds boolean, found long")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile and archive totals of all reads."""
    return archive_stats(spark, sf_dir).crossJoin(profile.detect_profile(reads(spark, sf_dir)).select("profile"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v.replace("WITH reads", "WITH RECURSIVE reads", 1).replace(") , RECURSIVE_MARK", "),") if "RECURSIVE_MARK" in v else v.replace(") , ", "), ", 1) for k, v in _ORACLES.items()}
