from __future__ import annotations

import dataclasses
import gzip
import io
import logging
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from strandlake import cli
from strandlake.functions import codec as C
from strandlake.functions.errors import ChecksumError, FormatError, InputOutputError, UnsupportedError, UsageError
from strandlake.operators.frames import Cutter, assign_frames
from strandlake.plans import commands
from strandlake.sources import fastq as source
from strandlake.sources import register, storage
from strandlake.sources.fastq import parse


def fastq(n, seed=1, name="read"):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        k = r.randint(1, 90)
        comment = f" c {i}" if i % 3 == 0 else ""
        rows.append(f"@{name}{i}{comment}\n{''.join(r.choices('ACGTNacgtRY', k=k))}\n+\n{''.join(chr(r.randint(33, 126)) for _ in range(k))}\n")
    return "".join(rows)


def rows_of(data: bytes):
    return [tuple(r.values())[2:] for b in parse(io.BufferedReader(io.BytesIO(data))) for r in b.to_pylist()]


def test_parser_accepts():
    assert rows_of(b"") == []
    assert rows_of(b"\n\n@a b c\nAC\n+x\n!!\n\n@d\nN\n+\n@") == [("a", "b c", "AC", "!!"), ("d", "", "N", "@")]
    assert rows_of(b"@a \r\nAC\r\n+\r\n!!\r\n") == [("a", "", "AC", "!!")]
    assert rows_of(b"@a\tb\nAC\n+\n!!\n") == [("a\tb", "", "AC", "!!")]
    assert rows_of("@ä\nAC\n+\n!!\n".encode("latin-1")) == [("ä", "", "AC", "!!")]


@pytest.mark.parametrize("data", [b"a\nAC\n+\n!!\n", b"@a\nAC\n+\n!\n", b"@a\nAC\n", b"@a\nAC\n-\n!!\n", b"@ x\nAC\n+\n!!\n", b"@a\n\n+\n\n", b"@a\nA\nC\n+\n!!\n"])
def test_parser_rejects(data):
    with pytest.raises(FormatError, match="line"):
        rows_of(data)


def test_detection():
    assert [storage.detect(bytes.fromhex(h)) for h in ("1f8b08", "425a68", "fd377a585a00", "28b52ffd", "4041")] == ["gzip", "bzip2", "xz", "zstd", "none"]
    assert [storage.detect(b"", p) for p in ("a.GZ", "a.bzip2", "a.lzma", "a.zst", "a", "x.d/y")] == ["gzip", "bzip2", "xz", "zstd", "none", "none"]


@pytest.mark.parametrize("paired", [False, True])
def test_cutter_is_the_plain_loop(paired):
    r = np.random.default_rng(3)
    sizes = r.integers(1, 300, 500)
    want, frame, held, count = [], 0, 0, 0
    for s in sizes:
        want.append(frame)
        held, count = held + s, count + 1
        if held >= 600 and (not paired or count % 2 == 0):
            frame, held, count = frame + 1, 0, 0
    cutter, got, at = Cutter(600, paired), [], 0
    while at < len(sizes):
        n = int(r.integers(1, 40))
        got += cutter.cut(sizes[at : at + n]).tolist()
        at += n
    assert got == want


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("archive")
    text = fastq(400)
    (d / "a.fastq").write_text(text)
    with open(d / "a.fastq.gz", "wb") as f:
        f.write(gzip.compress(text[: text.index("@read200")].encode()) + gzip.compress(text[text.index("@read200") :].encode()))
    stats = commands.compress(spark, str(d / "a.fastq"), str(d / "a.arc"), profile=None)
    return d, text, stats


def test_round_trip(spark, made):
    d, text, stats = made
    assert (stats.profile, stats.paired, stats.records) == ("illumina", False, 400)
    assert stats.input_bytes == len(text) and stats.output_bytes == (d / "a.arc").stat().st_size
    back = commands.decompress(spark, str(d / "a.arc"), str(d / "b.fastq"))
    assert (d / "b.fastq").read_text() == text and back.output_bytes == len(text)
    assert commands.verify(spark, str(d / "a.arc")).bases == stats.bases
    commands.compress(spark, str(d / "a.fastq.gz"), str(d / "c.arc"))
    assert (d / "c.arc").read_bytes() == (d / "a.arc").read_bytes()
    (d / "a.arc.gz").write_bytes(gzip.compress((d / "a.arc").read_bytes()))
    assert commands.verify(spark, str(d / "a.arc.gz")).records == 400
    assert not [p for p in d.iterdir() if ".tmp." in p.name]


def test_corruption(spark, made):
    d, _, _ = made
    good = (d / "a.arc").read_bytes()
    cases = {"header checksum": (24, ChecksumError), "codec": (17, UnsupportedError), "magic": (0, FormatError), "frame id": (40, FormatError), "frame checksum": (32 + 64, ChecksumError), "payload": (32 + 72 + 12, (FormatError, ChecksumError)), "footer totals": (len(good) - 32, FormatError), "footer checksum": (len(good) - 1, ChecksumError)}
    for name, (at, error) in cases.items():
        bad = bytearray(good)
        bad[at] ^= 0x7F
        (d / "bad.arc").write_bytes(bad)
        with pytest.raises(error):
            commands.verify(spark, str(d / "bad.arc"))
            pytest.fail(name)
    for data in (b"", good[:-1], good + b"\0", good[:100]):
        (d / "bad.arc").write_bytes(data)
        with pytest.raises(FormatError):
            commands.decompress(spark, str(d / "bad.arc"), str(d / "never.fastq"))
    assert not (d / "never.fastq").exists()


def test_pairs(spark, tmp_path):
    (tmp_path / "1.fq").write_text(fastq(6, 1, "x"))
    (tmp_path / "2.fq").write_text(fastq(6, 2, "y"))
    stats = commands.compress(spark, str(tmp_path / "1.fq"), str(tmp_path / "p.arc"), mate=str(tmp_path / "2.fq"), profile="ont")
    assert (stats.paired, stats.records, stats.profile) == (True, 12, "ont")
    commands.decompress(spark, str(tmp_path / "p.arc"), str(tmp_path / "p.fq"))
    names = (tmp_path / "p.fq").read_text().split("\n")[0::4]
    assert [n[:3] for n in names if n] == [f"@{m}{i}" for i in range(6) for m in "xy"]
    (tmp_path / "2.fq").write_text(fastq(5, 2, "y"))
    with pytest.raises(FormatError):
        commands.compress(spark, str(tmp_path / "1.fq"), str(tmp_path / "q.arc"), mate=str(tmp_path / "2.fq"))
    assert not (tmp_path / "q.arc").exists()


def test_faults(spark, tmp_path):
    a, b = str(tmp_path / "a.fq"), str(tmp_path / "b.arc")
    (tmp_path / "a.fq").write_text("@a\nAZ\n+\n!!\n")
    with pytest.raises(UsageError):
        commands.compress(spark, a, b, profile="ont")
    (tmp_path / "a.fq").write_text(fastq(3))
    for call, error in ((lambda: commands.compress(spark, a, b, memory_mib=63), UsageError), (lambda: commands.compress(spark, a, a), UsageError), (lambda: commands.compress(spark, a, b, profile="auto"), UsageError), (lambda: commands.compress(spark, a, b, frame_mib=0), UsageError)):
        with pytest.raises(error):
            call()
    (tmp_path / "t.fq.gz").write_bytes(gzip.compress(fastq(50).encode())[:-20])
    with pytest.raises(InputOutputError):
        commands.compress(spark, str(tmp_path / "t.fq.gz"), b)
    (tmp_path / "z.fq").write_bytes(b"BZh91AY")
    with pytest.raises(InputOutputError):
        commands.compress(spark, str(tmp_path / "z.fq"), b)
    commands.compress(spark, a, b)
    with pytest.raises(InputOutputError):
        commands.compress(spark, a, b)
    commands.compress(spark, a, b, force=True)


def test_command_line(spark, tmp_path, caplog):
    a, b, c = (str(tmp_path / x) for x in ("a.fq", "b.arc", "c.fq"))
    (tmp_path / "a.fq").write_text("")
    assert cli.main(["compress", "-i", a, "-o", b, "-q"], spark) == 0
    assert (tmp_path / "b.arc").stat().st_size == 72
    assert cli.main(["x", "-i", b, "-o", c], spark) == 0 and (tmp_path / "c.fq").read_bytes() == b""
    assert cli.main(["v", b, "--memory-limit", "64"], spark) == 0
    assert cli.main(["verify", "-i", str(tmp_path / "none")], spark) == 2
    assert cli.main([], spark) == 1 and cli.main(["compress", "-i", a], spark) == 1
    assert cli.main(["compress", "-i", "-", "-2", "-", "-o", b], spark) == 1
    assert cli.main(["verify", a], spark) == 3
    assert cli.main(["--version"], spark) == 0


def test_pipes(spark, tmp_path):
    """Standard input and output, through a folder that executors share."""
    text = fastq(30)
    out, back = io.BytesIO(), io.BytesIO()
    args = cli.parser().parse_args(["compress", "-i", "-", "-o", "-", "-q"])
    cli.run(args, spark, io.BytesIO(text.encode()), out)
    cli.run(cli.parser().parse_args(["decompress", "-i", "-", "-o", "-", "-q"]), spark, io.BytesIO(out.getvalue()), back)
    assert back.getvalue().decode() == text


def test_level_names():
    records = [logging.LogRecord("x", n, "", 0, "m", None, None) for n in (10, 20, 30, 40)]
    assert [cli.Short("%(levelname)s").format(r) for r in records] == ["DBG", "INF", "WRN", "ERR"]


@pytest.mark.parametrize("frame", [1, 3])
def test_many_frames(spark, tmp_path, frame, monkeypatch):
    """Frames over several chunks of a file, plain, compressed, with blank lines, and of mates: the same archive."""
    from strandlake.sources import fastq as source

    text, other = fastq(9000), fastq(9000, 2, "mate")
    blank = text.replace("\n@read4000", "\n\n\n@read4000").replace("\n", "\r\n")
    (tmp_path / "a.fq").write_text(text)
    (tmp_path / "a.fq.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "blank.fq").write_text(blank)
    (tmp_path / "b.fq").write_text(other.rstrip("\n"))
    monkeypatch.setattr(source, "CHUNK", 1 << 16)
    made = [commands.compress(spark, str(tmp_path / p), str(tmp_path / f"{p}.arc"), frame_mib=frame) for p in ("a.fq", "a.fq.gz", "blank.fq")]
    assert made[0] == made[1] and made[0].frames > 1 / frame and made[0].input_bytes == len(text)
    assert len({(tmp_path / f"{p}.arc").read_bytes() for p in ("a.fq", "a.fq.gz", "blank.fq")}) == 1
    commands.decompress(spark, str(tmp_path / "a.fq.arc"), str(tmp_path / "back.fq"))
    assert (tmp_path / "back.fq").read_text() == text
    pairs = commands.compress(spark, str(tmp_path / "a.fq.gz"), str(tmp_path / "p.arc"), mate=str(tmp_path / "b.fq"), frame_mib=frame)
    assert pairs.records == 18_000 and pairs.frames > made[0].frames
    commands.decompress(spark, str(tmp_path / "p.arc"), str(tmp_path / "p.fq"))
    back = parse(io.BufferedReader(io.BytesIO((tmp_path / "p.fq").read_bytes())))
    rows = [r for b in back for r in b.to_pylist()]
    assert [r["id"] for r in rows[0::2]] == [f"read{i}" for i in range(9000)] and [r["id"] for r in rows[1::2]] == [f"mate{i}" for i in range(9000)]


@pytest.mark.parametrize("size", [700, 5000, 40_000])
def test_ranges_of_a_file(spark, tmp_path, monkeypatch, size):
    """Ranges that begin anywhere in a record are measured like the whole file; faults keep their line."""
    from strandlake.plans import transfer

    text, other = fastq(700), fastq(700, 2, "mate")
    (tmp_path / "a.fq").write_text(text)
    (tmp_path / "b.fq").write_text(other)
    names = [str(tmp_path / n) for n in ("a.fq", "b.fq")]
    commands.compress(spark, names[0], str(tmp_path / "one.arc"), profile="ont", frame_mib=1)
    commands.compress(spark, names[0], str(tmp_path / "two.arc"), mate=names[1], profile="ont", frame_mib=1)
    monkeypatch.setattr(transfer, "RANGE", size)
    assert transfer.measured_ranges(spark, names) is not None
    commands.compress(spark, names[0], str(tmp_path / "one-r.arc"), profile="ont", frame_mib=1)
    commands.compress(spark, names[0], str(tmp_path / "two-r.arc"), mate=names[1], profile="ont", frame_mib=1)
    for n in ("one", "two"):
        assert (tmp_path / f"{n}.arc").read_bytes() == (tmp_path / f"{n}-r.arc").read_bytes()
    lines = text.split("\n")
    for at, line in ((1602, "-"), (2000, "read"), (2401, lines[2401] + "A")):
        bad = "\n".join([*lines[:at], line, *lines[at + 1 :]])
        (tmp_path / "bad.fq").write_text(bad)
        with pytest.raises(FormatError, match=f"line {at + 1 + 2 * (at % 4 == 1)}:"):
            commands.compress(spark, str(tmp_path / "bad.fq"), str(tmp_path / "never"), profile="ont")
    (tmp_path / "crlf.fq").write_bytes(text.replace("\n", "\r\n").encode())
    assert transfer.measured_ranges(spark, [str(tmp_path / "crlf.fq")]) is None
    (tmp_path / "short.fq").write_text(fastq(600, 2, "mate"))
    with pytest.raises(FormatError, match="different record counts"):
        commands.compress(spark, names[0], str(tmp_path / "never"), mate=str(tmp_path / "short.fq"), profile="ont")


@pytest.mark.parametrize("size", [1, 60, 700, 1 << 20])
def test_frames_are_encoded_in_slices(monkeypatch, size):
    """Slices of any size make the frame that all records at once make; so do those of mates, which differ in length."""
    from strandlake.plans.transfer import mated

    monkeypatch.setattr(source, "SLICE", size)
    a, b, short = fastq(300).encode(), fastq(300, 2, "mate").encode(), fastq(200, 2, "mate").encode()
    slices = lambda x: source.slices_of(lambda at, n: x[at : at + n], len(x))
    for lanes, whole in (([a], source.records_of(a)), ([a, b], C.Records.mates(source.records_of(a), source.records_of(b)))):
        h, bases, text, streams = C.encode_slices(5, mated([slices(x) for x in lanes]))
        assert (h, bases, *streams) == C.encode_frame(5, whole) and text == whole.text_bytes()
    with pytest.raises(FormatError, match="different record counts"):
        list(mated([slices(a), slices(short)]))
    with pytest.raises(FormatError, match="inside a record"):
        list(slices(a[:-1]))


def test_memory_of_a_frame(tmp_path):
    """A frame is encoded in the memory of its streams and of a slice, not in many times its text."""
    from strandlake.plans.transfer import mated, records_in

    data = fastq(1000).encode() * 80
    (tmp_path / "a.fq").write_bytes(data)
    tracemalloc.start()
    try:
        h, *_ = C.encode_slices(0, mated([records_in(str(tmp_path / "a.fq"), [{"at": 0, "n": len(data), "data": None}], {})]))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        assert C.encode_frame(0, source.records_of(data))[0] == h
        assert most < 3 * len(data) < tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_rows_are_made_one_at_a_time():
    """Of a batch of large rows only the one in use is held as a Python object too."""
    from strandlake.plans.transfer import rows_in

    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array([bytes(100_000)] * 50)], names=["i", "data"])
    tracemalloc.start()
    try:
        assert [r["i"] for r in rows_in([batch, batch])] == [*range(50), *range(50)]
        assert tracemalloc.get_traced_memory()[1] < 1_000_000
    finally:
        tracemalloc.stop()


def test_parts_are_joined_by_executors(spark, made, tmp_path, monkeypatch):
    from strandlake.plans import transfer

    d, text, _ = made
    monkeypatch.setattr(transfer, "JOINED", 0)
    commands.compress(spark, str(d / "a.fastq"), str(tmp_path / "a.arc"))
    assert (tmp_path / "a.arc").read_bytes() == (d / "a.arc").read_bytes()
    commands.decompress(spark, str(tmp_path / "a.arc"), str(tmp_path / "b.fastq"))
    assert (tmp_path / "b.fastq").read_text() == text


def rewritten(good: bytes, **fields) -> bytes:
    """An archive whose first frame header has other fields, with checksums that fit."""
    at = C.HEADER_SIZE
    h = C.parse_frame_header(good[at : at + C.FRAME_HEADER_SIZE], 0, False)
    h = dataclasses.replace(h, **fields)
    rest = good[at + C.FRAME_HEADER_SIZE : -C.FOOTER_SIZE]
    tail = list(C.FOOTER.unpack(good[-C.FOOTER_SIZE :]))
    tail[3] = fields.get("record_count", tail[3])
    return good[:at] + h.pack() + rest + C.FOOTER.pack(*tail)


@pytest.mark.parametrize("fields", [{"raw_ids": 1 << 40}, {"raw_seq": (1 << 29) + 1}, {"enc_qual": 1 << 40}, {"record_count": 0}, {"record_count": 399}, {"record_count": (1 << 32) - 1}, {"raw_ids": 1}, {"raw_seq": 1}, {"raw_qual": 1}, {"frame_id": 1}])
def test_hostile_frame_headers(spark, made, tmp_path, fields):
    """Sizes and counts that headers claim are tested before anything is allocated for them."""
    d, _, _ = made
    (tmp_path / "bad.arc").write_bytes(rewritten((d / "a.arc").read_bytes(), **fields))
    with pytest.raises((FormatError, ChecksumError)):
        commands.decompress(spark, str(tmp_path / "bad.arc"), str(tmp_path / "never"), memory_mib=1024)
    assert [p.name for p in tmp_path.iterdir()] == ["bad.arc"]


def test_odd_paired_frames(spark, made, tmp_path):
    d, _, _ = made
    good = rewritten((d / "a.arc").read_bytes(), record_count=399)
    (tmp_path / "bad.arc").write_bytes(C.header("illumina", True) + good[C.HEADER_SIZE :])
    with pytest.raises(FormatError, match="odd"):
        commands.verify(spark, str(tmp_path / "bad.arc"))


def test_every_region_is_protected(spark, made, tmp_path):
    """A flipped byte in any part of the archive is found; nothing is published."""
    d, _, _ = made
    good = (d / "a.arc").read_bytes()
    h = C.parse_frame_header(good[32:104], 0, False)
    ends = np.cumsum([C.HEADER_SIZE, C.FRAME_HEADER_SIZE, h.enc_ids, h.enc_seq, h.enc_qual, C.FOOTER_SIZE])
    assert ends[-1] == len(good)
    for a, z in zip(np.append(0, ends), ends):
        for at in {a, (a + z) // 2, z - 1}:
            bad = bytearray(good)
            bad[at] ^= 1
            (tmp_path / "bad.arc").write_bytes(bad)
            with pytest.raises((FormatError, ChecksumError, UnsupportedError)):
                commands.verify(spark, str(tmp_path / "bad.arc"))
                pytest.fail(f"byte {at}")


def test_sizes_fit_64_bits(spark, tmp_path):
    (tmp_path / "a.fq").write_text(fastq(3))
    for kind in ({"frame_mib": 1 << 44}, {"memory_mib": 1 << 44}):
        with pytest.raises(UsageError):
            commands.compress(spark, str(tmp_path / "a.fq"), str(tmp_path / "b.arc"), **kind)


def test_frames_of_several_files(spark):
    """Each file's reads are numbered by its own frames, as the plain loop does."""
    r = random.Random(5)
    rows = [(f, i, f"r{i}", "", "A" * (k := r.randint(1, 60)), "!" * k) for f in ("x", "y", None) for i in range(200)]
    reads = spark.createDataFrame(rows, "file string, read_no long, id string, comment string, sequence string, quality string")
    got = {(x.file, x.read_no): x.frame_id for x in assign_frames(reads, 900, file_col="file").collect()}
    for f in ("x", "y", None):
        frame = held = 0
        for _, i, name, _, s, q in [x for x in rows if x[0] == f]:
            assert got[f, i] == frame
            held += 132 + len(name) + len(s) + len(q)
            if held >= 900:
                frame, held = frame + 1, 0
    assert assign_frames(reads.limit(0), 900).count() == 0


def test_tables_of_several_archives(spark, made):
    """Frames of many archives in one table: each is decoded, numbered and totalled by itself."""
    from pyspark.sql import functions as F

    from strandlake.plans import archive
    from strandlake.sources.frames import inspect

    d, _, _ = made
    register(spark)
    reads = spark.read.format("fastq").load(str(d / "a.fastq")).drop("file_no")
    encoded = archive.encode_frames(assign_frames(reads, 20_000))
    both = encoded.withColumn("name", F.lit("x")).unionByName(encoded.where("frame_id < 2").withColumn("name", F.lit("y")))
    got = {(r.name, r.frame_first + r.frame_pos): r.id for r in archive.decode_frames(both, "name").collect()}
    assert {k: v for k, v in got.items() if k[0] == "x"} == {("x", r.read_no): r.id for r in reads.collect()}
    assert sorted(n for k, n in got if k == "y") == list(range(len([1 for k, _ in got if k == "y"])))
    total = {r.name: r for r in archive.totals(both, "name").collect()}
    alone = archive.totals(encoded).first()
    assert tuple(total["x"])[1:] == tuple(alone) and total["y"].frames == 2 and alone.records == 400
    assert archive.totals(encoded.limit(0)).first().rolling == 0
    whole = archive.totals(archive.encode_frames(assign_frames(reads, 64 << 20))).first()
    assert archive.unsigned(whole.rolling) == inspect(str(d / "a.arc")).rolling


def test_source_is_a_table(spark, made):
    d, text, _ = made
    register(spark)
    reads = spark.read.format("fastq").load(str(d / "a.fastq"))
    assert reads.count() == 400 and reads.columns[0] == "file_no"
    assert spark.read.format("readframes").load(str(d / "a.arc")).select("read_no").distinct().count() == 400
