"""compress, decompress and verify as Spark jobs; each returns Stats or raises a typed error."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from strandlake.functions import codec, errors
from strandlake.functions import expr as E
from strandlake.operators import profile as profiles
from strandlake.plans import transfer
from strandlake.plans.archive import unsigned
from strandlake.sources import storage
from strandlake.sources.frames import MEMORY_MIB, inspect
from strandlake.sources.storage import Staged

MIN_MEMORY_MIB = 64
FRAME_MIB = 64


@dataclass(frozen=True)
class Stats:
    profile: str
    paired: bool
    frames: int
    records: int
    bases: int
    input_bytes: int
    output_bytes: int


@contextmanager
def typed():
    """Turn what a task raised into the error it was."""
    try:
        yield
    except PySparkException as e:
        for kind in vars(errors).values():
            if isinstance(kind, type) and issubclass(kind, errors.ArchiveError) and f"errors.{kind.__name__}" in str(e):
                line = next((x for x in str(e).splitlines() if f"errors.{kind.__name__}:" in x), "")
                raise kind(line.partition(": ")[2] or "failed") from None
        raise


def mib(n: int) -> int:
    """Bytes of so many MiB, which must fit 64 bits."""
    if n << 20 >> 64 > 0:
        raise errors.UsageError("a size does not fit 64 bits")
    return n << 20


def check_memory(memory_mib: int) -> int:
    if memory_mib < MIN_MEMORY_MIB:
        raise errors.UsageError(f"the memory limit is at least {MIN_MEMORY_MIB} MiB")
    return mib(memory_mib)


def resolve_profile(spark: SparkSession, paths: list[str], memory: int) -> str:
    limit = min(E.MAX_FRAME, (memory - E.RESERVE) // 8)
    reads = transfer.first_reads(spark, paths)
    found = profiles.detect_profile(profiles.profile_sample(reads, limit, len(paths) == 2)).first().profile
    if found is None:
        raise errors.UsageError("the profile is ambiguous; name one")
    return found


@contextmanager
def published(target: str, force: bool):
    """Output that appears whole or not at all."""
    staged = Staged(target, force)
    try:
        with typed():
            yield staged
    except BaseException:
        staged.abort()
        raise


def compress(spark: SparkSession, source: str, target: str, mate: str | None = None, profile: str | None = None, frame_mib: int = FRAME_MIB, memory_mib: int = MEMORY_MIB, force: bool = False) -> Stats:
    memory = check_memory(memory_mib)
    frame = mib(frame_mib)
    if frame <= 0:
        raise errors.UsageError("the frame size must be positive")
    paths = [source] if mate is None else [source, mate]
    for p in paths:
        storage.check_output(p, target, force)
    if profile is not None and profile not in codec.PROFILE_CODES:
        raise errors.UsageError(f"unknown profile: {profile}")
    with published(target, force) as staged:
        profile = profile or resolve_profile(spark, paths, memory)
        done = transfer.encode_files(spark, paths, min(frame, (memory - E.RESERVE) // 8), memory, staged)
        records, bases, rolling = sum(r.records for r in done), sum(r.bases for r in done), 0
        if [r.frame_id for r in done] != list(range(len(done))):
            raise errors.InternalError("frames are missing")
        for r in done:
            rolling = codec.advance(rolling, unsigned(r.checksum))
        head, tail = codec.header(profile, mate is not None), codec.footer(len(done), records, bases, rolling)
        transfer.assemble(spark, staged, head, done, tail)
    size = len(head) + len(tail) + sum(r.n for r in done)
    return Stats(profile, mate is not None, len(done), records, bases, sum(r.text for r in done), size)


def decompress(spark: SparkSession, source: str, target: str, memory_mib: int = MEMORY_MIB, force: bool = False) -> Stats:
    memory = check_memory(memory_mib)
    storage.check_output(source, target, force)
    found = inspect(source, memory)
    with published(target, force) as staged:
        done = transfer.decode_frames(spark, source, found, memory, staged)  # totals and checksums agree, or nothing is published
        transfer.assemble(spark, staged, b"", done, b"")
    return Stats(found.profile, found.paired, len(done), found.records, found.bases, found.size, sum(r.text for r in done))


def verify(spark: SparkSession, source: str, memory_mib: int = MEMORY_MIB) -> Stats:
    memory = check_memory(memory_mib)
    found = inspect(source, memory)
    with typed():
        done = transfer.decode_frames(spark, source, found, memory, None)
    return Stats(found.profile, found.paired, len(done), found.records, found.bases, found.size, sum(r.text for r in done))
