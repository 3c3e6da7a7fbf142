"""Command line: compress, decompress and verify read archives."""

from __future__ import annotations

import argparse
import logging
import shutil
import sys
from contextlib import contextmanager
from pathlib import Path

from strandlake import __version__
from strandlake.functions.errors import ArchiveError, InputOutputError, UsageError
from strandlake.sources.storage import locate, scratch

log = logging.getLogger("strandlake")
COPY = 1 << 20
#: The names of levels in messages.
LEVELS = {logging.DEBUG: "DBG", logging.INFO: "INF", logging.WARNING: "WRN", logging.ERROR: "ERR", logging.CRITICAL: "CRT"}


class Parser(argparse.ArgumentParser):
    def error(self, message):
        raise UsageError(message)


def parser() -> argparse.ArgumentParser:
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--memory-limit", type=int, default=argparse.SUPPRESS, metavar="MIB", help="memory of a frame at most (16384)")
    common.add_argument("-q", "--quiet", action="store_true", default=argparse.SUPPRESS)
    top = Parser(prog="strandlake", parents=[common])
    top.add_argument("-V", "--version", action="version", version=__version__)
    sub = top.add_subparsers(dest="command", required=True, parser_class=Parser)
    c = sub.add_parser("compress", aliases=["c"], parents=[common])
    c.add_argument("-i", "-1", "--input", required=True)
    c.add_argument("-2", "--mate")
    c.add_argument("-o", "--output", required=True)
    c.add_argument("--profile", default="auto")
    c.add_argument("--frame-mib", type=int, default=64)
    c.add_argument("-f", "--force", action="store_true")
    d = sub.add_parser("decompress", aliases=["d", "x"], parents=[common])
    d.add_argument("-i", "--input", required=True)
    d.add_argument("-o", "--output", required=True)
    d.add_argument("-f", "--force", action="store_true")
    v = sub.add_parser("verify", aliases=["v"], parents=[common])
    v.add_argument("-i", "--input")
    v.add_argument("path", nargs="?")
    return top


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("strandlake").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@contextmanager
def piped(spark, needed: bool):
    """(file system, folder) that driver and executors share, for what comes from or goes to a pipe."""
    if not needed:
        yield None, None
        return
    folder = scratch(spark)
    fs, path = locate(folder)
    try:
        yield fs, folder
    finally:
        fs.delete_dir(path)


def run(args: argparse.Namespace, spark=None, stdin=None, stdout=None) -> None:
    from strandlake.plans import commands

    memory = getattr(args, "memory_limit", 16384)
    source = args.input or getattr(args, "path", None)
    if not source:
        raise UsageError("an input is needed")
    mate = getattr(args, "mate", None)
    if mate == "-" and source == "-":
        raise UsageError("only one input can be standard input")
    target = getattr(args, "output", None)
    for p in (source, mate):
        if p and p != "-" and "://" not in p and not Path(p).exists():
            raise InputOutputError(f"cannot open {p}")
    spark = spark or session()
    with piped(spark, "-" in (source, mate, target)) as (fs, d):  # pipes pass through files; Spark's tasks have no standard streams
        spooled = {}
        for name in {source, mate} & {"-"}:
            spooled[name] = f"{d}/in"
            with fs.open_output_stream(locate(spooled[name])[1]) as f:
                shutil.copyfileobj(stdin or sys.stdin.buffer, f, COPY)
        at = lambda p: spooled.get(p, p)
        place = f"{d}/out" if target == "-" else target
        if args.command in ("compress", "c"):
            profile = None if args.profile == "auto" else args.profile
            stats, what = commands.compress(spark, at(source), place, at(mate), profile, args.frame_mib, memory, args.force), "compression"
        elif args.command in ("decompress", "d", "x"):
            stats, what = commands.decompress(spark, at(source), place, memory, args.force), "decompression"
        else:
            stats, what = commands.verify(spark, at(source), memory), "verification"
        if target == "-":
            with fs.open_input_file(locate(place)[1]) as f:
                shutil.copyfileobj(f, stdout or sys.stdout.buffer, COPY)
    if not getattr(args, "quiet", False):
        log.info("%s complete: profile=%s, paired=%s, frames=%d, records=%d, bases=%d, input=%d bytes, output=%d bytes", what, stats.profile, str(stats.paired).lower(), stats.frames, stats.records, stats.bases, stats.input_bytes, stats.output_bytes)


class Short(logging.Formatter):
    def format(self, record):
        record.levelname = LEVELS.get(record.levelno, record.levelname)
        return super().format(record)


def main(argv: list[str] | None = None, spark=None) -> int:
    handler = logging.StreamHandler(sys.stderr)
    handler.setFormatter(Short("[%(levelname)s] %(message)s"))
    logging.basicConfig(handlers=[handler], level=logging.INFO)
    try:
        run(parser().parse_args(argv), spark)
        return 0
    except SystemExit as e:  # help and version
        return int(e.code or 0)
    except ArchiveError as e:
        log.error("%s", e)
        return e.exit_code
    except Exception as e:
        log.error("unexpected failure: %s", e)
        return 3


if __name__ == "__main__":
    sys.exit(main())
