"""Files by URI or path, their compression, and staged output."""

from __future__ import annotations

import gzip
import io
import uuid
import zlib

from pyarrow import fs as pafs

from strandlake.functions.errors import InputOutputError, UsageError

# First bytes and file name extensions of compression formats.
MAGICS = {"gzip": b"\x1f\x8b", "bzip2": b"BZh", "xz": b"\xfd7zXZ\x00", "zstd": b"\x28\xb5\x2f\xfd"}
EXTENSIONS = {".gz": "gzip", ".gzip": "gzip", ".bz2": "bzip2", ".bzip2": "bzip2", ".xz": "xz", ".lzma": "xz", ".zst": "zstd", ".zstd": "zstd"}
SUPPORTED = ("none", "gzip")
BUFFER = 1 << 16


def locate(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def exists(path: str) -> bool:
    fs, p = locate(path)
    return fs.get_file_info(p).type != pafs.FileType.NotFound


def detect(head: bytes, path: str = "") -> str:
    """The compression format by the first bytes; by the name only if there are fewer than two."""
    if len(head) < 2:
        name = path.rsplit("/", 1)[-1].lower()
        return EXTENSIONS.get("." + name.rsplit(".", 1)[1], "none") if "." in name else "none"
    return next((n for n, m in MAGICS.items() if head.startswith(m)), "none")


class Checked(io.RawIOBase):
    """A gzip stream (members one after another) whose faults are I/O errors and never look like its end."""

    def __init__(self, raw):
        self.stream = gzip.GzipFile(fileobj=raw)

    def readable(self):
        return True

    def readinto(self, buffer):
        try:
            data = self.stream.read(len(buffer))
        except (EOFError, OSError, zlib.error) as e:
            raise InputOutputError(f"invalid gzip stream: {e}") from None
        buffer[: len(data)] = data
        return len(data)


def open_input(path: str) -> io.BufferedReader:
    """The file's bytes, inflated if they are gzip; formats that are known but not supported fail."""
    fs, p = locate(path)
    try:
        raw = fs.open_input_file(p)
    except OSError as e:
        raise InputOutputError(f"cannot open {path}: {e}") from None
    head = raw.read(8)
    raw.seek(0)
    kind = detect(head, path)
    if kind == "gzip" and len(head) >= 2:
        return io.BufferedReader(Checked(raw), BUFFER)
    if kind not in SUPPORTED:
        raise InputOutputError(f"unsupported compression format: {kind}")
    return io.BufferedReader(raw, BUFFER)


def scratch(spark) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or on one machine in /tmp."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise UsageError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file:///tmp/strandlake-shared"
    path = f"{root.rstrip('/')}/strandlake/files-{uuid.uuid4().hex}"
    fs, p = locate(path)
    fs.create_dir(p, recursive=True)
    return path


def is_plain(path: str) -> bool:
    """Whether the file is read as it is, so that any part of it can be read again."""
    fs, p = locate(path)
    with fs.open_input_file(p) as f:
        return detect(f.read(8), path) == "none"


def part_files(path: str) -> list[str]:
    """The path, or the parts of a folder in the order of their names."""
    fs, p = locate(path)
    if fs.get_file_info(p).type != pafs.FileType.Directory:
        return [path]
    files = [f.base_name for f in fs.get_file_info(pafs.FileSelector(p)) if f.type == pafs.FileType.File and f.base_name.startswith("part-")]
    return [f"{path.rstrip('/')}/{n}" for n in sorted(files)]


def check_output(source: str, target: str, force: bool) -> None:
    if not source or not target:
        raise UsageError("input and output paths are needed")
    if source == target and target != "-":
        raise UsageError("input and output are the same file")
    if target != "-" and not force and exists(target):
        raise InputOutputError(f"output exists: {target}")


class Staged:
    """Output beside its place, moved there by commit() and deleted by abort()."""

    def __init__(self, path: str, force: bool):
        self.fs, self.path = locate(path)
        self.force, self.name = force, path
        self.temporary = f"{self.path}.tmp.{uuid.uuid4().hex}"

    def part(self, name: str) -> str:
        self.fs.create_dir(f"{self.temporary}.parts", recursive=True)
        return f"{self.temporary}.parts/{name}"

    def open(self):
        return self.fs.open_output_stream(self.temporary)

    def commit(self) -> None:
        if not self.force and self.fs.get_file_info(self.path).type != pafs.FileType.NotFound:
            self.abort()
            raise InputOutputError(f"output exists: {self.name}")
        self.fs.move(self.temporary, self.path)
        self._drop_parts()

    def commit_parts(self, parts: list[str]) -> None:
        """Publish the parts as files of a folder, named by their order; nothing is copied."""
        if self.fs.get_file_info(self.path).type != pafs.FileType.NotFound:
            if not self.force:
                self.abort()
                raise InputOutputError(f"output exists: {self.name}")
            (self.fs.delete_dir if self.fs.get_file_info(self.path).type == pafs.FileType.Directory else self.fs.delete_file)(self.path)
        folder = f"{self.temporary}.parts"
        self.fs.create_dir(folder, recursive=True)
        kept = set(parts)
        for f in self.fs.get_file_info(pafs.FileSelector(folder)):
            if f.path not in kept:  # of an attempt that was given up
                self.fs.delete_file(f.path)
        for i, p in enumerate(parts):
            self.fs.move(p, f"{folder}/part-{i:08d}")
        self.fs.move(folder, self.path)

    def abort(self) -> None:
        if self.fs.get_file_info(self.temporary).type != pafs.FileType.NotFound:
            self.fs.delete_file(self.temporary)
        self._drop_parts()

    def _drop_parts(self) -> None:
        if self.fs.get_file_info(f"{self.temporary}.parts").type != pafs.FileType.NotFound:
            self.fs.delete_dir(f"{self.temporary}.parts")
