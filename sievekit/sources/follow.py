"""A streaming source that follows a log while it is written and rotated."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

_BLOCK = 1 << 20
#: Bytes of a file's first line that tell it from another file in the same place on disk.
_FIRST = 1 << 16


def local_folder(directory: str) -> str:
    """The folder's path on the shared file system; only such a folder can be read while it grows."""
    parts = urlparse(directory)
    if parts.scheme not in ("", "file") or parts.netloc not in ("", "localhost"):
        raise ValueError(f"a log that is being written can be followed on a mounted file system only, not in {directory}")
    return unquote(parts.path) if parts.scheme else directory


def identity(path: str) -> str | None:
    """Name of a file that stays when it is renamed or grows: its inode and its first line.

    None while the first line is not complete.
    """
    with open(path, "rb") as file:
        first = file.readline(_FIRST)
        if not first.endswith(b"\n") and len(first) < _FIRST:
            return None
        return f"{os.fstat(file.fileno()).st_ino}:{hashlib.sha256(first).hexdigest()[:24]}"


def complete_bytes(path: str, known: int) -> int:
    """Bytes of a file up to its last line end, at least ``known``; what follows may still be written."""
    with open(path, "rb") as file:
        end = file.seek(0, os.SEEK_END)
        while end > known:
            start = max(known, end - _BLOCK)
            file.seek(start)
            at = file.read(end - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
    return known


def members(folder: str, prefix: str) -> Iterator[str]:
    """Files whose name starts with ``prefix``, and the parts of folders whose name does."""
    for entry in sorted(os.scandir(folder), key=lambda e: e.name):
        if entry.name.startswith(prefix):
            if entry.is_dir():
                yield from (p.path for p in os.scandir(entry.path) if p.is_file() and not p.name.startswith((".", "_")))
            elif entry.is_file():
                yield entry.path


@dataclass
class LogRange(InputPartition):
    """Lines of one file that begin in a byte range; ``first`` is where the batch begins in it."""

    path: str
    name: str
    first: int
    start: int
    end: int


class FollowReader(DataSourceStreamReader):
    def __init__(self, folder: str, prefix: str, chunk: int):
        self.folder, self.prefix, self.chunk = folder, prefix, chunk

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Complete bytes by identity. A renamed file keeps its name here, a deleted one is forgotten."""
        found = {}
        for path in members(self.folder, self.prefix):
            try:
                if name := identity(path):
                    found[name] = complete_bytes(path, 0)
            except FileNotFoundError:  # rotated away since it was listed: it is found under its next name
                continue
        return found

    def partitions(self, start: dict, end: dict) -> list[LogRange]:
        paths = {identity(p): p for p in members(self.folder, self.prefix)}
        return [
            LogRange(paths.get(name, ""), name, start.get(name, 0), lo, min(lo + self.chunk, last))
            for name, last in end.items() for lo in range(start.get(name, 0), last, self.chunk)
        ]

    def read(self, part: LogRange) -> Iterator[pa.RecordBatch]:
        """The lines of a range; the file may have been renamed since it was planned."""
        for path in [part.path, *members(self.folder, self.prefix)]:
            try:
                file = open(path, "rb")
            except (FileNotFoundError, IsADirectoryError):
                continue
            with file:
                if identity(path) == part.name:
                    yield from self._lines(file, path, part)
                    return
        raise OSError(f"log file {part.name} was deleted before it was read")

    def _lines(self, file, path: str, part: LogRange) -> Iterator[pa.RecordBatch]:
        at = part.start
        if at > part.first:  # the line that reaches into the range belongs to the one before
            file.seek(at - 1)
            at += len(file.readline()) - 1
        else:
            file.seek(at)
        lines, places, size = [], [], 0
        while at < part.end and (line := file.readline()):
            lines.append(line.rstrip(b"\r\n").decode("utf-8", "replace"))
            places.append(at)
            at, size = at + len(line), size + len(line)
            if size > _BLOCK:
                yield self._batch(lines, places, path, part)
                lines, places, size = [], [], 0
        if lines:
            yield self._batch(lines, places, path, part)

    def _batch(self, lines: list[str], places: list[int], path: str, part: LogRange) -> pa.RecordBatch:
        n = len(lines)
        return pa.RecordBatch.from_arrays([pa.array(lines), pa.array([part.name] * n), pa.array(places)], ["value", "member", "byte"])


class FollowLog(DataSource):
    """``spark.readStream.format("follow_log")``: lines of a rotated log, each once, as they are completed.

    Options: ``path`` (the folder, on a file system that driver and executors mount), ``prefix`` (``app.log``)
    and ``chunk`` (bytes per task). Columns: ``value``, ``member`` (which file, through all of its
    names) and ``byte`` (where the line begins in it).

    An offset is the number of complete bytes of each file, and files are known by inode and first
    line. So a file that is renamed goes on where it stood, a new one of the old name begins at its
    start, and a run resumes inside a file from its checkpoint. A line without its end waits. A
    file that rotation deletes after its lines were planned and before they were read is an error.
    """

    @classmethod
    def name(cls) -> str:
        return "follow_log"

    def schema(self) -> str:
        return "value string, member string, byte bigint"

    def streamReader(self, schema) -> FollowReader:
        folder = local_folder(self.options["path"])
        return FollowReader(folder, self.options.get("prefix", "app.log"), int(self.options.get("chunk", str(64 << 20))))
