"""A streaming source that follows the lines of growing log files under a shared folder, through renames and truncation.

An offset names each file by its inode and first line, so that a file which is renamed goes on where it was, one that is
cut and written anew begins again, and one that was renamed to a name outside the pattern is still read to its end. Only
whole lines are handed over. What lies between two offsets is the same whenever it's read, so a batch that is run again after a
failure has the same rows. Long ranges are split into parts of PART bytes, read by tasks of their own.
"""

from __future__ import annotations

import glob
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a range that one task reads, bytes read at once when the last line's end is looked for, and of a first line that tells files apart.
PART, BLOCK, HEAD = 32 << 20, 1 << 16, 4096


@dataclass
class Part(InputPartition):
    """Lines of a file that begin in begin..end; after: the range itself begins there, so no line reaches into it."""

    path: str
    inode: int
    begin: int
    end: int
    after: bool


def whole_lines(path: str) -> tuple[int, int, int]:
    """inode, end of the last whole line, and checksum of the first line (of its first HEAD bytes)."""
    with open(path, "rb") as f:
        head = f.read(HEAD)
        end = f.seek(0, os.SEEK_END)
        inode = os.fstat(f.fileno()).st_ino
        while end:
            start = max(0, end - BLOCK)
            f.seek(start)
            at = f.read(end - start).rfind(b"\n")
            if at >= 0:
                return inode, start + at + 1, zlib.crc32(head.split(b"\n", 1)[0])
            end = start
    return inode, 0, 0


def moved(path: str, inode: int) -> str | None:
    """Where a file that was at path is now: there, or under another name in its folder; None if it's gone."""
    try:
        if os.stat(path).st_ino == inode:
            return path
        with os.scandir(os.path.dirname(path) or ".") as entries:
            return next((e.path for e in entries if e.inode() == inode and e.is_file()), None)
    except FileNotFoundError:
        folder = os.path.dirname(path) or "."
        if not os.path.isdir(folder):
            return None
        with os.scandir(folder) as entries:
            return next((e.path for e in entries if e.inode() == inode and e.is_file()), None)


class TailReader(DataSourceStreamReader):
    """Offsets: inode, to path, position and checksum of the first line."""

    def __init__(self, pattern: str, earliest: bool, part: int):
        self.pattern, self.earliest, self.part = pattern, earliest, part
        self.seen: dict[str, tuple[tuple[int, int, int], tuple[int, int, int]]] = {}

    def _now(self) -> dict:
        out, seen = {}, {}
        for path in sorted(glob.glob(self.pattern, recursive=True)):
            try:
                s = os.stat(path)
                state = (s.st_ino, s.st_size, s.st_mtime_ns)
                known = self.seen.get(path)
                found = known[1] if known and known[0] == state else whole_lines(path)
            except FileNotFoundError:  # renamed since it was listed; the next offset has it
                continue
            seen[path] = (state, found)
            out[str(found[0])] = [path, found[1], found[2]]
        self.seen = seen
        return out

    def initialOffset(self) -> dict:
        return {} if self.earliest else self._now()

    def latestOffset(self) -> dict:
        return self._now()

    def partitions(self, start: dict, end: dict) -> list[Part]:
        out: list[Part] = []
        for inode, (path, stop, first) in end.items():
            was = start.get(inode)
            goes_on = was is not None and was[1] <= stop and (was[1] == 0 or was[2] == first)
            out += self._split(path, int(inode), was[1] if goes_on else 0, stop)
        for inode, (path, at, first) in start.items():
            if inode not in end and (there := moved(path, int(inode))):
                _, stop, now_first = whole_lines(there)
                if stop > at and (at == 0 or now_first == first):
                    out += self._split(there, int(inode), at, stop)
        return out

    def _split(self, path: str, inode: int, begin: int, end: int) -> list[Part]:
        return [Part(path, inode, b, min(end, b + self.part), b == begin) for b in range(begin, end, self.part)]

    def read(self, partition: Part) -> Iterator[tuple[str, int, str]]:
        path = moved(partition.path, partition.inode)
        if path is None or os.stat(path).st_size < partition.end:
            raise OSError(f"lines of {partition.path} up to byte {partition.end} are gone: it was removed or cut before they were read")
        with open(path, "rb") as f:
            at = partition.begin
            if partition.after:
                f.seek(at)
            else:  # a line that began before belongs to the part before
                f.seek(at - 1)
                at += len(f.readline()) - 1
            while at < partition.end:
                line = f.readline()
                if not line:
                    break
                yield partition.path, at, line.rstrip(b"\n").decode("utf-8", "replace")
                at += len(line)


class TailSource(DataSource):
    """file, position (of the line's first byte), value. Options: path (a pattern), start (latest: only what is written from now on; earliest), part (bytes)."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "file string, position long, value string"

    def streamReader(self, schema) -> TailReader:
        start = self.options.get("start", "latest")
        if start not in ("latest", "earliest") or "path" not in self.options:
            raise ValueError("log_tail needs a path, and latest or earliest as its start")
        return TailReader(self.options["path"], start == "earliest", int(self.options.get("part", PART)))


def tail(spark: SparkSession, pattern: str, start: str = "latest", part: int = PART) -> DataFrame:
    """The stream of lines of files that match a pattern, files that appear later from their beginning. Lines of a file that's removed before they're read can't be told."""
    spark.dataSource.register(TailSource)
    return spark.readStream.format("log_tail").option("path", pattern).option("start", start).option("part", str(part)).load()
