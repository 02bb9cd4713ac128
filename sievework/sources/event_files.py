"""A stream over saved event-stream files that grow: each whole line once, also across restarts and replays.

An offset is, for each file, how many bytes have been read: always up to the end of a line, so half a line at the end
waits for the rest. A batch is the bytes between two offsets, which a file that only grows has again when the batch is replayed.
Files are cut into parts of ``PART`` bytes at most; a part reads the lines that begin in it. The offset grows with the number of files.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

LINE_SCHEMA = "file string, at bigint, line string"
PART = 8 << 20
_TAIL = 1 << 16


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system that an address names, the same on the driver and the executors, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def end_of_lines(fs: pafs.FileSystem, path: str, size: int, low: int) -> int:
    """The end of the last whole line before ``size``, ``low`` if none ends after that."""
    with fs.open_input_file(path) as f:
        at = size
        while at > low:
            begin = max(low, at - _TAIL)
            f.seek(begin)
            found = f.read(at - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            at = begin
    return low


def lines_between(fs: pafs.FileSystem, path: str, begin: int, end: int, stop: int) -> Iterator[tuple[int, str]]:
    """Lines that begin in ``begin .. end`` (a line's begin if ``begin`` isn't one is sought), each whole, up to ``stop``."""
    with fs.open_input_file(path) as f:
        at = begin
        if begin:
            f.seek(begin - 1)
            first = f.read(1)
            while first and first != b"\n":  # in the middle of a line that the part before reads
                block = f.read(_TAIL)
                cut = block.find(b"\n")
                at += cut + 1 if cut >= 0 else len(block)
                if cut >= 0 or not block:
                    break
        f.seek(at)
        held = b""
        while at < end:
            block = f.read(min(_TAIL, stop - at - len(held)))
            if not block:
                return
            *whole, held = (held + block).split(b"\n")
            for line in whole:
                if at >= end:
                    return
                yield at, line.decode("utf-8", "replace").removesuffix("\r")
                at += len(line) + 1


@dataclass
class Part(InputPartition):
    file: str
    begin: int
    end: int
    stop: int


class EventFiles(DataSource):
    """Option ``path``: a folder on a file system that the driver and all executors see."""

    @classmethod
    def name(cls) -> str:
        return "event_files"

    def schema(self) -> str:
        return LINE_SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"])


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str) -> None:
        self.path = path
        self.last: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, folder = opened(self.path)
        out = {}
        for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
            if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")):
                low = self.last.get(f.path, 0)
                out[f.path] = end_of_lines(fs, f.path, f.size, low) if f.size > low else low
        self.last = out
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for file in sorted(end):
            low, high = start.get(file, 0), end[file]
            out += [Part(file, b, min(b + PART, high), high) for b in range(low, high, PART)]
        return out

    def read(self, partition: Part) -> Iterator[tuple]:
        fs, _ = opened(self.path)
        for at, line in lines_between(fs, partition.file, partition.begin, partition.end, partition.stop):
            yield partition.file, at, line


def event_content(line: Column, schema: str = "content string") -> Column:
    """What a line ``data: {json}`` says; null for comments, the end of the stream, and what can't be read."""
    return F.when(F.startswith(line, F.lit("data: ")), F.from_json(F.substr(line, F.lit(7)), schema))


def decoded(lines: DataFrame) -> DataFrame:
    """``file, at, content`` of the lines that have a content."""
    return lines.select("file", "at", event_content(F.col("line"))["content"].alias("content")).where(F.col("content").isNotNull())
