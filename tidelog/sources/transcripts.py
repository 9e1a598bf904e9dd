"""Transcripts as a stream of lines: files that grow, read on from where they were left.

A Python data source whose offsets are bytes for each file.  A batch reads each
file from its last offset to the end of its last finished line; an unfinished
line waits.  A file that has become shorter was written anew and is read from
its beginning.  Offsets live in the stream's checkpoint, so a restarted stream
reads no line twice and skips none.  Long stretches are cut at line ends into
pieces that tasks read at the same time.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from tidelog.sources.tables import workers_import

#: Bytes of a piece, and of a step when a line's end is looked for.
PIECE, STEP = 64 << 20, 1 << 16
FIELDS = "file string, offset long, line string"


@dataclass
class Stretch(InputPartition):
    file: str
    start: int
    end: int


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def finished(system: fs.FileSystem, path: str, start: int, end: int) -> int:
    """The place after the last line end in [start, end); start if there is none."""
    with system.open_input_file(path) as file:
        while end > start:
            begin = max(start, end - STEP)
            at = file.read_at(end - begin, begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return start


def next_end(system: fs.FileSystem, path: str, start: int, end: int) -> int:
    """The place after the first line end in [start, end); end if there is none."""
    with system.open_input_file(path) as file:
        while start < end:
            at = file.read_at(min(STEP, end - start), start).find(b"\n")
            if at >= 0:
                return start + at + 1
            start += STEP
    return end


class _Reader(DataSourceStreamReader):
    def __init__(self, folder: str, suffix: str):
        self.folder, self.suffix = folder, suffix

    def initialOffset(self) -> dict:
        return {"ends": "{}", "starts": "{}"}

    def latestOffset(self) -> dict:
        """How far each file can be read; a file's length alone would split its last line."""
        system, root = _opened(self.folder)
        known = getattr(self, "known", {})
        ends = {}
        for info in system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            if info.is_file and info.path.endswith(self.suffix):
                before = known.get(info.path, 0)
                ends[info.path] = finished(system, info.path, before if info.size >= before else 0, info.size)
        self.known = ends
        return {"ends": json.dumps(ends, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        old, new = json.loads(start["ends"]), json.loads(end["ends"])
        system, _ = _opened(self.folder)
        self.known = new
        out = []
        for path, stop in sorted(new.items()):
            at = old.get(path, 0)
            at = 0 if stop < at else at  # shorter than before: written anew
            while at < stop:
                cut = stop if stop - at <= PIECE else finished(system, path, at, at + PIECE)
                cut = next_end(system, path, at + PIECE, stop) if cut == at else cut  # a line longer than a piece
                out.append(Stretch(path, at, cut))
                at = cut
        return out

    def read(self, partition: Stretch) -> Iterator[tuple]:
        system, _ = _opened(self.folder)
        at = partition.start
        with system.open_input_file(partition.file) as file:
            file.seek(at)
            rest, left = b"", partition.end - at
            while left:
                piece = file.read(min(left, STEP))
                if not piece:
                    return  # cut meanwhile; the next batch starts anew
                left -= len(piece)
                *lines, rest = (rest + piece).split(b"\n")
                for line in lines:
                    yield partition.file, at, line.decode("utf-8", "replace")
                    at += len(line) + 1

    def commit(self, end: dict) -> None:
        pass


class Transcripts(DataSource):
    """Format "transcripts": option path, a folder; option suffix, by default .jsonl."""

    @classmethod
    def name(cls) -> str:
        return "transcripts"

    def schema(self) -> str:
        return FIELDS

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(self.options["path"], self.options.get("suffix", ".jsonl"))


def transcript_lines(spark: SparkSession, folder: str, suffix: str = ".jsonl") -> DataFrame:
    """(file, offset, line): a stream of the finished lines of a folder's files."""
    workers_import(spark)
    spark.dataSource.register(Transcripts)
    return spark.readStream.format("transcripts").option("suffix", suffix).load(folder)
