"""Transcripts as a Spark data source: spark.read.format("claude").load(root), and as a stream that follows growing files.

A row is a line: (path, mtime, file_size, at, size, value), at being the byte where it
begins, which orders a file's lines without numbering them. Files are read in ranges
of bytes by several tasks; a range begins after the first line feed in it, and the
line that its end cuts is read to its own end. A line of over LINE_BYTES has no value:
it is passed over a piece at a time and never held.

The stream's offset is, for each file, the byte after its last whole line; a file that
has become shorter begins again. Options: glob (below the root, by default where the
dialect keeps its transcripts), headBytes (only lines that begin there, for a look at
files' first lines), splitBytes. The root is a folder or a file of a file system that
pyarrow opens (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timezone
from fnmatch import translate

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Longer lines are skipped, as they hold embedded files; bytes of a task, of a read, of a batch.
LINE_BYTES, SPLIT, CHUNK, BATCH = 524_288, 64 << 20, 1 << 20, 4 << 20
SCHEMA = "path string, mtime timestamp, file_size long, at long, size long, value string"
ARROW = pa.schema([("path", pa.string()), ("mtime", pa.timestamp("us", "UTC")), ("file_size", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("value", pa.string())])
#: Where each dialect keeps its transcripts, below its root.
GLOBS = {"claude": ["projects/*/*.jsonl"], "codex": ["sessions/*/*/*/*.jsonl", "archived_sessions/*.jsonl"], "antigravity": ["brain/*/.system_generated/logs/*.jsonl"]}


class Piece(InputPartition):
    """Ranges of files: (path, mtime, file size, start, end)."""

    def __init__(self, ranges: list[tuple]):
        super().__init__(None)
        self.ranges = ranges


def opened(root: str) -> tuple[pafs.FileSystem, str]:
    if root.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + root[5:].lstrip("/")
    return pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)


def files(options: dict, globs: list[str]) -> list[pafs.FileInfo]:
    """The files below the root that one of the patterns fits, part by part."""
    fs, root = opened(options["path"])
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.File:
        return [info]
    # a star stays within a part of the path, two reach over several
    test = re.compile("|".join("/".join(translate(p).removesuffix(r"\z").removesuffix(r"\Z").replace(".*", "[^/]*") if p != "**" else ".*" for p in g.split("/")) for g in globs))
    found = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((f for f in found if f.type == pafs.FileType.File and test.fullmatch(f.path[len(root.rstrip("/")) + 1 :])), key=lambda f: f.path)


def lines_in(f, start: int, end: int, limit: int = LINE_BYTES) -> Iterator[tuple[int, int, bytes | None]]:
    """(at, size, line) of the lines that begin in [start, end) of an open file; no line where it is over the limit."""
    at, held, size = start, [], 0
    f.seek(max(0, start - 1))
    inside = start == 0  # whether the reader stands at the beginning of a line, or looks for one
    pos = max(0, start - 1)
    while chunk := f.read(CHUNK):
        i = 0
        if not inside:
            i = chunk.find(b"\n") + 1
            if not i:
                pos += len(chunk)
                continue
            inside, at = True, pos + i
        while at < end:
            j = chunk.find(b"\n", i)
            if j < 0:
                size += len(chunk) - i
                held = [*held, chunk[i:]] if size <= limit else []
                break
            size += j - i
            yield at, size, b"".join([*held, chunk[i:j]]) if size <= limit else None
            at, held, size, i = at + size + 1, [], 0, j + 1
        else:
            return
        pos += len(chunk)
    if inside and size and at < end:
        yield at, size, b"".join(held) if size <= limit else None


def batches(fs: pafs.FileSystem, ranges: list[tuple]) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for path, mtime, length, start, end in ranges:
        with fs.open_input_file(path) as f:
            for at, size, line in lines_in(f, start, end):
                rows.append((path, mtime, length, at, size, None if line is None else line.decode("utf-8", "replace")))
                held += len(line or b"") + 64
                if held >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)
                    rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)


def pieces(found: list[tuple[pafs.FileInfo, int, int]], split: int) -> list[Piece]:
    """Ranges of about split bytes: long files are cut, short ones put together."""
    out, now, held = [], [], 0
    for f, start, end in found:
        for at in range(start, end, split):
            to = min(end, at + split)
            now.append((f.path, f.mtime or datetime.fromtimestamp(0, timezone.utc), f.size, at, to))
            held += to - at
            if held >= split:
                out.append(Piece(now))
                now, held = [], 0
    return [*out, Piece(now)] if now else out


class LinesReader(DataSourceReader):
    def __init__(self, options: dict, globs: list[str]):
        self.options, self.globs = options, globs

    def partitions(self) -> list[InputPartition]:
        head, split = int(self.options.get("headbytes", 0)), int(self.options.get("splitbytes", SPLIT))
        return pieces([(f, 0, min(f.size, head or f.size)) for f in files(self.options, self.globs)], split) or [Piece([])]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        yield from batches(opened(self.options["path"])[0], partition.ranges)


class LinesStream(DataSourceStreamReader):
    def __init__(self, options: dict, globs: list[str]):
        self.options, self.globs, self.known = options, globs, {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        fs, _ = opened(self.options["path"])
        for f in files(self.options, self.globs):
            was = self.known.get(f.path, 0)
            if f.size < was:
                was = 0
            if f.size > was:
                self.known[f.path] = self.whole(fs, f, was)
        return {"files": dict(self.known)}

    def whole(self, fs: pafs.FileSystem, f: pafs.FileInfo, was: int) -> int:
        """The byte after the last line feed beyond was; was, if there is none yet."""
        with fs.open_input_file(f.path) as file:
            end = f.size
            while end > was:
                begin = max(was, end - CHUNK)
                file.seek(begin)
                at = file.read(end - begin).rfind(b"\n")
                if at >= 0:
                    return begin + at + 1
                end = begin
        return was

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        held = {f.path: f for f in files(self.options, self.globs)}
        found = []
        for path, to in end["files"].items():
            since = start["files"].get(path, 0)
            since = 0 if to < since else since
            if path in held and to > since:
                found.append((held[path], since, to))
        return pieces(found, int(self.options.get("splitbytes", SPLIT))) or [Piece([])]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        yield from batches(opened(self.options["path"])[0], partition.ranges)


class Lines(DataSource):
    """JSON Lines of any kind: every .jsonl file below the root."""

    globs = ["**/*.jsonl", "*.jsonl"]

    @classmethod
    def name(cls) -> str:
        return "transcript_lines"

    def schema(self) -> str:
        return SCHEMA

    def patterns(self) -> list[str]:
        return [self.options["glob"]] if "glob" in self.options else self.globs

    def reader(self, schema) -> DataSourceReader:
        return LinesReader(dict(self.options), self.patterns())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LinesStream(dict(self.options), self.patterns())


class Claude(Lines):
    globs = GLOBS["claude"]

    @classmethod
    def name(cls) -> str:
        return "claude"


class Codex(Lines):
    globs = GLOBS["codex"]

    @classmethod
    def name(cls) -> str:
        return "codex"


class Antigravity(Lines):
    globs = GLOBS["antigravity"]

    @classmethod
    def name(cls) -> str:
        return "antigravity"


def register(spark: SparkSession) -> None:
    """Makes the formats transcript_lines, claude, codex and antigravity known to the session."""
    for source in (Lines, Claude, Codex, Antigravity):
        spark.dataSource.register(source)
