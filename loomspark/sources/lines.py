"""Lines of session files with their byte offsets, as a batch and a streaming source.

Files are cut into byte ranges that are read in parallel; a range owns the lines that begin in it.  The stream remembers, per file, how far it
was read and the hash of all bytes so far, and only ever hands out complete lines: an unterminated tail waits for the run that completes it.
A file whose first bytes no longer hash to what was read was rewritten: it is read anew, its rows marked.  Files whose size, time and inode
are those of the last look are not opened again.  The files must lie where every executor sees them.
"""

from __future__ import annotations

import glob
import hashlib
import json
import os
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from loomspark.operators.snapshots import SKIPPED

SCHEMA = "path string, byte_offset bigint, line string, terminated boolean, valid_utf8 boolean, rewritten boolean"
_ARROW = pa.schema([("path", pa.string()), ("byte_offset", pa.int64()), ("line", pa.string()), ("terminated", pa.bool_()), ("valid_utf8", pa.bool_()), ("rewritten", pa.bool_())])
SKIPPED_FOLDERS = set(SKIPPED)
# Suffixes of files that hold a record a line.
SUFFIXES = (".jsonl", ".ndjson")
_BATCH = 4096


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int, rewritten: bool = False):
        self.path, self.start, self.end, self.rewritten = path, start, end, rewritten


def session_files(root: str, suffixes: tuple[str, ...] = SUFFIXES) -> list[str]:
    """Candidate files under a folder, a file or a pattern, in order, each once."""
    found: set[str] = set()
    for path in glob.glob(root) or [root]:
        if os.path.isfile(path):
            found.add(os.path.realpath(path))
        for folder, folders, names in os.walk(path):
            folders[:] = [f for f in folders if f.lower() not in SKIPPED_FOLDERS]
            found.update(os.path.realpath(os.path.join(folder, n)) for n in names if n.lower().endswith(suffixes))
    return sorted(found)


def ranges(path: str, start: int, end: int, size: int, rewritten: bool = False) -> list[ByteRange]:
    return [ByteRange(path, at, min(end, at + size), rewritten) for at in range(start, end, size)]


def prefix_hash(path: str, end: int, chunk: int = 8 << 20) -> str | None:
    """SHA-256 of the first ``end`` bytes; null if the file has fewer."""
    digest, left = hashlib.sha256(), end
    with open(path, "rb") as file:
        while left and (data := file.read(min(chunk, left))):
            digest.update(data)
            left -= len(data)
    return None if left else digest.hexdigest()


def read_range(part: ByteRange, first: bool) -> Iterator[pa.RecordBatch]:
    """The lines that begin in the range; ``first``: the range begins at a line's start in any case."""
    rows: list[tuple] = []
    with open(part.path, "rb") as file:
        at = part.start
        if not first and at:
            file.seek(at - 1)
            at += len(file.readline()) - 1
        file.seek(at)
        while at < part.end and (raw := file.readline()):
            body = raw[:-1] if raw.endswith(b"\n") else raw
            try:
                text, valid = body.decode("utf-8"), True
            except UnicodeDecodeError:
                text, valid = body.decode("utf-8", errors="replace"), False
            rows.append((part.path, at, text, raw.endswith(b"\n"), valid, part.rewritten))
            at += len(raw)
            if len(rows) == _BATCH:
                yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r, strict=True)) for r in rows], schema=_ARROW)
                rows = []
    if rows:
        yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r, strict=True)) for r in rows], schema=_ARROW)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.size = options["path"], int(options.get("split_bytes", 64 << 20))

    def partitions(self) -> list[InputPartition]:
        return [r for p in session_files(self.root) for r in ranges(p, 0, os.path.getsize(p), self.size)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        return read_range(partition, first=partition.start == 0)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.size = options["path"], int(options.get("split_bytes", 64 << 20))

    _looked: dict[str, tuple] = {}  # path to (size, time, inode), and what that look gave

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def _state(self, path: str) -> list | None:
        """[end of the last complete line, hash of the bytes before it]; none for a file that is gone."""
        try:
            stat = os.stat(path)
            mark = (stat.st_size, stat.st_mtime_ns, stat.st_ino)
            if self._looked.get(path, (None,))[0] != mark:
                end = complete_end(path)
                self._looked[path] = (mark, [end, prefix_hash(path, end)])
            return self._looked[path][1]
        except FileNotFoundError:
            return None

    def latestOffset(self) -> dict:
        with ThreadPoolExecutor(16) as pool:
            files = session_files(self.root)
            return {"files": json.dumps({p: s for p, s in zip(files, pool.map(self._state, files), strict=True) if s})}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        moved = [(path, *before.get(path, [0, None]), state[0]) for path, state in after.items() if state != before.get(path)]
        with ThreadPoolExecutor(16) as pool:
            kept = pool.map(lambda m: m[1] == 0 or (m[1] <= m[3] and prefix_hash(m[0], m[1]) == m[2]), moved)
            return [r for (path, begin, _, stop), same in zip(moved, kept, strict=True) for r in ranges(path, begin if same else 0, stop, self.size, rewritten=not same)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        return read_range(partition, first=False)


def complete_end(path: str, chunk: int = 1 << 16) -> int:
    """The offset behind the last line feed."""
    at = os.path.getsize(path)
    with open(path, "rb") as file:
        while at:
            begin = max(0, at - chunk)
            file.seek(begin)
            found = file.read(at - begin).rfind(b"\n")
            if found >= 0:
                return begin + found + 1
            at = begin
    return 0


class SessionLines(DataSource):
    """``spark.read.format("session_lines").load(path)``, likewise ``readStream``; option split_bytes."""

    @classmethod
    def name(cls) -> str:
        return "session_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SessionLines)
