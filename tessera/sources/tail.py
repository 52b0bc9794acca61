"""A streaming source of lines that are appended to files.

Spark's file source takes a file once, when it appears.  Event logs grow, so
this source's offsets are the bytes of each file up to its last whole line: a
half-written line waits until its end is there, and a restart goes on from the
checkpoint's offsets.  A batch's range of bytes is fixed when it is planned, so
it reads the same lines however often it is run.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of a file that one task reads at most, and of the blocks in which a line's end is looked for.
CHUNK, BLOCK = 64 << 20, 64 << 10
#: Lines of a batch handed to Spark.
ROWS = 4_096


class _Range(InputPartition):
    def __init__(self, path: str, first: int, start: int, end: int, upto: int):
        super().__init__((path, first, start, end, upto))


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.match, self.chunk = options["path"], options.get("match", "*"), int(options.get("chunkBytes", CHUNK))

    def _place(self):
        from pyarrow.fs import FileSystem

        uri = re.sub(r"^file:/(?!/)", "file:///", self.root)
        return FileSystem.from_uri(uri if re.match(r"^[a-z][a-z0-9+.-]*:/", uri) else f"file://{uri}")

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow.fs import FileSelector, FileType

        fs, base = self._place()
        found = {}
        for info in fs.get_file_info(FileSelector(base, recursive=True, allow_not_found=True)):
            name = info.path[len(base.rstrip("/")) + 1 :]
            hidden = any(p.startswith((".", "_")) for p in name.split("/"))
            if info.type == FileType.File and not hidden and fnmatch(name.rpartition("/")[2], self.match):
                with fs.open_input_file(info.path) as f:
                    if upto := _whole(f, info.size):
                        found[name] = upto
        return found

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for path, upto in sorted(end.items()):
            first = start.get(path, 0)
            out += [_Range(path, first, at, min(at + self.chunk, upto), upto) for at in range(first, upto, self.chunk)]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, first, start, end, upto = partition.value
        fs, base = self._place()
        with fs.open_input_file(f"{base.rstrip('/')}/{path}") as source:
            f = io.BufferedReader(source, 1 << 20)
            at = start
            if start > first:  # a line belongs to the range in which it begins
                f.seek(start - 1)
                at = start - 1 + len(f.readline())
            else:
                f.seek(start)
            places, values = [], []
            while at < min(end, upto):
                line = f.readline()
                places.append(at)
                values.append(line.rstrip(b"\n").removesuffix(b"\r").decode("utf-8", "replace"))
                at += len(line)
                if len(places) == ROWS:
                    yield _batch(path, places, values)
                    places, values = [], []
            if places:
                yield _batch(path, places, values)


def _batch(path: str, places: list[int], values: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([path] * len(places)), pa.array(places, pa.int64()), pa.array(values)], ["path", "position", "value"])


def _whole(f: pa.NativeFile, size: int) -> int:
    """The place after a file's last line end."""
    while size > 0:
        low = max(0, size - BLOCK)
        at = f.read_at(size - low, low).rfind(b"\n")
        if at >= 0:
            return low + at + 1
        size = low
    return 0


class AppendedLines(DataSource):
    """``(path, position, value)`` of each whole line below ``path``; ``match`` is a glob of file names, ``chunkBytes`` what a task reads at most.

    Files and folders whose names begin with a dot or a low line are not read.
    Where a file shrinks, what is appended beyond its new end is read.
    """

    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return "path string, position long, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options)
