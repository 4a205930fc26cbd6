"""Files of a folder as a stream, each once it has settled.

A file is ready when two looks at least settleSeconds apart show it with the same size and time of
change; one that is still written waits for a later batch. The stream's offset is the set of settled
files that the folder holds, each with its size and time, so it is as long as the folder's listing,
names of deleted files leave it, and a file that is written anew comes again as a new version. A
batch is the difference of two such sets, split by bytes over tasks; contents are read there, in
pieces of a megabyte. Empty files give one empty piece; a folder that is not there is empty. A file
that vanished or changed between the look and the read gives one row that says so in error.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

PIECE = 1 << 20


def _located(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def files_under(root: str, endings: tuple[str, ...] = ()) -> list[tuple[str, int, int]]:
    """path, size and time of change in microseconds of the files under a path, or of that file, by path."""
    from pyarrow import fs

    system, base = _located(root)
    there = system.get_file_info(base)
    found = [there] if there.type == fs.FileType.File else system.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True))
    return sorted((f.path, f.size, (f.mtime_ns or 0) // 1000) for f in found if f.type == fs.FileType.File and (not endings or f.path.lower().endswith(endings)))


def opened(root: str, path: str):
    """A file of files_under, open for reading and seeking."""
    return _located(root)[0].open_input_file(path)


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int, int]]) -> None:
        self.files = files


class _Stream(DataSourceStreamReader):
    def __init__(self, options) -> None:
        self.root = options["path"]
        self.endings = tuple(e for e in options.get("endings", "").lower().split(",") if e)
        self.settle, self.split = float(options.get("settleSeconds", 2)), int(options.get("splitBytes", 1 << 27))
        self.looked: tuple[float, dict[str, list[int]]] | None = None

    def _look(self) -> dict[str, list[int]]:
        return {p: [size, at] for p, size, at in files_under(self.root, self.endings)}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        if self.looked is None:
            self.looked = (time.monotonic(), self._look())
        began, before = self.looked
        time.sleep(max(0.0, began + self.settle - time.monotonic()))
        now = self._look()
        self.looked = (time.monotonic(), now)
        return {"files": {p: v for p, v in now.items() if before.get(p) == v}}

    def partitions(self, start: dict, end: dict):
        shares: list[list[tuple[str, int, int]]] = [[]]
        total = 0
        for path, (size, at) in sorted(end["files"].items()):
            if start["files"].get(path) == [size, at]:
                continue
            if shares[-1] and total + size > self.split:
                shares.append([])
                total = 0
            shares[-1].append((path, size, at))
            total += size
        return [_Files(s) for s in shares]

    def read(self, partition) -> Iterator[tuple]:
        for path, size, at in partition.files:
            changed = datetime.fromtimestamp(at / 1e6, UTC)
            part = left = 0
            try:
                with opened(self.root, path) as f:
                    if f.size() != size:
                        yield path, size, changed, 0, None, "changed"
                        continue
                    left = size
                    while left or not part:
                        data = f.read(min(PIECE, left))
                        if left and not data:
                            raise EOFError("changed")
                        yield path, size, changed, part, data, None
                        part, left = part + 1, left - len(data)
            except (OSError, EOFError) as fault:
                yield path, size, changed, part, None, str(fault)

    def commit(self, end: dict) -> None:
        pass


class SettledFiles(DataSource):
    """path, size, modified, part, data, error; options path, endings (comma-joined), settleSeconds,
    splitBytes. Register with spark.dataSource.register."""

    @classmethod
    def name(cls) -> str:
        return "settled_files"

    def schema(self) -> str:
        return "path string, size long, modified timestamp, part int, data binary, error string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)
