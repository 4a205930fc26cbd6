"""Members of archives, nested ones included, read as streams.

zip, tar (plain or compressed), gz, bz2 and xz are opened, and so are members with such names, down to
max_depth archives; an archive below that comes back as a member like any other, so nothing is lost.
A member's path joins the names of the archives around it by !/. Members are read in pieces of a
megabyte; a nested archive of at most HOLD bytes is held in memory, a longer one is read where it
lies, by decompressing up to the place wanted. Folders and links are no members; repeated names come
back repeatedly. What cannot be read (damaged, encrypted, unknown kind, null) gives one row that
names it in error, and the rest of the archive goes on where its format allows that.
"""

from __future__ import annotations

import bz2
import gzip
import hashlib
import io
import lzma
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import IO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Endings of archive names and first bytes of archives.
ENDINGS = {".zip": "zip", ".tar": "tar", ".tgz": "tar", ".tar.gz": "tar", ".tbz2": "tar", ".tar.bz2": "tar", ".txz": "tar", ".tar.xz": "tar", ".gz": "gz", ".bz2": "bz2", ".xz": "xz"}
MAGIC = {b"PK\x03\x04": "zip", b"PK\x05\x06": "zip", b"\x1f\x8b": "gz", b"BZh": "bz2", b"\xfd7zXZ\x00": "xz"}
SINGLE = {"gz": gzip.open, "bz2": bz2.open, "xz": lzma.open}
FAULTS = (zipfile.BadZipFile, tarfile.TarError, lzma.LZMAError, zlib.error, EOFError, OSError, ValueError, RuntimeError, NotImplementedError)
PIECE, HOLD = 1 << 20, 1 << 26

Member = tuple[str, int, IO[bytes] | None, str | None]  # path, depth, opened member or what went wrong


def kind_of(name: str, head: bytes | None = None) -> str | None:
    """Kind of archive by the longest known ending of its name, else by its first bytes if given."""
    named = [e for e in ENDINGS if name.lower().endswith(e)]
    if named:
        return ENDINGS[max(named, key=len)]
    if head is None:
        return None
    return "tar" if head[257:262] == b"ustar" else next((k for m, k in MAGIC.items() if head.startswith(m)), None)


def walk(file: IO[bytes], kind: str | None, prefix: str = "", depth: int = 0, max_depth: int = 16, lo: int = 0, hi: int | None = None) -> Iterator[Member]:
    """Members of an archive in its own order; lo and hi choose a range of a zip's entries."""
    try:
        if kind == "zip":
            with zipfile.ZipFile(file) as archive:
                for entry in archive.infolist()[lo:hi]:
                    if entry.is_dir():
                        continue
                    try:
                        member = archive.open(entry)
                    except FAULTS as fault:
                        yield prefix + entry.filename, depth, None, str(fault)
                        continue
                    with member:
                        yield from _enter(member, prefix + entry.filename, depth, max_depth)
        elif kind == "tar":
            with tarfile.open(fileobj=file, mode="r:*") as archive:
                for entry in archive:
                    if entry.isfile():
                        yield from _enter(archive.extractfile(entry), prefix + entry.name, depth, max_depth)
        elif kind in SINGLE:
            with SINGLE[kind](file) as member:
                yield from _enter(member, f"{prefix}content", depth, max_depth)
        else:
            yield prefix.removesuffix("!/"), depth, None, "not an archive"
    except FAULTS as fault:
        yield prefix.removesuffix("!/"), depth, None, str(fault) or type(fault).__name__


def _enter(member: IO[bytes], path: str, depth: int, max_depth: int) -> Iterator[Member]:
    kind = kind_of(path)
    if kind is None or depth >= max_depth:
        yield path, depth, member, None
        return
    try:
        held = member.read(HOLD + 1)
        if len(held) > HOLD:
            member.seek(0)
    except FAULTS as fault:
        yield path, depth, None, str(fault) or type(fault).__name__
        return
    inner = member if len(held) > HOLD else io.BytesIO(held)
    del held
    yield from walk(inner, kind, f"{path}!/", depth + 1, max_depth)


def pieces(members: Iterator[Member], size: int = PIECE) -> Iterator[tuple[str, int, int, bytes | None, str | None]]:
    """member, depth, part, data, error: a member's bytes in order, at least one row each."""
    for path, depth, file, error in members:
        part = 0
        while file is not None:
            try:
                data = file.read(size)
            except FAULTS as fault:
                error = str(fault) or type(fault).__name__
                break
            if data or not part:
                yield path, depth, part, data, None
            part += 1
            if len(data) < size:
                break
        if error is not None:
            yield path, depth, part, None, error


def digests(members: Iterator[Member]) -> Iterator[tuple[str, int, int | None, str | None, str | None]]:
    """member, depth, size, sha256, error: one row per member, size and sha256 null if it has an error."""
    path, depth, size, sha, fault, begun = "", 0, 0, hashlib.sha256(), None, False
    for path_, depth_, part, data, error in pieces(members):
        if begun and (part == 0 or fault is not None):
            yield path, depth, None if fault else size, None if fault else sha.hexdigest(), fault
            size, sha = 0, hashlib.sha256()
        path, depth, fault, begun = path_, depth_, error, True
        if data:
            size += len(data)
            sha.update(data)
    if begun:
        yield path, depth, None if fault else size, None if fault else sha.hexdigest(), fault


def _expand(df: DataFrame, keep: list[str], content: str, name: str | None, rows: Callable[[Iterator[Member]], Iterator[tuple]], schema: str, types: list[pa.DataType], names: list[str], max_depth: int) -> DataFrame:
    columns = [df[c].alias(f"k{i}") for i, c in enumerate(keep)]
    source = df.select(*columns, df[content].alias("c"), (df[name] if name else F.lit("")).alias("n"))

    def run(batches):
        for batch in batches:
            at: list[int] = []
            got: list[tuple] = []
            held = 0

            def out(batch=batch):
                arrays = [batch.column(f"k{i}").take(pa.array(at, pa.int64())) for i in range(len(keep))]
                arrays += [pa.array([r[j] for r in got], t) for j, t in enumerate(types)]
                return pa.RecordBatch.from_arrays(arrays, names=[*(f"k{i}" for i in range(len(keep))), *names])

            for i in range(batch.num_rows):
                data = batch.column("c")[i].as_py()
                if data is None:
                    found: Iterator[Member] = iter([("", 0, None, "null")])
                else:
                    found = walk(io.BytesIO(data), kind_of(batch.column("n")[i].as_py() or "", data[:512]), max_depth=max_depth)
                for row in rows(found):
                    at.append(i)
                    got.append(row)
                    held += sum(len(v) for v in row if isinstance(v, bytes)) + 256
                    if held > 16 * PIECE:
                        yield out()
                        at, got, held = [], [], 0
            if at:
                yield out()

    kept = ", ".join(f"k{i} {source.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep)))
    got = source.mapInArrow(run, f"{kept}, {schema}" if kept else schema)
    return got.select(*(got[f"k{i}"].alias(c) for i, c in enumerate(keep)), *names)


def archive_members(df: DataFrame, keep: list[str], content: str, name: str | None = None, max_depth: int = 16) -> DataFrame:
    """keep columns, member, depth, size, sha256, error of every member of the archives in a binary
    column; a name column tells their kind, else their first bytes do. An empty archive gives no row."""
    text = pa.string()
    return _expand(df, keep, content, name, digests, "member string, depth int, size long, sha256 string, error string", [text, pa.int32(), pa.int64(), text, text], ["member", "depth", "size", "sha256", "error"], max_depth)


def archive_pieces(df: DataFrame, keep: list[str], content: str, name: str | None = None, max_depth: int = 16) -> DataFrame:
    """keep columns, member, depth, part, data, error: the bytes of every member, a megabyte a row."""
    text = pa.string()
    return _expand(df, keep, content, name, pieces, "member string, depth int, part int, data binary, error string", [text, pa.int32(), pa.int32(), pa.binary(), text], ["member", "depth", "part", "data", "error"], max_depth)


class _Share(InputPartition):
    """Archives (path, first entry, end of entries) that one task reads."""

    def __init__(self, archives: list[tuple[str, int, int | None]]) -> None:
        self.archives = archives


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.root, self.split, self.depth = options["path"], int(options.get("splitBytes", 1 << 26)), int(options.get("maxDepth", 16))

    def partitions(self):
        """Small archives together, the entries of a large zip apart; only large zips are opened here,
        for their directories."""
        from lexforge.sources.watch import files_under, opened

        shares: list[list[tuple[str, int, int | None]]] = []
        small: list[tuple[str, int, int | None]] = []
        size = 0
        for path, length, _ in files_under(self.root):
            kind = kind_of(path)
            if kind is None:
                continue
            if length <= self.split or kind != "zip":
                if small and size + length > self.split:
                    shares.append(small)
                    small, size = [], 0
                small.append((path, 0, None))
                size += length
                continue
            try:
                with opened(self.root, path) as f, zipfile.ZipFile(f) as archive:
                    lengths = [e.compress_size for e in archive.infolist()]
            except FAULTS:
                shares.append([(path, 0, None)])  # its task reports the fault
                continue
            lo = total = 0
            for i, n in enumerate(lengths):
                total += n
                if total >= self.split or i + 1 == len(lengths):
                    shares.append([(path, lo, i + 1)])
                    lo, total = i + 1, 0
        if small:
            shares.append(small)
        return [_Share(s) for s in shares] or [_Share([])]

    def read(self, partition):
        from lexforge.sources.watch import opened

        for path, lo, hi in partition.archives:
            with opened(self.root, path) as f:
                for row in pieces(walk(f, kind_of(path), "", 0, self.depth, lo, hi)):
                    yield (path, *row)


class ArchiveFiles(DataSource):
    """archive, member, depth, part, data, error of the archives under a path of any file system that
    Arrow knows; options path, splitBytes, maxDepth. Register with spark.dataSource.register."""

    @classmethod
    def name(cls) -> str:
        return "archive_files"

    def schema(self) -> str:
        return "archive string, member string, depth int, part int, data binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
