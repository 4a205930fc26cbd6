"""Binary dictionaries: StarDict sets and gzip-packed record files, decoded where the files are read."""

from __future__ import annotations

import gzip
import re
import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_info(text: str) -> dict[str, str]:
    """key=value lines of an .ifo file."""
    return dict(line.split("=", 1) for line in text.splitlines() if "=" in line)


def parse_index(data: bytes, wide: bool = False) -> list[tuple[str, int, int]]:
    """(word, offset, size) of an .idx file: zero-ended word, big-endian offset (64 bits if wide), size."""
    out, at, shape = [], 0, ">QI" if wide else ">II"
    step = struct.calcsize(shape)
    while at < len(data):
        end = data.index(b"\0", at)
        offset, size = struct.unpack_from(shape, data, end + 1)
        out.append((data[at:end].decode("utf-8", "replace"), offset, size))
        at = end + 1 + step
    return out


def parse_synonyms(data: bytes) -> list[tuple[str, int]]:
    """(synonym, index of its word) of a .syn file."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\0", at)
        out.append((data[at:end].decode("utf-8", "replace"), struct.unpack_from(">I", data, end + 1)[0]))
        at = end + 5
    return out


def _maybe_gzip(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def stardict(spark: SparkSession, path: str) -> DataFrame:
    """dictionary, term, definition, synonym_of of every StarDict set in a folder.

    The files of a set are grouped by their stem; a set is one dictionary, read in one task.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    stem = F.regexp_replace("path", r"\.(ifo|idx(\.gz)?|dict(\.dz)?|syn)$", "")
    part = F.regexp_extract("path", r"\.(ifo|idx|dict|syn)(\.gz|\.dz)?$", 1)
    files = rows.withColumn("stem", stem).withColumn("part", part).where("part <> ''")
    sets = files.groupBy("stem").agg(*[F.max(F.when(F.col("part") == p, F.col("content"))).alias(p) for p in ("ifo", "idx", "dict", "syn")]).where("idx is not null and dict is not null")

    def run(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                info = parse_info(r.ifo.decode("utf-8", "replace")) if r.ifo is not None else {}
                words = parse_index(_maybe_gzip(r.idx), info.get("idxoffsetbits") == "64")
                body = _maybe_gzip(r.dict)
                name = info.get("bookname", r.stem.rsplit("/", 1)[-1])
                texts = [body[o : o + n].decode("utf-8", "replace").lstrip("\0") for _, o, n in words]
                out += [(name, w, t, None) for (w, _, _), t in zip(words, texts, strict=True)]
                if r.syn is not None:
                    out += [(name, s, texts[i], words[i][0]) for s, i in parse_synonyms(r.syn) if i < len(words)]
            yield pd.DataFrame(out, columns=["dictionary", "term", "definition", "synonym_of"])

    return sets.select("stem", "ifo", "idx", "dict", "syn").mapInPandas(run, "dictionary string, term string, definition string, synonym_of string")


def unpack_records(data: bytes) -> list[tuple[int, bytes]]:
    """(type, payload) records of a packed dictionary.

    The gzip stream starts at the big-endian offset in bytes 4-5. A record's first byte holds its
    type in the low four bits; high bits under 4 say that 1 to 4 length bytes follow, else the
    length is those bits less 4.
    """
    body = gzip.decompress(data[struct.unpack_from(">H", data, 4)[0] :])
    out, at = [], 0
    while at < len(body):
        kind, size = body[at] & 0x0F, body[at] >> 4
        at += 1
        if kind == 4:
            break
        if size < 4:
            length = int.from_bytes(body[at : at + size + 1], "big")
            at += size + 1
        else:
            length = size - 4
        out.append((kind, body[at : at + length]))
        at += length
    return out


def entry_of(payload: bytes, encoding: str) -> tuple[str, str]:
    """(term, definition) of an entry record: length byte, term, two length bytes, definition."""
    n = payload[0]
    term = payload[1 : 1 + n]
    size = struct.unpack_from(">H", payload, 1 + n)[0]
    body = payload[3 + n : 3 + n + size].split(b"\x14", 1)[0]
    clean = lambda b: re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", b.decode(encoding, "replace")).strip()
    return clean(term), clean(body)


def packed_dictionaries(spark: SparkSession, path: str, glob: str = "*.bgl", encoding: str = "utf-8") -> DataFrame:
    """file, term, definition of gzip-packed dictionaries (entry records of type 1, 7, 10 and 13)."""

    def run(frames):
        for frame in frames:
            out = []
            for p, content in zip(frame["path"], frame["content"], strict=True):
                out += [(p, *entry_of(b, encoding)) for kind, b in unpack_records(content) if kind in (1, 7, 10, 13)]
            yield pd.DataFrame(out, columns=["file", "term", "definition"])

    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return rows.select("path", "content").mapInPandas(run, "file string, term string, definition string")
