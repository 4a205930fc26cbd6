"""Queries of nested archives, made of the documents."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lexforge.plans.base import query
from lexforge.session import table, text_runs
from lexforge.sources.archives import archive_members


def _zip(members: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as archive:
        for name, data in members.items():
            archive.writestr(name, data)
    return out.getvalue()


def _tar(members: dict[str, bytes], mode: str) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode, **({"compresslevel": 1} if mode == "w:gz" else {})) as archive:
        for name, data in members.items():
            entry = tarfile.TarInfo(name)
            entry.size = len(data)
            archive.addfile(entry, io.BytesIO(data))
    return out.getvalue()


def _archived(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A zip of the text and of a compressed tar that holds a zip and a tar in turn; null: empty."""
    for piece in (p for batch in batches for p in text_runs(batch, "text")):
        rows = (((v.as_py() or "").encode() for v in piece.column(c)) for c in ("text", "lang", "source"))
        made = [_zip({"text.txt": t, "more.tar.gz": _tar({"a/lang.txt": v, "deep.zip": _zip({"source.txt": s, "old.tar": _tar({"text.txt": t}, "w")})}, "w:gz")}) for t, v, s in zip(*rows, strict=True)]
        yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(made, pa.binary())], ["doc_id", "c"])


_MEMBERS = {"text.txt": (0, "text"), "more.tar.gz!/a/lang.txt": (1, "lang"), "more.tar.gz!/deep.zip!/source.txt": (2, "source"), "more.tar.gz!/deep.zip!/old.tar!/text.txt": (3, "text")}


@query(" UNION ALL ".join(f"SELECT doc_id, '{m}' AS member, {d}::INTEGER AS depth, strlen(coalesce({c}, ''))::BIGINT AS size, sha256(coalesce({c}, '')) AS sha256, NULL::VARCHAR AS error FROM documents" for m, (d, c) in _MEMBERS.items()))
def nested_archives(spark: SparkSession, d: str) -> DataFrame:
    """Members of an archive per document, four archives deep: path, depth, bytes and digest."""
    made = table(spark, d, "documents").select("doc_id", "text", "lang", "source").mapInArrow(_archived, "doc_id long, c binary")
    return archive_members(made, ["doc_id"], "c")
