"""Nested archives and settled files, made here."""

import bz2
import gzip
import hashlib
import io
import lzma
import os
import tarfile
import zipfile

import pytest

from lexforge.plans.archived import _tar, _zip
from lexforge.sources import archives, watch


def found(data: bytes, name: str = "", **options):
    return list(archives.digests(archives.walk(io.BytesIO(data), archives.kind_of(name, data[:512]), **options)))


def row(member: str, depth: int, data: bytes):
    return (member, depth, len(data), hashlib.sha256(data).hexdigest(), None)


BIG = bytes(range(256)) * 10_000


@pytest.mark.parametrize("hold", [archives.HOLD, 10])
def test_members_at_every_depth(monkeypatch, hold):
    monkeypatch.setattr(archives, "HOLD", hold)  # below 10 bytes held, else read where it lies
    inner = _zip({"x.txt": b"x", "big.bin": BIG, "none": b""})
    data = _zip({"a.txt": b"a", "in.tar.gz": _tar({"d/b.txt": b"b", "c.zip": inner}, "w:gz"), "e.gz": gzip.compress(BIG), "f.bz2": bz2.compress(b"f"), "g.xz": lzma.compress(b"g")})
    want = [row("a.txt", 0, b"a"), row("in.tar.gz!/d/b.txt", 1, b"b"), row("in.tar.gz!/c.zip!/x.txt", 2, b"x"), row("in.tar.gz!/c.zip!/big.bin", 2, BIG), row("in.tar.gz!/c.zip!/none", 2, b"")]
    want += [row("e.gz!/content", 1, BIG), row("f.bz2!/content", 1, b"f"), row("g.xz!/content", 1, b"g")]
    assert found(data) == want


def test_depth_bound_keeps_the_archive_itself():
    inner = _zip({"x": b"x"})
    assert found(_zip({"i.zip": inner, "j.docx": inner}), max_depth=0) == [row("i.zip", 0, inner), row("j.docx", 0, inner)]
    assert found(_zip({"j.docx": inner})) == [row("j.docx", 0, inner)]


def test_faults_name_the_member_and_the_rest_goes_on():
    sound = _zip({"x": b"x" * 100})
    got = found(_zip({"bad.zip": b"no zip", "cut.tar.gz": gzip.compress(os.urandom(5000))[:2000], "ok.zip": sound}))
    assert [(r[0], r[2] is None, r[4] is None) for r in got] == [("bad.zip", True, False), ("cut.tar.gz", True, False), ("ok.zip!/x", False, True)]
    assert found(b"") == [("", 0, None, None, "not an archive")] and found(b"plain") == [("", 0, None, None, "not an archive")]
    assert found(_zip({})) == []
    flipped = bytearray(_zip({"x": os.urandom(3000), "y": b"y"}))
    flipped[500] ^= 255
    got = found(bytes(flipped))
    assert got[0][0] == "x" and got[0][4] and got[1] == row("y", 0, b"y")


def test_folders_links_and_repeated_names():
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for kind in (tarfile.DIRTYPE, tarfile.SYMTYPE):
            entry = tarfile.TarInfo("d")
            entry.type = kind
            t.addfile(entry)
        for data in (b"1", b"22"):
            entry = tarfile.TarInfo("r")
            entry.size = len(data)
            t.addfile(entry, io.BytesIO(data))
    assert found(out.getvalue()) == [row("r", 0, b"1"), row("r", 0, b"22")]


def test_columns_come_back_as_they_were(spark):
    data = _zip({"a": b"a", "b": b""})
    df = spark.createDataFrame([(None, data, "n"), (2**60, None, None), (7, bytearray(b"zz"), "x")], "member long, c binary, n string")
    got = sorted((str(r[0]), r[1], r[2], r[3], r[5]) for r in archives.archive_members(df.withColumnRenamed("member", "id"), ["id"], "c", "n").collect())
    assert got == [("1152921504606846976", "", 0, None, "null"), ("7", "", 0, None, "not an archive"), ("None", "a", 0, 1, None), ("None", "b", 0, 0, None)]
    assert archives.archive_members(df.limit(0), ["n"], "c").count() == 0
    parts = archives.archive_pieces(spark.createDataFrame([(1, _zip({"big": BIG}))], "id int, c binary"), ["id"], "c").orderBy("part").collect()
    assert len(parts) == 3 and b"".join(bytes(r.data) for r in parts) == BIG


def test_archive_files_in_shares(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "large.zip", "w") as z:
        for i in range(40):
            z.writestr(f"{i}.bin", os.urandom(2000) + bytes([i]))
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "small.tar.gz").write_bytes(_tar({"t": b"t", "z.zip": _zip({"u": b"u"})}, "w:gz"))
    (tmp_path / "note.txt").write_text("no archive")
    (tmp_path / "broken.zip").write_bytes(b"x" * 30_000)
    spark.dataSource.register(archives.ArchiveFiles)
    df = spark.read.format("archive_files").option("splitBytes", 20_000).load(str(tmp_path))
    assert df.rdd.getNumPartitions() >= 5
    rows = df.collect()
    assert sorted(r.member for r in rows if r.archive.endswith("large.zip")) == sorted(f"{i}.bin" for i in range(40))
    assert sorted(r.member for r in rows if r.archive.endswith(".gz")) == ["t", "z.zip!/u"]
    assert [r.error is not None for r in rows if r.archive.endswith("broken.zip")] == [True]
    assert not [r for r in rows if r.archive.endswith("note.txt")]


def test_growing_file_waits(tmp_path):
    reader = watch._Stream({"path": str(tmp_path), "settleSeconds": "0.05", "endings": ".txt"})
    assert reader.latestOffset() == {"files": {}}
    (tmp_path / "a.txt").write_text("a")
    (tmp_path / "skip.bin").write_text("b")
    assert reader.latestOffset() == {"files": {}}  # seen once
    (tmp_path / "a.txt").write_text("aa")
    assert reader.latestOffset() == {"files": {}}  # still growing
    settled = reader.latestOffset()
    read = lambda start, end: [(r[0].rsplit("/", 1)[1], r[3], r[4]) for p in reader.partitions(start, end) for r in reader.read(p)]
    assert read(reader.initialOffset(), settled) == [("a.txt", 0, b"aa")]
    (tmp_path / "a.txt").write_text("third")
    (tmp_path / "e.txt").write_text("")
    reader.latestOffset()
    later = reader.latestOffset()
    assert sorted(read(settled, later)) == [("a.txt", 0, b"third"), ("e.txt", 0, b"")]
    os.remove(tmp_path / "a.txt")
    assert [r[5] is not None for p in reader.partitions(settled, later) for r in reader.read(p) if r[0].endswith("a.txt")] == [True]
    assert read(later, reader.latestOffset()) == []


def test_settled_files_as_a_stream(spark, tmp_path):
    source, sink, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    (source / "one.txt").write_bytes(BIG)
    spark.dataSource.register(watch.SettledFiles)

    def run():
        stream = spark.readStream.format("settled_files").option("settleSeconds", 0.2).load(str(source))
        stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(sink).awaitTermination()
        return spark.read.parquet(sink)

    assert b"".join(bytes(r.data) for r in run().orderBy("part").collect()) == BIG
    (source / "two.txt").write_text("2")
    assert sorted({r.path.rsplit("/", 1)[1] for r in run().collect()}) == ["one.txt", "two.txt"]
    assert run().count() == 4  # three pieces and one, none twice
