"""Readers and writers on files made here."""

import gzip
import struct

from pyspark.sql import functions as F

from lexforge.operators import export as X
from lexforge.sources import binary, readers


def test_feedback_csv_with_mark(spark, tmp_path):
    (tmp_path / "f.csv").write_bytes("﻿timestamp,image_id,original_text,corrected_text,status\n1,2,a,b,verified\n".encode())
    row = readers.feedback_csv(spark, str(tmp_path / "f.csv")).first()
    assert (row.timestamp, row.corrected_text) == ("1", "b")


def test_json_lines_keep_bad_rows(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\nnot json\n')
    df = readers.json_lines(spark, str(tmp_path / "a.jsonl"), "x int, _corrupt_record string").cache()
    assert df.count() == 2 and df.where("_corrupt_record is not null").count() == 1


def test_translation_memory_round_trip(spark, tmp_path):
    (tmp_path / "m.tmx").write_text('<?xml version="1.0"?><tmx><body><tu tuid="1"><note>n</note><tuv xml:lang="en-US"><seg> bone </seg></tuv><tuv xml:lang="ar"><seg>عظم</seg></tuv></tu><tu tuid="2"><tuv xml:lang="en"><seg>x</seg></tuv></tu></body></tmx>')
    rows = readers.translation_memory(spark, str(tmp_path / "m.tmx"), "en", "ar").collect()
    assert [(r.tu_id, r.source_text, r.target_text) for r in rows] == [("1", "bone", "عظم")]
    X.write_xml(spark.createDataFrame([("a", "b")], "s string, t string"), str(tmp_path / "out"))
    assert spark.read.format("xml").option("rowTag", "tu").load(str(tmp_path / "out")).first().s == "a"


def test_best_units(spark):
    df = spark.createDataFrame([("1", "A ", "x", 0.5), ("2", "a", "X", 0.9), ("3", "b", "y", 0.1)], "tu_id string, source_text string, target_text string, c double")
    assert sorted(r.tu_id for r in readers.best_units(df, "c").collect()) == ["2", "3"]


def test_stardict(spark, tmp_path):
    (tmp_path / "d.ifo").write_text("StarDict's dict ifo file\nbookname=Bones\nwordcount=2\n")
    (tmp_path / "d.idx").write_bytes(b"femur\0" + struct.pack(">II", 0, 5) + b"tibia\0" + struct.pack(">II", 5, 4))
    (tmp_path / "d.dict.dz").write_bytes(gzip.compress(b"thighshin"))
    (tmp_path / "d.syn").write_bytes(b"shank\0" + struct.pack(">I", 1))
    rows = sorted((r.term, r.definition, r.synonym_of) for r in binary.stardict(spark, str(tmp_path)).collect())
    assert rows == [("femur", "thigh", None), ("shank", "shin", "tibia"), ("tibia", "shin", None)]


def test_packed_dictionary(spark, tmp_path):
    term, text = b"femur", b"thigh bone"
    payload = bytes([len(term)]) + term + struct.pack(">H", len(text)) + text
    body = bytes([0x01]) + bytes([len(payload)]) + payload + bytes([0x04])
    (tmp_path / "x.bgl").write_bytes(b"\x12\x34\x00\x01" + struct.pack(">H", 6) + gzip.compress(body))
    row = binary.packed_dictionaries(spark, str(tmp_path)).first()
    assert (row.term, row.definition) == ("femur", "thigh bone")


def test_folder_and_search(spark, tmp_path):
    (tmp_path / "a.txt").write_text("the needle is here")
    (tmp_path / "b.png").write_bytes(b"1")
    assert {r.kind for r in readers.folder(spark, str(tmp_path)).collect()} == {"text", "image"}
    assert "needle" in readers.search_texts(spark, str(tmp_path / "a.txt"), "NEEDLE").first().snippet
    seen = readers.fingerprints(spark, str(tmp_path), "*.png")
    assert readers.pending(readers.fingerprints(spark, str(tmp_path)), seen).count() == 1


def test_dictionary_lines(spark, tmp_path):
    (tmp_path / "d.dic").write_text("# c\nbone\tعظم\nnothing\n")
    assert [tuple(r) for r in readers.dictionary_lines(spark, str(tmp_path / "d.dic")).collect()] == [("bone", "عظم")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("a", "train"), ("b", "test")], "x string, split string")
    X.write_split(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).where("split = 'test'").first().x == "b"
    X.append_log(df, str(tmp_path / "log"))
    X.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    table = df.select(X.markdown_table(["x"], F.array(F.array("x"))).alias("m")).first().m
    assert table == "| x |\n|---|\n| a |"
