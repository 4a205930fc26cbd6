"""Scans: tables, CSV, JSON lines, dictionaries, XML translation memories, folders, text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions.detect import file_kind

FEEDBACK = "timestamp string, image_id string, original_text string, corrected_text string, status string"


def tables(spark: SparkSession) -> DataFrame:
    """Names of the catalog's tables and views."""
    return spark.createDataFrame([(t.name, t.tableType) for t in spark.catalog.listTables()], "name string, kind string")


def feedback_csv(spark: SparkSession, path: str) -> DataFrame:
    """Feedback rows; a byte order mark before the header does no harm, since columns go by position."""
    return spark.read.schema(FEEDBACK).option("header", True).option("enforceSchema", True).option("multiLine", True).option("escape", '"').csv(path)


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines with bad ones in _corrupt_record; blank lines are skipped."""
    reader = spark.read.option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def json_array(spark: SparkSession, path: str) -> DataFrame:
    """A file that is one JSON array or object."""
    return spark.read.option("multiLine", True).json(path)


def dictionary_csv(spark: SparkSession, path: str) -> DataFrame:
    """term, definition pairs."""
    return spark.read.schema("term string, definition string").option("header", True).csv(path).where(F.trim("term") != "")


def dictionary_lines(spark: SparkSession, path: str, separator: str = "\t") -> DataFrame:
    """term, definition from lines with a separator; others are dropped, comments (#) too."""
    import re

    cut = F.split("value", re.escape(separator), 2)
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & F.col("value").contains(separator))
    return rows.select(F.trim(cut[0]).alias("term"), F.trim(cut[1]).alias("definition"))


def translation_memory(spark: SparkSession, path: str, source: str, target: str) -> DataFrame:
    """tu_id, source_text, target_text of a TMX file's units, by language prefix of each variant."""
    schema = "_tuid string, note array<string>, tuv array<struct<`_xml:lang`:string,_lang:string,seg:string>>"
    rows = spark.read.format("xml").option("rowTag", "tu").schema(schema).load(path)
    pick = lambda lang: F.get(F.filter("tuv", lambda v: F.lower(F.coalesce(v["_xml:lang"], v["_lang"])).startswith(lang.lower())), F.lit(0)).seg
    out = rows.select(F.col("_tuid").alias("tu_id"), F.trim(pick(source)).alias("source_text"), F.trim(pick(target)).alias("target_text"), F.array_join("note", "; ").alias("notes"))
    return out.where("source_text is not null and target_text is not null")


def best_units(units: DataFrame, confidence: str) -> DataFrame:
    """Of units alike in lower-cased trimmed texts the most confident, then the first by id."""
    from lexforge.operators.relational import top_per_key

    keyed = units.withColumn("__s", F.lower(F.trim("source_text"))).withColumn("__t", F.lower(F.trim("target_text")))
    return top_per_key(keyed, ["__s", "__t"], [F.desc(confidence), F.col("tu_id")]).drop("__s", "__t")


def folder(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, length, modified, kind of the files under a folder, without their contents."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return rows.select("path", "length", F.col("modificationTime").alias("modified"), file_kind(F.col("path")).alias("kind"))


def fingerprints(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, sha256 of the contents."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return rows.select("path", F.sha2("content", 256).alias("sha256"))


def pending(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Files whose hash was not seen."""
    return files.join(seen.select("sha256"), "sha256", "left_anti")


def search_texts(spark: SparkSession, path: str, needle: str, around: int = 100) -> DataFrame:
    """path, snippet of the text files that hold needle, any case."""
    from lexforge.functions.normalize import snippet
    from lexforge.operators.relational import escape_like

    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).withColumn("path", F.col("_metadata.file_path"))
    return rows.where(F.col("value").ilike(f"%{escape_like(needle)}%")).select("path", snippet(F.col("value"), needle, around).alias("snippet"))


def import_dictionaries(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """term, definition, file of every dictionary under a folder."""
    rows = spark.read.schema("term string, definition string").option("header", True).option("pathGlobFilter", glob).option("recursiveFileLookup", True).csv(path)
    return rows.withColumn("file", F.col("_metadata.file_path"))


def zip_listing(spark: SparkSession, path: str) -> DataFrame:
    """archive, name, size of the members of zip files."""
    import io
    import zipfile

    import pandas as pd

    def run(frames):
        for frame in frames:
            rows = [(p, m.filename, m.file_size) for p, c in zip(frame["path"], frame["content"], strict=True) for m in zipfile.ZipFile(io.BytesIO(c)).infolist()]
            yield pd.DataFrame(rows, columns=["archive", "name", "size"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content").mapInPandas(run, "archive string, name string, size long")
