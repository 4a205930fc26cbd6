"""A polling source with a high-water mark, as a Python data source for batch and stream reads."""

from __future__ import annotations

import json
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, SimpleDataSourceStreamReader


def _fetch(url: str, since: float, limit: int) -> list[dict]:
    with urllib.request.urlopen(f"{url}?since={since}&limit={limit}", timeout=30) as answer:  # noqa: S310
        return json.load(answer)


class _Batch(DataSourceReader):
    def __init__(self, options) -> None:
        self.options = options

    def read(self, partition):
        for r in _fetch(self.options["url"], float(self.options.get("since", 0)), int(self.options.get("limit", 1000))):
            yield (str(r.get("id")), r.get("original"), r.get("corrected"), float(r.get("ts", 0)))


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, options) -> None:
        self.options = options

    def initialOffset(self) -> dict:
        return {"since": float(self.options.get("since", 0))}

    def read(self, start: dict):
        rows = [(str(r.get("id")), r.get("original"), r.get("corrected"), float(r.get("ts", 0))) for r in _fetch(self.options["url"], start["since"], int(self.options.get("limit", 1000)))]
        return iter(rows), {"since": max([start["since"], *(r[3] for r in rows)])}

    def readBetweenOffsets(self, start: dict, end: dict):
        rows, _ = self.read(start)
        return iter([r for r in rows if start["since"] < r[3] <= end["since"]])


class ReviewedCorrections(DataSource):
    """id, original, corrected, ts from an HTTP endpoint; register with spark.dataSource.register."""

    @classmethod
    def name(cls) -> str:
        return "reviewed_corrections"

    def schema(self) -> str:
        return "id string, original string, corrected string, ts double"

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(self.options)
