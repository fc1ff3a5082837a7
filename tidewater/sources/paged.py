"""A data source that reads a census page by page from anything that gives a page by its number."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Page(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class PagedCensus(DataSource):
    """``format("tidewater_pages")`` with options ``folder`` (files ``<n>.jsonl``), ``pages`` and ``per_task``.

    Pages are read until one is missing or empty; the pages read before a broken one stay. Each task reads a range.
    """

    @classmethod
    def name(cls) -> str:
        return "tidewater_pages"

    def schema(self) -> str:
        return "page int, content_ts double, text string, high_like boolean, mid_hash string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.pages, self.per_task = options["folder"], int(options.get("pages", 1)), int(options.get("per_task", 10))

    def partitions(self) -> list[_Page]:
        return [_Page(n, min(self.pages, n + self.per_task - 1)) for n in range(1, self.pages + 1, self.per_task)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        for n in range(partition.first, partition.last + 1):
            try:
                with open(f"{self.folder}/{n}.jsonl", encoding="utf-8") as f:
                    rows = [json.loads(x) for x in f if x.endswith("\n")]
            except (OSError, ValueError):
                return
            if not rows:
                return
            for r in rows:
                yield n, r.get("content_ts"), r.get("text"), bool(r.get("high_like")), r.get("mid_hash") or ""
