"""A paged remote source as a Python DataSource: documents of a service that lists pages by time of update, newest first.
The service is a callable, so that no network is needed where it is a local one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: A page's size.
PAGE = 100
SCHEMA = "id string, filepath string, content string, status string, updated_at string, type string, url string"


def pages(fetch: Callable[[int, int], list[dict]], last_seen: str | None = None, page: int = PAGE) -> Iterator[dict]:
    """SRC-17, STR-01: documents newer than the watermark; paging ends at the first that isn't."""
    number = 0
    while rows := fetch(number, page):
        for row in rows:
            if last_seen is not None and row["updated_at"] <= last_seen:
                return
            yield row
        if len(rows) < page:
            return
        number += 1


class JsonlPages(DataSource):
    """The same over a JSON-lines file of documents, sorted by updated_at, newest first, a partition for each page."""

    @classmethod
    def name(cls) -> str:
        return "corpusloom_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Page(InputPartition):
    def __init__(self, number: int):
        super().__init__(number)
        self.number = number


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.last, self.page = options["path"], options.get("last_seen"), int(options.get("page", PAGE))

    def partitions(self) -> list[InputPartition]:
        with open(self.path, encoding="utf-8") as f:
            n = sum(1 for _ in f)
        return [_Page(i) for i in range(-(-n // self.page))] or [_Page(0)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        import itertools
        import json

        with open(self.path, encoding="utf-8") as f:
            for line in itertools.islice(f, partition.number * self.page, (partition.number + 1) * self.page):
                row = json.loads(line)
                if self.last is not None and row["updated_at"] <= self.last:
                    return
                yield tuple(row.get(c.split()[0]) for c in SCHEMA.split(", "))
