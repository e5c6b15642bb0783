"""A paged web source as a Spark data source, with its date range and projection pushed into the request."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Iterator
from datetime import UTC, date, datetime, timedelta
from urllib.parse import urlencode, urlsplit, urlunsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The widest window and a page's rows.
MOST_DAYS, PAGE = 90, 1000


def window(days: int, today: date) -> tuple[date, date]:
    """Both days included."""
    if not 1 <= days <= MOST_DAYS:
        raise ValueError(f"days must be from 1 to {MOST_DAYS}")
    return today - timedelta(days=days - 1), today


def request_url(base: str, start: date | None = None, end: date | None = None, pending: bool = False, balances_only: bool = False) -> str:
    """Address of a request; user and password are left out, the range is half open in epoch seconds."""
    at = lambda d: int(datetime(d.year, d.month, d.day, tzinfo=UTC).timestamp())
    query = {}
    if start:
        query["start-date"] = at(start)
    if end:
        query["end-date"] = at(end + timedelta(days=1))
    if pending:
        query["pending"] = 1
    if balances_only:
        query["balances-only"] = 1
    parts = urlsplit(base)
    return urlunsplit((parts.scheme, parts.netloc.rpartition("@")[2], parts.path.rstrip("/") + "/accounts", urlencode(query), ""))


class PagedSource(DataSource):
    """``spark.read.format("paged").schema(...).option("url", ...)``: pages of JSON rows until one is short.

    Options: url (with {page} and {size}), pages (read in parallel; 1: in order, as the number is not known), size.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "id string, body string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options, schema)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.url, self.size, self.count = options["url"], int(options.get("size", PAGE)), int(options.get("pages", 1))
        self.names = [f.name for f in schema.fields]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(k) for k in range(self.count)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        page = partition.value
        while True:
            with urllib.request.urlopen(self.url.format(page=page, size=self.size), timeout=120) as reply:
                rows = json.load(reply)
            for row in rows:
                yield tuple(json.dumps(row) if n == "body" else row.get(n) for n in self.names)
            if len(rows) < self.size or self.count > 1 and page + self.count >= 1 << 31:
                return
            page += self.count
