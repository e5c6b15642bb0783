"""Provider payloads by windows of days: fetched, landed byte for byte, and only then read; as a table and as a stream.

The table takes a range of days from the query's filters into its requests; the stream's offsets are days, so a restart goes on
where it was. A window that has been landed is read from its file and not asked for again: neither by a task that is retried nor by a
query that runs twice. Without a ``root`` nothing is kept.

Spark 4.1 keeps the filters of a query with the loaded table, so a table that is loaded once and filtered twice would
be read by the first range again: ``payloads`` loads it anew for each range.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from urllib.parse import unquote, urlsplit
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from .api import MOST_DAYS, request_url

SCHEMA = "start date, end date, path string, sha256 string, body string"


@dataclass
class Window(InputPartition):
    start: date
    end: date


def windows(low: date, high: date, days: int) -> list[Window]:
    """Windows of up to so many days from ``low`` to ``high``, both included."""
    out = []
    while low <= high:
        out.append(Window(low, min(high, low + timedelta(days=days - 1))))
        low += timedelta(days=days)
    return out


def fetch(url: str, start: date, end: date, timeout: int = 180) -> bytes:
    """One window's payload; a user and password in the address are sent as a header."""
    request, parts = Request(request_url(url, start, end)), urlsplit(url)
    if parts.username:
        pair = f"{unquote(parts.username)}:{unquote(parts.password or '')}"
        request.add_header("Authorization", "Basic " + base64.b64encode(pair.encode()).decode())
    with urlopen(request, timeout=timeout) as reply:
        return reply.read()


class Landing:
    """Options of a source: url, root (URI of the landing folder), from and until (days), days (of a window)."""

    def __init__(self, options: dict):
        self.url, self.root, self.days = options["url"], options.get("root"), int(options.get("days", 45))
        if not 1 <= self.days <= MOST_DAYS:
            raise ValueError(f"days must be from 1 to {MOST_DAYS}")
        self.low = date.fromisoformat(options["from"]) if "from" in options else None
        self.until = date.fromisoformat(options["until"]) if "until" in options else None

    def last(self) -> date:
        """The last whole day: today's payload may still grow."""
        return self.until or date.today() - timedelta(days=1)

    def body(self, window: Window) -> tuple[str | None, bytes]:
        """A window's path and payload: landed before, or fetched and landed now."""
        if not self.root:
            return None, fetch(self.url, window.start, window.end)
        import pyarrow.fs as pafs

        fs, folder = pafs.FileSystem.from_uri(self.root if "://" in self.root else f"file://{self.root}")
        path = f"{folder}/{window.start}_{window.end}.json"
        if fs.get_file_info(path).type == pafs.FileType.NotFound:
            fs.create_dir(folder, recursive=True)
            aside = f"{folder}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(aside) as out:
                out.write(fetch(self.url, window.start, window.end))
            if fs.get_file_info(path).type == pafs.FileType.NotFound:
                fs.move(aside, path)
            else:  # another attempt was faster, and what it landed is what counts
                fs.delete_file(aside)
        with fs.open_input_stream(path) as source:
            return path, source.read()

    def rows(self, window: Window) -> Iterator[tuple]:
        path, body = self.body(window)
        yield window.start, window.end, path, hashlib.sha256(body).hexdigest(), body.decode()


class LandingReader(DataSourceReader):
    """Bounds on ``start`` from below and on ``end`` from above, and on both by equality, become the requests' range."""

    def __init__(self, options: dict):
        self.landing = Landing(options)
        self.low, self.high = self.landing.low, self.landing.last()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        one = timedelta(days=1)
        for f in filters:
            kind, name, value = type(f), getattr(f, "attribute", ())[:1], getattr(f, "value", None)
            value = value.date() if isinstance(value, datetime) else value
            if name == ("start",) and kind in (GreaterThan, GreaterThanOrEqual):
                bound = value + one if kind is GreaterThan else value
                self.low = bound if self.low is None else max(self.low, bound)
            elif name == ("end",) and kind in (LessThan, LessThanOrEqual):
                self.high = min(self.high, value - one if kind is LessThan else value)
            elif name in (("start",), ("end",)) and kind is EqualTo:
                if name == ("start",):
                    self.low = value if self.low is None else max(self.low, value)
                else:
                    self.high = min(self.high, value)
                yield f
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        if self.low is None:
            raise ValueError("the first day is needed: a filter on start, or the option from")
        return windows(self.low, self.high, self.landing.days)

    def read(self, partition: Window) -> Iterator[tuple]:
        return self.landing.rows(partition)


class LandingStream(DataSourceStreamReader):
    """Offsets are the days up to which windows have been read."""

    def __init__(self, options: dict):
        self.landing = Landing(options)

    def initialOffset(self) -> dict:  # noqa: N802
        if self.landing.low is None:
            raise ValueError("the first day is needed: the option from")
        return {"day": str(self.landing.low - timedelta(days=1))}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"day": str(max(self.landing.last(), self.landing.low - timedelta(days=1)))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return windows(date.fromisoformat(start["day"]) + timedelta(days=1), date.fromisoformat(end["day"]), self.landing.days)

    def read(self, partition: Window) -> Iterator[tuple]:
        return self.landing.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class LandingSource(DataSource):
    """Payloads by window; register with ``spark.dataSource.register`` and set ``spark.sql.python.filterPushdown.enabled``."""

    @classmethod
    def name(cls) -> str:
        return "landing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return LandingReader(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return LandingStream(dict(self.options))


def payloads(spark: SparkSession, low: date, high: date, **options: object) -> DataFrame:
    """Payloads of the windows from one day to another, both included, asked for by pushed filters."""
    spark.dataSource.register(LandingSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    loaded = spark.read.format("landing").options(**options).load()
    return loaded.where((F.col("start") >= F.lit(low)) & (F.col("end") <= F.lit(high)))
