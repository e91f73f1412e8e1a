"""Paged interfaces as a Spark source: ranges of pages are partitions, in batch and as a stream.

An interface gives records by page. Some answer beyond the last page with nothing, some
with the last page again, some ignore the page asked for; what is past the end is told by
a page that is empty or adds no record to the page before.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from itertools import count

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "page long, position long, key string, record string"


def key_of(record) -> str:
    """What makes a record the same on another page: its item's id, its own, or all of it."""
    own = record if isinstance(record, dict) else {}
    return str(own.get("item_id") or own.get("id") or json.dumps(record, sort_keys=True, ensure_ascii=False))


class Interface:
    """Pages by number.

    Options: uri, with {page}, {from}, {to} or {limit} put in (a file system's or http);
    body, a JSON text to post with the same put in as «page» and so on; rows, the dotted
    field of the records ("" where the page is the list itself); limit, records a page
    has (51); retries (4) with pauses that double from ``pause`` seconds (1).
    """

    def __init__(self, options: dict):
        self.uri, self.body, self.rows = options["uri"], options.get("body"), options.get("rows", "rows")
        self.limit, self.retries, self.pause = int(options.get("limit", 51)), int(options.get("retries", 4)), float(options.get("pause", 1))

    def _filled(self, text: str, page: int, marks: str) -> str:
        first = page * self.limit
        for name, value in {"page": page, "from": first, "to": first + self.limit - 1, "limit": self.limit}.items():
            text = text.replace(marks[0] + name + marks[1], str(value))
        return text

    def _content(self, page: int) -> bytes | None:
        uri = self._filled(self.uri, page, "{}")
        if not uri.startswith(("http://", "https://")):
            try:
                system, path = fs.FileSystem.from_uri(uri)
                with system.open_input_stream(path) as f:
                    return f.read()
            except FileNotFoundError:
                return None
        body = self._filled(self.body, page, "«»").encode() if self.body else None
        request = urllib.request.Request(uri, body, {"Content-Type": "application/json"} if body else {})
        for attempt in count():
            try:
                with urllib.request.urlopen(request, timeout=60) as answer:
                    return answer.read()
            except urllib.error.HTTPError as e:
                if e.code == 404:
                    return None
                if e.code < 500 and e.code != 429 or attempt >= self.retries:
                    raise
            except OSError:
                if attempt >= self.retries:
                    raise
            time.sleep(self.pause * 2**attempt)

    def page(self, number: int) -> list:
        content = self._content(number)
        found = json.loads(content) if content else []
        for field in filter(None, self.rows.split(".")):
            found = found.get(field) if isinstance(found, dict) else None
        return found if isinstance(found, list) else []

    def is_new(self, number: int) -> bool:
        """Whether a page has records that the page before lacks."""
        keys = set(map(key_of, self.page(number)))
        return bool(keys - set(map(key_of, self.page(number - 1)))) if number else bool(keys)

    def pages_from(self, first: int) -> int:
        """How many pages there are, when the first ones are known to be: steps that double, then halves."""
        if not self.is_new(first):
            return first
        low, step = first, 1
        while self.is_new(low + step):
            low, step = low + step, step * 2
        high = low + step
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self.is_new(middle) else (low, middle)
        return high

    def records(self, first: int, until: int) -> Iterator[tuple]:
        """Records number first to until, once for each key, to the first page that is empty or adds nothing."""
        seen: set[str] = set()
        for number in range(first // self.limit, -(-until // self.limit)):
            before = len(seen)
            for k, record in enumerate(self.page(number)):
                key, at = key_of(record), number * self.limit + k
                if key not in seen:
                    seen.add(key)
                    if first <= at < until:
                        yield number, k, key, json.dumps(record, sort_keys=True, ensure_ascii=False)
            if len(seen) == before:
                return


class Range(InputPartition):
    def __init__(self, first: int, until: int):
        super().__init__((first, until))


def ranges(first: int, until: int, size: int) -> list[InputPartition]:
    """Partitions of at most size records, cut at multiples of it."""
    cuts = [first, *range((first // size + 1) * size, until, size), until]
    return [Range(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]


class Paged(DataSource):
    """Format "paged". Options of Interface, and per_partition, the pages that a partition
    reads (20); total, where the number of records is known, else it is searched for by
    about 2 log2(pages) requests. A page whose records were all given by the range before
    ends it; a record on pages of two ranges is given twice, which ``once`` mends.

    As a stream the offset is the number of records; a batch takes what has come since."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802  Spark's name
        return _StreamReader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.interface, self.total = Interface(options), options.get("total")
        self.size = self.interface.limit * int(options.get("per_partition", 20))

    def partitions(self) -> list[InputPartition]:
        until = int(self.total) if self.total else self.interface.pages_from(0) * self.interface.limit
        return ranges(0, until, self.size) or [Range(0, 0)]  # Spark wants one

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.interface.records(*partition.value)


class _StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.interface, self.known = Interface(options), 0
        self.size = self.interface.limit * int(options.get("per_partition", 20))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"records": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        limit = self.interface.limit
        pages = self.interface.pages_from(self.known // limit)
        if pages:
            # the last page may still grow
            self.known = max(self.known, (pages - 1) * limit + min(limit, len(self.interface.page(pages - 1))))
        return {"records": self.known}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return ranges(start["records"], end["records"], self.size)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.interface.records(*partition.value)

    def commit(self, end: dict) -> None:
        pass


def once(pages: DataFrame) -> DataFrame:
    """Each key's first record by page and position. Keys are compared over all pages, by a shuffle of keys."""
    first = pages.groupBy("key").agg(F.min(F.struct("page", "position", "record")).alias("_first"))
    return first.select("_first.page", "_first.position", "key", "_first.record")
