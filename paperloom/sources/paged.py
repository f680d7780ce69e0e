"""A paged source: rows from a pluggable fetch function, with the number of pages given or found on the way.

``spark.read.format("paged")`` with options fetch (module:function) and a schema. With ``pages``, tasks read ranges of
``per_task`` pages and fetch is called with a page. Without it each of ``sites`` (comma-separated, one site by default) is
read by one task, page by page until its end, and fetch is called with a site and a page; it returns rows, or rows and
whether the pager shows a next page. ``delay`` seconds pass between the fetches of a task. No network client ships with it;
tests and callers bring the function.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class PageRange(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class Site(InputPartition):
    def __init__(self, name: str):
        self.name = name


def until_end(fetch: Callable, full: int | None = None, most: int | None = None, delay: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> Iterator[tuple[int, tuple]]:
    """(page, row) from page 1 to the end: a pager without a next page, a page with fewer than ``full`` rows, none, or the
    rows of an earlier page (portals serve a known one past the end), or page ``most``."""
    seen, page = set(), 1
    while most is None or page <= most:
        if page > 1 and delay:
            sleep(delay)
        got = fetch(page)
        rows, more = got if isinstance(got, tuple) and len(got) == 2 and isinstance(got[1], bool) else (got, True)
        rows = [tuple(r) for r in rows]
        mark = hash(tuple(rows))
        if not rows or mark in seen:
            return
        seen.add(mark)
        yield from ((page, r) for r in rows)
        if not more or (full is not None and len(rows) < full):
            return
        page += 1


class PagedReader(DataSourceReader):
    def __init__(self, options):
        number = lambda name: int(options[name]) if name in options else None
        self.fetch, self.pages, self.per_task = options["fetch"], number("pages"), number("per_task") or 10
        self.sites = [s.strip() for s in options.get("sites", "").split(",") if s.strip()] or [""]
        self.full, self.most, self.delay = number("full"), number("most"), float(options.get("delay", 0))

    def partitions(self):
        if self.pages is None:
            return [Site(s) for s in self.sites]
        return [PageRange(i, min(self.pages, i + self.per_task - 1)) for i in range(1, self.pages + 1, self.per_task)]

    def read(self, partition):
        module, name = self.fetch.split(":")
        fetch = getattr(importlib.import_module(module), name)
        if isinstance(partition, Site):
            for page, row in until_end(lambda page: fetch(partition.name, page), self.full, self.most, self.delay):
                yield (page, *row)
            return
        for page in range(partition.first, partition.last + 1):
            if self.delay and page > partition.first:
                time.sleep(self.delay)
            for row in fetch(page):
                yield (page, *row)


class Paged(DataSource):
    @classmethod
    def name(cls):
        return "paged"

    def schema(self):
        return "page int, body string"

    def reader(self, schema):
        return PagedReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Paged)


def demo(page: int) -> list[tuple[str]]:
    """Two rows a page, for tests."""
    return [(f"row {page}.{i}",) for i in range(2)]


def demo_site(site: str, page: int) -> tuple[list[tuple[str]], bool]:
    """Three pages of two rows, the last one short, for tests."""
    return [(f"{site} {page}.{i}",) for i in range(2 if page < 3 else 1)], page < 5
