"""A paged source for Spark's Python data source API: one partition per page.

Options: ``total`` rows and ``page`` size give the pages (without ``total`` the
source is asked for its row count first, by ``fetch``); ``select``, ``where`` and
``order`` go into each page's request. ``fetch`` names a callable ("module:function")
that takes the request's parameters and returns a list of records; it runs on the
executors, with retries. No network is used by the library itself.
"""

from __future__ import annotations

import importlib
import random
import time
from collections.abc import Callable, Iterator
from urllib.parse import urlencode

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE = 50_000
TRIES = 7


class Gone(Exception):
    """The page can't be had (forbidden or missing): it has no rows."""


class Busy(Exception):
    """Try again, after ``wait`` seconds if told."""

    def __init__(self, wait: float | None = None) -> None:
        super().__init__("busy")
        self.wait = wait


def page_requests(total: int, page: int = PAGE, select: str | None = None, where: str | None = None, order: str = ":id") -> list[dict[str, str]]:
    """Parameters of each page's request; a stable order makes offsets meaningful."""
    fixed = {k: v for k, v in (("$select", select), ("$where", where)) if v}
    return [{"$limit": str(min(page, total - at)), "$offset": str(at), "$order": order} | fixed for at in range(0, total, page)]


def page_url(base: str, request: dict[str, str]) -> str:
    return f"{base}?{urlencode(request)}"


def with_retries(fetch: Callable[[dict], list[dict]], request: dict, tries: int = TRIES, base: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> list[dict]:
    """fetch(request), again after growing waits while it is Busy; no rows where it is Gone."""
    for k in range(tries):
        try:
            return fetch(request)
        except Gone:
            return []
        except Busy as e:
            if k == tries - 1:
                raise
            sleep(e.wait if e.wait is not None else base * 2**k * (1 + random.random() / 4))
    return []


def row_count(fetch: Callable[[dict], list[dict]], where: str | None = None) -> int:
    """How many rows the source has, by its own count; 0 where it can't be had."""
    got = with_retries(fetch, {"$select": "count(*)"} | ({"$where": where} if where else {}))
    return int(next(iter(got[0].values()))) if got else 0


class Page(InputPartition):
    def __init__(self, request: dict[str, str]) -> None:
        self.request = request


class PagedReader(DataSourceReader):
    def __init__(self, schema, options) -> None:
        self.names, self.options = schema.names, options

    def fetch(self):
        module, _, name = self.options["fetch"].partition(":")
        return getattr(importlib.import_module(module), name)

    def partitions(self) -> list[Page]:
        o = self.options
        total = int(o["total"]) if "total" in o else row_count(self.fetch(), o.get("where"))
        return [Page(r) for r in page_requests(total, int(o.get("page", PAGE)), o.get("select") or ",".join(self.names), o.get("where"), o.get("order", ":id"))]

    def read(self, partition: Page) -> Iterator[tuple]:
        for record in with_retries(self.fetch(), partition.request):
            yield tuple(record.get(n) for n in self.names)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        raise ValueError("give the schema with .schema(...)")

    def reader(self, schema) -> PagedReader:
        return PagedReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)
