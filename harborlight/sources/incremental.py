"""Incremental datasets: all rows first, later only what has changed, nothing where nothing has."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice
from typing import TypeVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlight.sources.sinks import Table, retried, with_state

A, B = TypeVar("A"), TypeVar("B")


def ahead(fetch: Callable[[A], B], requests: list[A], most: int = 4) -> Iterator[B]:
    """fetch of each request, in order, with at most ``most`` of them under way or waiting to be taken."""
    with ThreadPoolExecutor(most) as pool:
        left = iter(requests)
        waiting = [pool.submit(fetch, r) for r in islice(left, most)]
        while waiting:
            yield waiting.pop(0).result()
            waiting += [pool.submit(fetch, r) for r in islice(left, 1)]


def refreshed(table: Table, state: Table, name: str, fetch: Callable[[str | None], DataFrame], now: str, key: str = "_id", changed: str = "_updated_at") -> str:
    """Bring a table up to date; returns replaced, merged or skipped.

    ``fetch(cursor)`` gives the rows that changed after the cursor (all, for
    None). The cursor is the greatest ``changed`` so far; a run without rows keeps
    it and only notes the time. The state's row count is the table's own.
    """
    spark = table.spark
    old = state.read() if state.exists() else None
    cursor = None if old is None else next(iter(r[0] for r in old.where(F.col("dataset_name") == name).select("last_updated_at").collect()), None)
    first = cursor is None or not table.exists()
    rows = fetch(None if first else cursor)
    names = {(":" + c[1:] if c.startswith("_") else c): c for c in (key, changed)}
    rows = rows.withColumnsRenamed({k: v for k, v in names.items() if k in rows.columns})
    latest = rows.agg(F.max(F.col(changed).cast("string")), F.count("*")).first() if changed in rows.columns else (None, rows.count())
    if first:
        retried(lambda: table.replace(rows, key if key in rows.columns else None))
    elif latest[1]:
        retried(lambda: table.merge(rows, key))
    done = with_state(old, spark, name, table.read().count(), latest[0], now)
    retried(lambda: state.replace(done))
    return "replaced" if first else "merged" if latest[1] else "skipped"
