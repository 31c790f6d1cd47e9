"""Tables that are computed from others and kept: refreshed in order, with a manifest that says what is current."""

from __future__ import annotations

from collections.abc import Callable
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.sources.sinks import Table


class Materialized:
    """Named builders over a folder. A builder gets (spark, inputs): the tables that it depends on, by name."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.builders: dict[str, tuple[tuple[str, ...], Callable[[SparkSession, dict[str, DataFrame]], DataFrame]]] = {}

    def add(self, name: str, inputs: tuple[str, ...], build: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]) -> None:
        self.builders[name] = (inputs, build)

    def table(self, name: str) -> Table:
        return Table(self.spark, f"{self.folder}/{name}")

    def order(self) -> list[str]:
        """Builders after what they depend on; CycleError if there is no such order."""
        return [n for n in TopologicalSorter({n: i for n, (i, _) in self.builders.items()}).static_order() if n in self.builders]

    def behind(self, changed: set[str]) -> list[str]:
        """Builders to run when these tables have changed: theirs, and everything built on top."""
        out = []
        for n in self.order():
            if n in changed or set(self.builders[n][0]) & (changed | set(out)) or not self.table(n).exists():
                out.append(n)
        return out

    def refresh(self, sources: dict[str, DataFrame], changed: set[str] | None = None) -> list[str]:
        """Rebuild what is behind (all, without ``changed``); returns what was built. Readers see old or new, never half."""
        names = self.order() if changed is None else self.behind(changed)
        for n in names:
            inputs, build = self.builders[n]
            self.table(n).replace(build(self.spark, {i: self.table(i).read() if i in self.builders else sources[i] for i in inputs}))
        return names

    def counts(self) -> DataFrame:
        """(name, row_count) of the tables that exist."""
        parts = [self.table(n).read().agg(F.lit(n).alias("name"), F.count("*").alias("row_count")) for n in self.order() if self.table(n).exists()]
        out = self.spark.createDataFrame([], "name string, row_count bigint")
        for p in parts:
            out = out.unionByName(p)
        return out
