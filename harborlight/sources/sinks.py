"""Tables that are replaced, appended to or merged into, with additive schemas and a state table.

A table is a folder of data folders and of versions. A version is a manifest: the
schema, the key, and which data folders hold which bucket of key hashes. It becomes
current by Spark's success mark, so a reader never sees half of a change. An append
writes only its own rows, a merge only the buckets that its keys fall into; all
other data folders are named again. Data that no kept version names is deleted.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborlight.sources.files import union_by_name

R = TypeVar("R")
#: Waits of a write that meets another one: tries, first wait, longest wait.
TRIES, FIRST_WAIT, LONGEST_WAIT = 10, 0.5, 30.0


class Contended(Exception):
    """Another writer was faster; what is to be written must be worked out again."""


def retried(work: Callable[[], R], sleep: Callable[[float], None] = time.sleep) -> R:
    """work(), again after growing waits while it is Contended."""
    for k in range(TRIES):
        try:
            return work()
        except Contended:
            if k == TRIES - 1:
                raise
            sleep(min(LONGEST_WAIT, FIRST_WAIT * 2**k) * (1 + random.random() / 4))
    raise AssertionError


class Table:
    """A table under a shared folder: read, replace, append, merge. buckets: parts of the key's hashes that a merge rewrites one by one."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16, keep: int = 2) -> None:
        self.spark, self.folder, self.buckets, self.keep = spark, folder.rstrip("/"), buckets, keep

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _list(self, name: str) -> list[str]:
        path, fs = self._path(name)
        return sorted(x.getPath().toString() for x in fs.listStatus(path)) if fs.exists(path) else []

    def _versions(self) -> list[str]:
        return [v for v in self._list(f"{self.folder}/versions") if any(x.endswith("/_SUCCESS") for x in self._list(v))]

    def _manifest(self, version: str | None = None) -> dict:
        lines = self.spark.read.text(version or self._versions()[-1]).collect()  # one line
        return json.loads(lines[0][0])

    def exists(self) -> bool:
        return bool(self._versions())

    def _read(self, m: dict, buckets: set[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(m["schema"])
        paths = [p for b, p in m["parts"] if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        return self._read(self._manifest())

    def _written(self, df: DataFrame, key: str | None) -> list[tuple[int, str]]:
        """(bucket, folder) of rows that are written now; -1 without a key."""
        own = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.buckets)).cast("int") if key else F.lit(-1)
        folder = f"{self.folder}/data/{uuid.uuid4().hex}"
        rows = df.withColumn("__bucket", own)
        (rows.repartition("__bucket") if key else rows).write.partitionBy("__bucket").parquet(folder)
        return [(int(p.rsplit("=", 1)[1]), p) for p in self._list(folder) if "/__bucket=" in p]

    def _commit(self, schema: T.StructType, key: str | None, parts: list[tuple[int, str]], base: str | None) -> None:
        """Make the next version. Contended if it isn't the one after ``base`` any more."""
        now = self._versions()
        if (now[-1] if now else None) != base:
            raise Contended(self.folder)
        number = int(base.rsplit("/", 1)[1].split("-")[0]) + 1 if base else 0
        line = json.dumps({"schema": json.loads(schema.json()), "key": key, "buckets": self.buckets, "parts": parts})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{self.folder}/versions/{number:08d}-{uuid.uuid4().hex}")
        self._clean()

    def _clean(self) -> None:
        """Delete versions but the last ones, and data folders that none of those names."""
        versions = self._versions()
        old, kept = versions[: -self.keep], versions[-self.keep :]
        if not old:
            return
        named = {p.rsplit("/", 2)[1] for v in kept for _, p in self._manifest(v)["parts"]}
        gone = {p.rsplit("/", 2)[1] for v in old for _, p in self._manifest(v)["parts"]} - named
        for name in [*old, *(f"{self.folder}/data/{x}" for x in gone)]:
            path, fs = self._path(name)
            fs.delete(path, True)

    def _base(self) -> tuple[str | None, dict | None]:
        now = self._versions()
        return (now[-1], self._manifest(now[-1])) if now else (None, None)

    def replace(self, df: DataFrame, key: str | None = None) -> None:
        base, _ = self._base()
        self._commit(df.schema, key, self._written(df, key), base)

    def append(self, df: DataFrame) -> None:
        """Rows by column name; columns new to the table are added as text, missing ones are null. Only the new rows are written."""
        base, m = self._base()
        new = clean_names(df)
        if m is None:
            return self.replace(new)
        old = self._read(m)
        new = widened(new, old)
        both = union_by_name([old.limit(0), new])
        key = m["key"] if m["key"] in new.columns else None
        if any(both.schema[c].dataType != old.schema[c].dataType for c in old.columns):  # a column becomes text: all is written again
            return self._commit(both.schema, m["key"], self._written(union_by_name([old, new]), m["key"]), base)
        parts = self._written(both, key)
        return self._commit(both.schema, m["key"], [*map(tuple, m["parts"]), *parts], base)

    def merge(self, df: DataFrame, key: str = "_id") -> None:
        """Rows with a known key replace the old ones, others are added; of several with one key the last wins.

        Only buckets with new keys are written again. Without the key column all rows are added.
        """
        base, m = self._base()
        new = clean_names(df)
        if key not in new.columns or (m is not None and key not in [f["name"] for f in m["schema"]["fields"]]):
            return self.append(new)
        if m is None:
            return self.replace(last_per_key(new, key), key)
        old = self._read(m)
        new = widened(last_per_key(new, key), old)
        both = union_by_name([old.limit(0), new]).schema
        ready = m["key"] == key and m["buckets"] == self.buckets and all(b >= 0 for b, _ in m["parts"]) and all(both[c].dataType == old.schema[c].dataType for c in old.columns)
        if not ready:
            rows = union_by_name([old.join(new.select(key).distinct(), key, "left_anti"), new])
            return self._commit(both, key, self._written(rows, key), base)
        own = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self.buckets)).cast("int")
        touched = {r[0] for r in new.select(own.alias("b")).distinct().collect()}  # at most ``buckets`` numbers
        if not touched:
            return None
        kept = self._read(m, touched).join(new.select(key).distinct(), key, "left_anti")
        parts = self._written(union_by_name([kept, new]), key)
        return self._commit(both, key, [*((b, p) for b, p in m["parts"] if b not in touched), *parts], base)


def clean_names(df: DataFrame) -> DataFrame:
    """":id" and the like as "_id"."""
    return df.toDF(*["_" + c[1:] if c.startswith(":") else c for c in df.columns])


def widened(df: DataFrame, table: DataFrame) -> DataFrame:
    """Columns that the table doesn't have yet as text."""
    return df.withColumns({c: F.col(c).cast("string") for c in df.columns if c not in table.columns})


def last_per_key(df: DataFrame, key: str) -> DataFrame:
    """Of rows with one key the one updated last: by _updated_at if there, then by the order in which rows are read."""
    order = [F.col("_updated_at").desc_nulls_last()] if "_updated_at" in df.columns else []
    at = df.withColumn("__at", F.monotonically_increasing_id())
    w = Window.partitionBy(key).orderBy(*order, F.col("__at").desc())
    return at.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__at")


def with_state(state: DataFrame | None, spark: SparkSession, dataset: str, rows: int, updated_at: str | None, run_at: str) -> DataFrame:
    """The state table with one dataset's row replaced; without updated_at the old cursor stays."""
    schema = "dataset_name string, last_updated_at string, row_count bigint, last_run_at string"
    old = spark.createDataFrame([], schema) if state is None else state
    kept = old.where(F.col("dataset_name") == dataset).agg(F.max("last_updated_at").alias("c"))
    mine = kept.select(F.lit(dataset).alias("dataset_name"), F.coalesce(F.lit(updated_at), F.col("c")).alias("last_updated_at"), F.lit(rows).cast("long").alias("row_count"), F.lit(run_at).alias("last_run_at"))
    return old.where(F.col("dataset_name") != dataset).unionByName(mine)
