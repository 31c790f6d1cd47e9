"""What several operators share: opening tables, shared folders, batches, components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborlight.operators.graph import connected
from harborlight.storage import discard, release, shared_folder, stored

__all__ = ["components", "discard", "free_name", "freed", "joinable", "partitions", "read", "release", "shared_folder", "sliced", "small_batches", "stored", "texts_in", "with_fields"]

#: Rows and bytes that Spark hands to Python at once; long texts make larger batches a memory risk.
BATCH_ROWS, BATCH_BYTES = "500", str(16 << 20)
#: Bytes of texts that become Python objects at once.
SLICE_BYTES = 2 << 20
#: Rows that a join may broadcast: some 20 MB.
FEW = 200_000
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches sent to Python by rows and bytes, unless the session already asks for smaller ones.

    Plans are made when they run, so the setting stays in the session.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key, None)
        if now is None or now.lstrip("-").isdigit() and not 0 < int(now) <= int(most):
            spark.conf.set(key, most)


def sliced(batches: Iterator[pa.RecordBatch], column: str | int = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``most`` bytes of a text column (a longer text is a slice of its own)."""
    for batch in batches:
        size = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(batch):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, end - at)
            at = end
        if not len(batch):
            yield batch


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@cache
def _malloc_trim() -> Callable[[int], int] | None:
    """glibc's, where that is the C library."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):
        return None


def give_back() -> None:
    """Return what this process has allocated and freed to the system."""
    pa.default_memory_pool().release_unused()
    if trim := _malloc_trim():
        trim(0)


def freed(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """work, after which a task's memory goes back to the system. Python workers stay for later tasks and would keep it beside the JVM, stages without Python included."""

    @wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def texts_in(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list]]:
    """Each batch with its texts as a list of str (null: empty)."""
    for batch in sliced(batches, column):
        yield batch, [x or "" for x in batch.column(column).to_pylist()]


def joinable(table: DataFrame, listed: str | None = None) -> DataFrame:
    """A stored table of narrow rows for a join: broadcast if it is counted to have at most ``FEW`` rows (and entries of the array column ``listed`` five times that), by sort-merge beyond."""
    entries = F.sum(F.size(listed)) if listed else F.lit(0)
    rows, inside = table.agg(F.count("*"), entries).first()
    return F.broadcast(table) if rows <= FEW and (inside or 0) <= 5 * FEW else table.hint("merge")


def free_name(df: DataFrame, name: str) -> str:
    """name, or with underscores added until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_fields(df: DataFrame, keep: str, ddl: str) -> T.StructType:
    """The schema of df's column keep (whatever its type), then the fields of a DDL string."""
    return T.StructType([df.schema[keep], *T.StructType.fromDDL(ddl).fields])


def components(edges: DataFrame, src: str = "a", dst: str = "b", label: str = "components") -> DataFrame:
    """(node, root): for each node of an edge the smallest node that it reaches; see ``connected``."""
    return connected(edges, src, dst, label)
