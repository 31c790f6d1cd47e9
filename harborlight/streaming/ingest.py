"""Structured Streaming: incremental upserts and event-time windows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.sources.sinks import Table
from harborlight.storage import shared_folder


def stream_table(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A Parquet table (a file or a folder) as a stream, some files at a time."""
    r = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return r.parquet(path)
    # A stream reads folders: the one that the file is in, by the file's name.
    return r.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())


def upsert(stream: DataFrame, table: Table, key: str, checkpoint: str) -> None:
    """Merge everything that has arrived, batch by batch; running again goes on where the last run stopped."""
    q = stream.writeStream.foreachBatch(lambda df, _: table.merge(df, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def windowed(stream: DataFrame, when: str, keys: list[str], size: str, slide: str | None = None, late: str = "1 hour", value: str | None = None) -> DataFrame:
    """Counts (and sums) per event-time window and keys; rows later than ``late`` behind the newest are dropped."""
    w = F.window(when, size, slide) if slide else F.window(when, size)
    extra = [F.round(F.sum(F.col(value).cast("decimal(18,6)")).cast("double"), 4).alias("total")] if value else []
    return stream.withWatermark(when, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), *extra).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", *[c for c in ("total",) if value])


def sessions(stream: DataFrame, when: str, keys: list[str], gap: str, late: str = "1 hour") -> DataFrame:
    """Per keys: runs of events with no gap as long as ``gap`` between them."""
    return stream.withWatermark(when, late).groupBy(F.session_window(when, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def drained(df: DataFrame, mode: str = "complete") -> DataFrame:
    """Run a streaming aggregation over all that is there and return its result as a table in the shared folder."""
    spark = df.sparkSession
    base = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/out")

    q = df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{base}/out")
