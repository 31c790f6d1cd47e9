"""Streaming plans, each with the batch query that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.catalog import table
from harborlight.plans.registry import plan
from harborlight.sources.sinks import Table
from harborlight.storage import shared_folder
from harborlight.streaming import ingest


@plan("""
SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS window_start, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') + INTERVAL 6 HOUR AS window_end, count(*) AS n,
  round(CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE), 4) AS total FROM events GROUP BY 1, 2
""")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    s = ingest.stream_table(spark, f"{d}/events.parquet")
    return _naive(ingest.drained(ingest.windowed(_zoned(s), "ts", ["event_type"], "6 hours", value="value")), "window_start", "window_end")


@plan("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, s
""")
def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    e = _zoned(table(spark, d, "events"))
    return _naive(ingest.sessions(e, "ts", ["user_id"], "2 hours"), "session_start", "session_end")


@plan("""
WITH b AS (SELECT o_orderkey AS id, o_totalprice AS price, 1 AS v FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, o_totalprice + 1, 2 FROM orders WHERE o_orderkey % 4 = 0)
SELECT id, price FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC) AS rn FROM b) WHERE rn = 1
""")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two batches merged by key, the later one winning."""
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    t = Table(spark, f"{shared_folder(spark)}/lake/orders-{uuid.uuid4().hex}")
    t.merge(o.where(k % 3 != 0).select(k.alias("id"), F.col("o_totalprice").alias("price")), "id")
    t.merge(o.where(k % 4 == 0).select(k.alias("id"), (F.col("o_totalprice") + 1).alias("price")), "id")
    return t.read()


@plan("SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders")
def stream_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A stream of rows merged into a table with a checkpoint; the second run finds nothing new."""
    base = f"{shared_folder(spark)}/lake/stream-{uuid.uuid4().hex}"
    t = Table(spark, f"{base}/table")
    for _ in range(2):
        s = ingest.stream_table(spark, f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
        ingest.upsert(s, t, "id", f"{base}/checkpoint")
    return t.read()


def _zoned(df: DataFrame) -> DataFrame:
    """Event time with the session's zone, which watermarks need."""
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def _naive(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})
