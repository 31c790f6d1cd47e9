"""Deviations from a baseline, confidence and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights and steps of the confidence score, thresholds of freshness.
WEIGHTS = {"freshness": 0.40, "completeness": 0.25, "match": 0.20, "source": 0.15}
FRESH_STEPS = ((24, 1.0), (24 * 7, 0.85), (24 * 30, 0.6))
FRESH_ELSE = 0.2
MAX_DRIFT, MAX_MISSING = 0.05, 1000


def deviations(df: DataFrame, group: str, when: str, as_of: Column, recent_days: int, base_days: int, bucket: str = "week", z: float = 2.0, top: int = 20) -> DataFrame:
    """Groups whose count of the last days lies z standard deviations off their mean count per bucket before.

    The recent window is [as_of - recent_days, as_of], the baseline the
    base_days before it. Groups without a spread are left out.
    """
    day = F.col(when).cast("date")
    edge, start = F.date_sub(as_of, recent_days), F.date_sub(as_of, recent_days + base_days)
    now = df.where((day > edge) & (day <= as_of)).groupBy(group).agg(F.count("*").alias("current_count"))
    buckets = df.where((day > start) & (day <= edge)).groupBy(group, F.date_trunc(bucket, F.col(when)).alias("b")).agg(F.count("*").alias("n"))
    base = buckets.groupBy(group).agg(F.avg("n").alias("mean"), F.stddev_samp("n").alias("sd")).where("mean <> 0 and sd <> 0")
    score = (F.col("current_count") - F.col("mean")) / F.col("sd")
    found = now.join(base, group).where(F.abs(score) >= z).select(
        group, "current_count", F.round("mean", 1).alias("baseline_avg"), F.round(score, 2).alias("z_score"),
        F.round(100 * (F.col("current_count") - F.col("mean")) / F.col("mean"), 1).alias("pct_change"), F.when(score > 0, "up").otherwise("down").alias("direction"),
    )
    return found.orderBy(F.abs("z_score").desc(), group).limit(top)


def confidence(hours: Column, returned: Column, expected: Column, match: Column, source: Column) -> Column:
    """Weighted mean of the signals that are not null (1.0 without any), to three digits."""
    fresh = F.when(hours.isNull(), None)
    for most, score in FRESH_STEPS:
        fresh = fresh.when(hours <= most, score)
    fresh = fresh.otherwise(FRESH_ELSE)
    complete = F.when(returned.isNotNull() & (expected > 0), F.least(returned / expected, F.lit(1.0)))
    parts = list(zip(WEIGHTS.values(), (fresh, complete, match, source), strict=True))
    total = sum((F.when(s.isNotNull(), w).otherwise(0.0) for w, s in parts), F.lit(0.0))
    value = sum((F.coalesce(s * w, F.lit(0.0)) for w, s in parts), F.lit(0.0))
    return F.when(total == 0, 1.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value / total)), 3))


def sync_status(lake_rows: Column, source_rows: Column, cursor: Column, source_updated: Column) -> Column:
    """stale, synced or unknown, from row counts and times of the last change."""
    missing = source_rows - lake_rows
    behind = (source_rows > lake_rows) & ((lake_rows == 0) | (missing > MAX_DRIFT * F.greatest(lake_rows, F.lit(1))) | (missing > MAX_MISSING))
    late = source_updated > cursor
    return F.when(F.coalesce(behind, F.lit(False)) | F.coalesce(late, F.lit(False)), "stale").when(source_rows.isNull() & source_updated.isNull(), "unknown").otherwise("synced")
