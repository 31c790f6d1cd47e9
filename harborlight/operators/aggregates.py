"""Profiles, sketches, quantiles, outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUANTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def money(c: Column | str) -> Column:
    """Exact sum of amounts with cents: doubles added in any order give one result."""
    c = F.col(c) if isinstance(c, str) else c
    return F.sum(c.cast("decimal(18,2)")).cast("double")


def counters(df: DataFrame, keys: list[str], flags: dict[str, Column]) -> DataFrame:
    """Per key: total, and the number of rows for which each flag holds."""
    return df.groupBy(*keys).agg(F.count("*").alias("total"), *[F.count_if(p).alias(k) for k, p in flags.items()])


def approx_distinct(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.hll_sketch_estimate(F.hll_sketch_agg(column)).alias("approx_distinct"))


def approx_quantiles(df: DataFrame, column: str) -> DataFrame:
    """Five quantiles from one mergeable sketch."""
    s = df.where(F.col(column).isNotNull()).agg(F.expr(f"kll_sketch_agg_double(cast({column} as double))").alias("s"))
    return s.select(*[F.expr(f"kll_sketch_get_quantile_double(s, {q}D)").alias(k) for k, q in QUANTILES.items()])


def exact_quantiles(df: DataFrame, column: str) -> DataFrame:
    return df.agg(*[F.expr(f"percentile_cont({q}) within group (order by {column})").alias(k) for k, q in QUANTILES.items()])


def frequent_items(df: DataFrame, column: str, top: int = 20) -> DataFrame:
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("freq"))
    return counts.orderBy(F.col("freq").desc(), F.col(column)).limit(top)


def iqr_outliers(df: DataFrame, column: str, reach: float = 1.5) -> DataFrame:
    """Rows outside the quartile fences, with the fences and on which side they lie. The bounds are one row."""
    q = df.agg(F.expr(f"percentile_cont(0.25) within group (order by {column})").alias("q1"), F.expr(f"percentile_cont(0.75) within group (order by {column})").alias("q3"))
    bounds = q.select((F.col("q1") - reach * (F.col("q3") - F.col("q1"))).alias("lower_bound"), (F.col("q3") + reach * (F.col("q3") - F.col("q1"))).alias("upper_bound"))
    x = F.col(column)
    return (
        df.crossJoin(F.broadcast(bounds)).where((x < F.col("lower_bound")) | (x > F.col("upper_bound")))
        .withColumn("outlier_flag", F.when(x < F.col("lower_bound"), "low_outlier").otherwise("high_outlier"))
    )


def null_profile(df: DataFrame, columns: int = 10) -> DataFrame:
    """One row per column (the first ones): rows, percentage of nulls, and whether that is over half. One scan."""
    names = df.columns[:columns]
    one = df.agg(F.count("*").alias("n"), *[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(names)])
    pairs = ", ".join(f"'{c}', c{i}" for i, c in enumerate(names))
    pct = F.round(100.0 * (F.col("n") - F.col("filled")) / F.nullif(F.col("n"), F.lit(0)), 2)
    return one.select("n", F.expr(f"stack({len(names)}, {pairs}) as (column_name, filled)")).select("column_name", F.col("n").alias("row_count"), pct.alias("null_pct"), F.coalesce(pct > 50, F.lit(False)).alias("mostly_null"))
