"""Ranks, latest rows, flips, grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborlight.storage import stored

#: Counted values that one task may rank, and a broadcast may hold.
FEW = 200_000


def global_percent_ranks(df: DataFrame, ranks: dict[str, str]) -> DataFrame:
    """percent_rank() of several columns (column -> name of its rank) over all rows, without a window over all rows.

    One pass counts the rows per column and value; the counts are stored. While
    they are ``FEW`` or fewer they are ranked as they are and broadcast; beyond
    that they are range-partitioned by value, ranked inside each partition and
    shifted by the rows of earlier partitions (a table of a row per partition).
    Ranks go back to the rows by value. Null values have a null rank.
    """
    spark, names = df.sparkSession, list(ranks)
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(n).cast("double").alias("v")) for i, n in enumerate(names)])).alias("x")).select("x.c", "x.v")
    counts = stored(long.where("v is not null").groupBy("c", "v").agg(F.count("*").alias("n")), "rank-counts")
    before = lambda *keys: Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    few = counts.limit(FEW + 1).count() <= FEW
    if few:
        placed = counts.withColumn("below", F.coalesce(F.sum("n").over(before("c")), F.lit(0)))
    else:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ranged = stored(counts.repartitionByRange(parts, "c", "v").withColumn("b", F.spark_partition_id()), "rank-ranges")
        sums = ranged.groupBy("c", "b").agg(F.sum("n").alias("m"))
        earlier = Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        shift = sums.select("c", "b", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("shift"))
        placed = ranged.join(F.broadcast(shift), ["c", "b"]).withColumn("below", F.col("shift") + F.coalesce(F.sum("n").over(before("c", "b")), F.lit(0)))
    totals = counts.groupBy("c").agg(F.sum("n").alias("total"))
    placed = placed.join(F.broadcast(totals), "c").select("c", "v", F.when(F.col("total") > 1, F.col("below") / (F.col("total") - 1)).otherwise(0.0).alias("r"))
    placed = stored(placed, "ranks")
    for i, n in enumerate(names):
        own = placed.where(F.col("c") == i).select(F.col("v").alias("__v"), F.col("r").alias(ranks[n]))
        df = df.join(F.broadcast(own) if few else own.hint("merge"), F.col(n).cast("double") == F.col("__v"), "left").drop("__v")
    return df


def global_percent_rank(df: DataFrame, column: str, out: str) -> DataFrame:
    """``global_percent_ranks`` of one column."""
    return global_percent_ranks(df, {column: out})


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row per key in the given order (give a full order, or ties are broken at random)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def flips(df: DataFrame, key: str, when: str, price: str, tie: str, months: int = 24, gain: float = 0.2) -> DataFrame:
    """Sales at least ``gain`` above the previous sale of the same key, within ``months`` calendar months."""
    from harborlight.functions.exprs import month_number

    w = Window.partitionBy(key).orderBy(when, tie)
    d = df.withColumn("prev_price", F.lag(price).over(w)).withColumn("prev_date", F.lag(when).over(w))
    d = d.withColumn("months", month_number(F.col(when)) - month_number(F.col("prev_date"))).withColumn("profit_pct", F.round(100 * (F.col(price) - F.col("prev_price")) / F.col("prev_price"), 2))
    return d.where((F.col("prev_price") > 0) & (F.col("months") <= months) & (F.col(price) >= (1 + gain) * F.col("prev_price")))


def quarter_grid(areas: DataFrame, area: str, start: str, end: str) -> DataFrame:
    """Every area in every quarter from start to end; areas must be a dimension (it is multiplied by the quarters)."""
    return areas.select(area).distinct().select(area, F.explode(F.expr(f"sequence(date '{start}', date '{end}', interval 3 months)")).alias("quarter"))


def modal(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """The most frequent value per key; of equally frequent ones the smallest. One aggregation after counting."""
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    top = counts.groupBy(key).agg(F.max("n").alias("weight"))
    return counts.join(top.withColumnRenamed("weight", "n"), [key, "n"]).groupBy(key).agg(F.min(value).alias(out), F.max("n").alias("weight"))
