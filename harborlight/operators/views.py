"""Building blocks of the views: sections, timelines, twins, comparisons, searches by template, several metrics at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tagged(parts: dict[str, DataFrame], tag: str = "section") -> DataFrame:
    """All parts as one table, each row with its part's name; columns that a part lacks are null there. One plan, so parts run side by side."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.select(F.lit(name).alias(tag), "*") for name, df in parts.items()])


def timeline(parts: dict[str, tuple[DataFrame, str, str, Column]]) -> DataFrame:
    """(item, happened, kind, detail) of several fact tables: kind -> (table, item column, time column, text)."""
    return reduce(
        DataFrame.unionByName,
        [df.select(F.col(item).alias("item"), F.col(when).cast("date").alias("happened"), F.lit(kind).alias("kind"), detail.cast("string").alias("detail")) for kind, (df, item, when, detail) in parts.items()],
    )


def yearly(events: DataFrame, item: str, when: str) -> DataFrame:
    """(item, year, n, change): events per year and how their number changed from the year before that has some."""
    n = events.groupBy(item, F.year(when).cast("long").alias("year")).agg(F.count("*").alias("n"))
    return n.withColumn("change", F.col("n") - F.lag("n").over(Window.partitionBy(item).orderBy("year")))


def twins(df: DataFrame, key: str, alike: list[str], near: tuple[str, float], weights: dict[str, float], top: int = 5) -> DataFrame:
    """(key, twin, distance): for every row the ``top`` rows most like it.

    Twins agree in the columns ``alike`` and lie at most ``near[1]`` apart in
    ``near[0]``: an equi-join on those columns and bands of that width (and their
    neighbours). The distance is the weighted sum of differences; ties go by key.
    """
    column, reach = near
    cols = list(dict.fromkeys([key, *alike, column, *weights]))
    d = df.select(*cols).withColumn("__band", F.floor(F.col(column) / reach))
    a = d.withColumn("__band", F.explode(F.array(*[F.col("__band") + i for i in (-1, 0, 1)])))
    on = " and ".join([*(f"a.`{c}` = b.`{c}`" for c in (*alike, "__band")), f"a.`{key}` <> b.`{key}`", f"abs(a.`{column}` - b.`{column}`) <= {reach}"])
    distance = " + ".join(f"{w}D * abs(a.`{c}` - b.`{c}`)" for c, w in weights.items())
    pairs = a.alias("a").join(d.alias("b"), F.expr(on)).select(F.expr(f"a.`{key}`").alias(key), F.expr(f"b.`{key}`").alias("twin"), F.round(F.expr(distance), 6).alias("distance"))
    w = Window.partitionBy(key).orderBy("distance", "twin")
    return pairs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top)


def against_average(df: DataFrame, key: str, group: str, metrics: list[str]) -> DataFrame:
    """(key, group, metric, value, average, rank): every metric of every row beside its group's average, in long form."""
    long = df.select(key, group, F.expr("stack({}, {}) as (metric, value)".format(len(metrics), ", ".join(f"'{m}', cast({m} as double)" for m in metrics))))
    each = Window.partitionBy(group, "metric")
    return long.select(key, group, "metric", "value", F.round(F.avg("value").over(each), 6).alias("average"), F.rank().over(each.orderBy(F.col("value").desc())).cast("long").alias("rank"))


@dataclass
class Search:
    """A search of one section: text columns, what is shown, and the measure that orders it."""

    table: DataFrame
    columns: list[str]
    show: Column
    measure: Column


def search(templates: dict[str, Search], term: str, top: int = 20) -> DataFrame:
    """(section, shown, measure): per section the ``top`` rows that hold the term in one of its columns, in any case."""
    parts = {}
    for name, t in templates.items():
        hit = reduce(Column.__or__, [F.col(c).ilike(f"%{term}%") for c in t.columns])
        parts[name] = t.table.where(hit).select(t.show.cast("string").alias("shown"), t.measure.cast("double").alias("measure")).orderBy(F.col("measure").desc_nulls_last(), "shown").limit(top)
    return tagged(parts)


@dataclass
class Metric:
    """One series to watch: which rows, by what group, how much (default: their number), in which buckets."""

    name: str
    rows: DataFrame
    group: Column
    when: str
    value: Column | None = None
    bucket: str = "week"
    recent_days: int = 7
    base_days: int = 83
    least_buckets: int = 4


def deviations_of(metrics: list[Metric], as_of: Column, z: float = 2.0, top: int = 20) -> DataFrame:
    """(metric, group, current, mean, z_score, pct_change): the groups of all metrics farthest off their mean per bucket.

    Groups with too few buckets, or without a mean or spread, are left out, as are
    those that have nothing to compare with.
    """
    parts = []
    for m in metrics:
        value = F.count("*").cast("double") if m.value is None else m.value.cast("double")
        day = F.col(m.when).cast("date")
        edge, start = F.date_sub(as_of, m.recent_days), F.date_sub(as_of, m.recent_days + m.base_days)
        rows = m.rows.withColumn("__g", m.group.cast("string")).where("__g is not null")
        now = rows.where((day > edge) & (day <= as_of)).groupBy("__g").agg(value.alias("current"))
        per = rows.where((day > start) & (day <= edge)).groupBy("__g", F.date_trunc(m.bucket, F.col(m.when))).agg(value.alias("n"))
        base = per.groupBy("__g").agg(F.avg("n").alias("mean"), F.stddev_samp("n").alias("sd"), F.count("*").alias("buckets"))
        base = base.where((F.col("buckets") >= m.least_buckets) & (F.col("mean") != 0) & (F.col("sd") != 0))
        score = (F.col("current") - F.col("mean")) / F.col("sd")
        parts.append(
            now.join(base, "__g").where(F.abs(score) >= z).select(
                F.lit(m.name).alias("metric"), F.col("__g").alias("grp"), "current", F.round("mean", 1).alias("mean"), F.round(score, 2).alias("z_score"),
                F.round(100 * (F.col("current") - F.col("mean")) / F.col("mean"), 1).alias("pct_change"),
            )
        )
    return reduce(DataFrame.unionByName, parts).orderBy(F.abs("z_score").desc(), "metric", "grp").limit(top)


def updated_from(df: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """UPDATE ... FROM: df with columns replaced by the source's values where the source has the key and a value. Keys of the source are unique."""
    names = {c: f"__new_{c}" for c in columns}
    joined = df.join(source.select(key, *[F.col(c).alias(n) for c, n in names.items()]), key, "left")
    return joined.withColumns({c: F.coalesce(n, c) for c, n in names.items()}).select(*df.columns)


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """Dense numbers from 1 in the given full order, without a window over all rows.

    Rows are range-partitioned and stored; each partition numbers its own, shifted
    by the rows of earlier partitions (a table of a row per partition).
    """
    from harborlight.storage import stored

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(df.repartitionByRange(parts, *order).withColumn("__b", F.spark_partition_id()), "numbered")
    sums = dealt.groupBy("__b").agg(F.count("*").alias("m"))
    earlier = Window.partitionBy(F.lit(1)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    shift = sums.select("__b", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("__s"))
    own = Window.partitionBy("__b").orderBy(*order)
    return dealt.join(F.broadcast(shift), "__b").withColumn(out, F.row_number().over(own) + F.col("__s")).drop("__b", "__s")


def doubled(tables: dict[str, tuple[DataFrame, list[str]]], least: float = 1.5) -> DataFrame:
    """(table_name, n, keys, ratio, doubled): tables with more rows than keys by the factor ``least``."""
    parts = {n: df.agg(F.count("*").alias("n"), F.count_distinct(F.struct(*cols)).alias("keys")) for n, (df, cols) in tables.items()}
    ratio = F.col("n") / F.nullif(F.col("keys"), F.lit(0))
    return tagged(parts, "table_name").select("table_name", "n", "keys", F.round(ratio, 4).alias("ratio"), F.coalesce(ratio > least, F.lit(False)).alias("doubled"))


def unpivoted(df: DataFrame, keep: list[str], name: str, value: str) -> DataFrame:
    """A wide tally (a column per candidate) in long form; what isn't a number, and empty cells, are left out."""
    cols = [c for c in df.columns if c not in keep]
    pairs = ", ".join(f"'{c}', cast(`{c}` as string)" for c in cols)
    long = df.select(*keep, F.expr(f"stack({len(cols)}, {pairs}) as (`{name}`, __v)"))
    return long.withColumn(value, F.round(F.regexp_replace("__v", ",", "").try_cast("double")).try_cast("long")).where(F.col(value).isNotNull()).drop("__v")
