"""Bulk files: delimited text with odd dialects, XML cases, GeoJSON, address directories, Parquet and CSV sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def delimited(spark: SparkSession, path: str, columns: list[str] | None = None, sep: str = ",", header: bool = True, encoding: str = "UTF-8", with_file: bool = False) -> DataFrame:
    """Delimited text, all columns as text; empty fields are null, broken rows are dropped, fields may hold line ends.

    columns: names by position, for files without a header line.
    """
    r = spark.read.option("sep", sep).option("header", header).option("encoding", encoding).option("multiLine", True).option("mode", "DROPMALFORMED").option("escape", '"')
    if columns:
        r = r.schema(", ".join(f"`{c}` string" for c in columns))
    df = r.csv(path)
    # A byte-order mark sticks to the first header field.
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    out = df.select(*[F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])
    return out.withColumn("source_file", F.element_at(F.split(F.input_file_name(), "/"), -1)) if with_file else out


def by_prefix(df: DataFrame, column: str, prefixes: list[str], cycle: str | None = None) -> DataFrame:
    """Rows whose column starts with one of the prefixes (all of one length), with the cycle they belong to."""
    kept = df.where(F.substring(F.col(column), 1, len(prefixes[0])).isin(*prefixes))
    return kept if cycle is None else kept.withColumn("cycle", F.lit(cycle))


def xml_rows(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """One row per element ``tag``, nested values flattened to columns, a list's later values as name_2, name_3 ...

    There are as many columns as the longest list of the data has values: none is left out.
    """
    from pyspark.sql import types as T

    df = spark.read.format("xml").option("rowTag", tag).option("inferSchema", False).load(path)
    most: dict[str, int] = {}
    cols = []

    def lists(kind, name: str, sizes) -> None:
        """The longest list of each repeated element, one level of repeats after the other. sizes: expr -> expr of an array's size."""
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                lists(f.dataType, f"{name}_{f.name}" if name else f.name, lambda then, f=f: sizes(lambda e: then(e[f.name])))
        elif isinstance(kind, T.ArrayType):
            r = df.agg(F.max(sizes(lambda e: F.coalesce(F.size(e), F.lit(0))))).first()[0] if name not in most else most[name]
            most[name] = max(most.get(name, 0), r or 0)
            for i in range(most[name]):
                inner = name if i == 0 else f"{name}_{i + 1}"
                lists(kind.elementType, inner, lambda then, i=i: sizes(lambda e: then(F.get(e, F.lit(i)))))

    for f in df.schema.fields:
        lists(f.dataType, f.name, lambda then, f=f: then(F.col(f"`{f.name}`")))

    def walk(expr, kind, name: str) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(expr[f.name], f.dataType, f"{name}_{f.name}" if name else f.name)
        elif isinstance(kind, T.ArrayType):
            for i in range(most.get(name, 0)):
                walk(F.get(expr, F.lit(i)), kind.elementType, name if i == 0 else f"{name}_{i + 1}")
        else:
            cols.append(expr.cast("string").alias(name))

    for f in df.schema.fields:
        walk(df[f.name], f.dataType, f.name)
    return df.select(*cols)


def geojson_features(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature: its properties, its geometry as text, and the mean of its outer ring's points."""
    raw = spark.read.schema("features array<struct<properties: map<string, string>, geometry: string>>").option("multiLine", True).json(path)
    f = raw.select(F.explode("features").alias("f")).select("f.properties", "f.geometry")
    multi = F.get_json_object("geometry", "$.type") == "MultiPolygon"
    ring = F.from_json(F.when(multi, F.get_json_object("geometry", "$.coordinates[0][0]")).otherwise(F.get_json_object("geometry", "$.coordinates[0]")), "array<array<double>>")
    mean = lambda i: F.aggregate("ring", F.lit(0.0), lambda s, p: s + p[i]) / F.size("ring")
    # The last point repeats the first.
    closed = f.withColumn("ring", ring).withColumn("ring", F.slice("ring", F.lit(1), F.greatest(F.size("ring") - 1, F.lit(1))))
    return closed.select("properties", "geometry", mean(0).alias("lon"), mean(1).alias("lat"))


def house_numbers(df: DataFrame, low: str = "low", high: str = "high", street: str = "street") -> DataFrame:
    """Address directory rows: house numbers as digits (a hyphenated part kept), streets in capitals with single spaces."""
    digits = lambda c: F.nullif(F.regexp_replace(F.trim(F.col(c)), "[^0-9-]", ""), F.lit(""))
    clean = F.upper(F.regexp_replace(F.trim(F.col(street)), r"\s+", " "))
    return df.withColumn(low, digits(low)).withColumn(high, F.coalesce(digits(high), digits(low))).withColumn(street, clean).where(F.col(low).isNotNull() & (F.col(street) != ""))


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """All frames; a column that a frame lacks is null there, one that frames type differently is text."""
    kinds: dict[str, set[str]] = {}
    for f in frames:
        for name, kind in f.dtypes:
            kinds.setdefault(name, set()).add(kind)
    mixed = {n for n, k in kinds.items() if len(k) > 1}
    cast = [f.withColumns({n: F.col(n).cast("string") for n in f.columns if n in mixed}) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def write_compressed(df: DataFrame, path: str, sort: str | None = None) -> None:
    """Parquet with zstd; sorted inside files by a column that later filters use."""
    (df.sortWithinPartitions(F.col(sort).desc()) if sort else df).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, nulls as empty fields."""
    df.write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)
