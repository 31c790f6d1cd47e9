"""Finding and opening tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One Parquet table of a data folder, by any path that Spark can read."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def register(spark: SparkSession, base: str, names: tuple[str, ...] = TABLES) -> None:
    """Make the tables of a data folder available to spark.sql by their names."""
    for name in names:
        table(spark, base, name).createOrReplaceTempView(name)


def describe(spark: SparkSession, base: str, names: tuple[str, ...] = TABLES) -> DataFrame:
    """(table_name, column_name, data_type, comment) of all tables, from their schemas alone."""
    rows = [(n, f.name, f.dataType.simpleString(), f.metadata.get("comment")) for n in names for f in table(spark, base, n).schema.fields]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, comment string")


def commented(df: DataFrame, comments: dict[str, str]) -> DataFrame:
    """df with comments on its columns, kept in the schema and in files written from it."""
    return df.select(*[df[c].alias(c, metadata={**df.schema[c].metadata, "comment": comments[c]}) if c in comments else df[c] for c in df.columns])


def find(spark: SparkSession, base: str, words: str, names: tuple[str, ...] = TABLES, least: float = 70.0) -> list[tuple[str, float]]:
    """Tables that suit a search, best first: by likeness of the words to the names of tables and columns."""
    from harborlight.functions.matching import partial_ratio, token_set_ratio

    q = words.lower().strip()
    scores: dict[str, float] = {}
    for n in names:
        columns = table(spark, base, n).columns
        scores[n] = max(partial_ratio(q, n), *(0.9 * token_set_ratio(q, c.replace("_", " ").lower()) for c in columns))
    return sorted(((n, round(s, 1)) for n, s in scores.items() if s >= least), key=lambda x: (-x[1], x[0]))
