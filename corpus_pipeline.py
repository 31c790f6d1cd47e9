"""From raw documents to packed training sequences: five text operators in a row.

Each stage takes what the one before wrote. Stages return the columns of
``documents`` (``n_chars`` follows the text), the last one the packed pieces.

Defined results: null texts pass the stages as null and are packed as empty ones,
empty texts as one closing id; texts of any length are taken whole; of repeated
rows one stays (empty and word-less ones aside, which link with nothing); ties go
to the smallest id, then the first row; an empty table gives no pieces; extra
columns, whatever their names, stay as they are up to the last stage.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.llm import ngram_join, packing, quality_model, queries, secret_scan, suffix_dedup
from harborlight.llm.common import free_name, joinable, read, stored


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_model.keep(docs, queries.quality(spark, docs, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of rows that link (five words, Jaccard similarity of 0.8 or more) exactly one: that with the smallest id, null ids last. Rows of one id are told apart."""
    at, word, bits = (free_name(docs, k) for k in ("row", "word", "bits"))
    if _is_scan(docs):
        # A row's file and place there stay the same when read again; the texts needn't be written once more.
        path = free_name(docs, "path")
        paths = sorted(r[0] for r in docs.select(F.col("_metadata.file_path")).distinct().collect())
        # From Arrow: a list would be read by Python workers of another kind, which stay beside the others.
        files = spark.createDataFrame(pa.table([pa.array(paths, pa.string()), pa.array([k << 40 for k in range(len(paths))], pa.int64())], [path, word]))
        rows = docs.select(*docs.columns, F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(bits)).join(F.broadcast(files), path)
        rows = rows.select(*docs.columns, (F.col(word) + F.col(bits)).alias(at))
    else:
        rows = stored(docs.withColumn(at, F.monotonically_increasing_id()), "near-duplicate-rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(at).alias("row"))
    joined = ngram_join.join(rows.select(order.alias("id"), F.col("text")), percent=80, n=5, id_col="id")
    # Which rows go, as bits: 64 rows are one, so the texts needn't be exchanged.
    gone = joined.where("not (doc_id <=> component_id)").groupBy(F.expr("doc_id.row div 64").alias(word)).agg(F.expr("bit_or(shiftleft(1L, cast(doc_id.row % 64 as int)))").alias(bits))
    found = rows.withColumn(word, F.expr(f"`{at}` div 64")).join(joinable(stored(gone, "near-duplicate-gone")), word, "left")
    return found.where(F.expr(f"`{bits}` is null or getbit(`{bits}`, cast(`{at}` % 64 as int)) = 0")).select(*docs.columns)


def _is_scan(docs: DataFrame) -> bool:
    """Whether docs is the plain reading of Parquet files."""
    plan = docs._jdf.queryExecution().analyzed()
    return plan.nodeName() == "LogicalRelation" and "parquet" in plan.toString().lower() and "_metadata" not in docs.columns


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more (of 200 bytes at least) that occur elsewhere too. Every document stays, if with less text."""
    return _counted(suffix_dedup.removed(docs, length=200, least_words=50))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets replaced by a mark. Every document stays."""
    return _counted(secret_scan.redacted(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, placed in sequences."""
    return packing.pack(docs, queries._tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeats),
    ("secret scans", secrets),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
