"""The driver's tables in the roles that the operators expect."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import postings
from quillspark.session import shared_dir


#: Tables of texts: a row takes far longer to work on than to move.
TEXTS = "documents", "pages"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table; texts are dealt out to all cores where the scan has fewer splits than there are cores (a small input)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in TEXTS and df.rdd.getNumPartitions() < cores else df


def as_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one page."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), "text")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50 asks."""
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def first_words(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """query_id, words: the first n tokens of each benchmark text."""
    from quillspark.functions.text import tokens

    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.slice(tokens(F.col("text")), 1, n).alias("words"))


_INDEXES: dict[str, postings.Stored] = {}


def text_index(spark: SparkSession, sf_dir: str) -> postings.Stored:
    """The stored index of the documents; the first query of a session that asks for it builds it in the shared folder."""
    folder = f"{shared_dir(spark)}/index-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    if folder not in _INDEXES:
        _INDEXES[folder] = postings.build(table(spark, sf_dir, "documents"), folder)
    return _INDEXES[folder]
