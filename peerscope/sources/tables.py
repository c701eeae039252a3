"""Readers for the driver tables and the corpus / submission views built on them.

``documents`` stands for the extracted papers (author = ``source``),
``benchmark`` for submitted papers, ``embeddings`` for paper vectors
(author = ``label``), ``pages`` for raw files and ``conversations`` for the
ordered pages of a document.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerscope.functions.text import normalize_text

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-spread a scan that yields fewer splits than the cluster has cores.

    A large input already arrives in many splits and is left alone (no
    shuffle); a single-row-group file would otherwise run in one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)


def documents_corpus(spark: SparkSession, sf_dir: str, min_token_len: int = 1) -> DataFrame:
    """Corpus view: (doc_id, author, raw_text, processed_text).

    Rows with empty raw text are the failed files of ingest and are left
    out, exactly as a paper without extracted text never enters the corpus.
    """
    docs = spread(read_table(spark, sf_dir, "documents"), "doc_id")
    kept = docs.where(F.col("text").isNotNull() & (F.col("text") != ""))
    return kept.select(
        "doc_id",
        F.col("source").alias("author"),
        F.col("text").alias("raw_text"),
        normalize_text("text", min_token_len=min_token_len).alias("processed_text"),
    )


def benchmark_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submissions: (query_id, raw_text, processed_text) with the submission cleaning."""
    b = spread(read_table(spark, sf_dir, "benchmark"), "item_id")
    return b.select(
        F.col("item_id").alias("query_id"),
        F.col("text").alias("raw_text"),
        normalize_text("text", min_token_len=2).alias("processed_text"),
    )


def embedding_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paper vectors: (paper_id, author, embedding array<double>)."""
    e = read_table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("paper_id"),
        F.col("label").cast("string").alias("author"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


def select_papers(corpus: DataFrame, ids: list[int] | None = None,
                  paths: list[str] | None = None, id_col: str = "doc_id",
                  path_col: str = "full_path") -> DataFrame:
    """Point lookups: papers by position id and/or by full path (one row per path)."""
    out = corpus
    if ids is not None:
        out = out.where(F.col(id_col).isin(list(ids)))
    if paths is not None:
        from pyspark.sql import Window
        w = Window.partitionBy(path_col).orderBy(id_col)
        out = (out.where(F.col(path_col).isin(list(paths)))
                  .withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n"))
    return out
