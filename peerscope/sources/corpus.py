"""Corpus ingest from a folder tree ``root/<author>/**/<paper>.pdf``."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerscope.functions.text import normalize_text
from peerscope.operators.extract import Stage, extract_text, failed_documents, kept_documents
from peerscope.operators.pages import PageStage, extract_files
from peerscope.session import write_table
from peerscope.sources.file_tree import list_files, read_files
from peerscope.sources.ids import with_dense_id


INGEST_OBSERVATION = "ingest"


def scan_corpus(spark: SparkSession, root: str, suffix: str = "*.pdf") -> DataFrame:
    """(full_path, author, paper, content, length, read_error): every matching file below ``root``.

    All folders and files count, whatever their names. The suffix test is
    case-sensitive (``.PDF`` is not read). The author is the first folder below
    the root; a file directly in the root gets author ``"."``. Folders and
    files that cannot be read are rows with ``read_error`` and no content.
    """
    root = _qualified(spark, root)
    files = read_files(list_files(spark, root, suffix), root)
    depth = len([p for p in _PREFIX.sub("", root).split("/") if p])
    parts = F.filter(F.split(F.regexp_replace("path", _PREFIX.pattern, ""), "/"), lambda p: p != "")
    below = F.slice(parts, depth + 1, F.size(parts))
    author = F.when(F.size(below) == 1, F.lit(".")).otherwise(F.get(below, 0))
    return files.select(
        F.col("path").alias("full_path"),
        author.alias("author"),
        F.element_at(parts, -1).alias("paper"),
        "content", "length", F.col("error").alias("read_error"))


# scheme and authority of a path
_PREFIX = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?")


def _qualified(spark: SparkSession, root: str) -> str:
    """The root as the session's file system names it: absolute, without ``..``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = fs.makeQualified(path).toUri().normalize()
    return spark._jvm.org.apache.hadoop.fs.Path(uri).toString()


def utf8_stage(content_col: str = "content") -> Stage:
    """Text layer of a file that carries plain UTF-8 text."""
    return ("utf8", F.decode(F.col(content_col), "UTF-8"))


def build_corpus(spark: SparkSession, root: str, stages: Sequence[Stage] | None = None,
                 suffix: str = "*.pdf", timeout_s: float | None = None,
                 readers: Sequence[PageStage] | None = None) -> tuple[DataFrame, DataFrame]:
    """(corpus, failed): scan, extract, keep rows with text, normalise.

    ``stages`` work on whole files; ``readers`` (instead) page by page, each
    page in a child process with a time limit (``operators.pages``).

    ``corpus``: (paper_id, author, paper, full_path, raw_text, processed_text,
    extractor); ``paper_id`` is a dense id in path order. ``failed``:
    (full_path, reason).
    """
    files = scan_corpus(spark, root, suffix)
    if readers:
        texts, _ = extract_files(files, readers)
        extracted = files.drop("content").join(texts, "full_path").withColumn(
            "status", F.when(F.col("read_error").isNotNull(), "unreadable").otherwise(F.col("status")))
    else:
        extracted = extract_text(files, stages or [utf8_stage()], source_col="content",
                                 guards=[("unreadable", F.col("read_error").isNotNull())],
                                 timeout_s=timeout_s).drop("content")
    # success / failure counts ride along with the first action, no extra pass
    extracted = extracted.observe(
        INGEST_OBSERVATION, F.count(F.lit(1)).alias("files"),
        F.count_if(F.col("status") == "ok").alias("extracted"),
        F.count_if(F.col("status") != "ok").alias("failed"))
    # extraction is the expensive step: written once, read for ids, corpus and failed list
    extracted = write_table(extracted, "extracted")
    kept = kept_documents(extracted)
    # only the narrow path column is sorted to number the papers
    ids = with_dense_id(kept.select("full_path"), "full_path", "paper_id")
    kept = kept.join(ids, "full_path")
    corpus = kept.select(
        "paper_id", "author", "paper", "full_path", "raw_text",
        normalize_text("raw_text").alias("processed_text"), "extractor")
    return corpus, failed_documents(extracted, ["full_path"])
