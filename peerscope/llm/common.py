"""Shared pieces of the training-data operators."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peerscope.session import scratch_path

# fixed values: the white space of the operator contracts, \x20 and \x09-\x0D
ASCII_SPACE = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

HELD_OUT_FOLDS = 4
HELD_OUT_FOLD = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and read it back.

    The written table cuts the lineage: a lost executor repeats tasks of the
    readers only, and every reader sees the same rows.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def held_out(doc_id: Column) -> Column:
    """True for documents whose label is never learnt from."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_FOLDS) == HELD_OUT_FOLD


def hash_below(key: Column, share: float | Column) -> Column:
    """True for about ``share`` of the keys: those with the smallest ``xxhash64``; all, from 1 on."""
    share = share if isinstance(share, Column) else F.lit(float(share))
    return (share >= 1.0) | (F.xxhash64(key).cast("double") < -(2.0**63) + share * 2.0**64)


def null_safe_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that does not clash with any column of ``df``."""
    taken, name, n = {c.lower() for c in df.columns}, stem, 0
    while name.lower() in taken:
        n += 1
        name = f"{stem}{n}"
    return name


def worker_memory(key: tuple, make):
    """An object that lives as long as the Python worker, made by ``make`` at its first use.

    Functions are shipped to the tasks by value, so module globals start anew
    with every task; what is worth keeping for the next task of the same worker
    (a loaded tokenizer file, a bounded cache) is kept under ``key``.
    """
    import sys
    import types

    name = "_peerscope_worker_memory"
    kept = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def release_memory() -> None:
    """Give memory that a task no longer uses back to the system: idle workers stay beside the JVM."""
    import ctypes
    import gc

    import pyarrow as pa
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def drop_oldest_half(cache: dict) -> None:
    for old in [k for k, _ in zip(cache, range(len(cache) // 2))]:
        del cache[old]
