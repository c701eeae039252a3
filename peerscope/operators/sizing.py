"""Size checks that guard every explicit broadcast.

A side is broadcast only when its row count, measured on the materialised
table, is below a bound; otherwise the plan keeps a shuffle join and AQE
(skew-join splitting included) handles it at run time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    # vocabulary rows (term string + two numbers, ~60 bytes each) -> ~120 MB
    vocab_broadcast_rows: int = 2_000_000
    # text of the documents whose terms are counted and weighted in one task at a time
    chunk_bytes: int = 8_000_000
    # queries, documents or vectors in one block of a block pair: a pair's score
    # matrix has at most the square of it in doubles (32 MB)
    block_rows: int = 2_048
    # bytes of the document blocks on one lane, which a task holds in the join
    lane_bytes: int = 256_000_000
    # names of one Aho-Corasick automaton: about 10 MB as text
    names: int = 200_000
    # a vector corpus of up to so many blocks is multiplied whole, without pivots
    whole_blocks: int = 4
    # numbers of the vectors that a task holds of either side (64 MB)
    lane_values: int = 8_000_000
    # pivots of a larger one: a pivot table of 1,024 vectors of 1,024 doubles has 8 MB
    pivots: int = 1_024


DEFAULT_LIMITS = Limits()


def broadcast_if(df: DataFrame, rows: int, max_rows: int) -> DataFrame:
    """Broadcast hint only for a side whose measured row count is bounded."""
    return F.broadcast(df) if rows <= max_rows else df
