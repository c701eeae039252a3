"""Blocks of queries against blocks of rows, paired and scored on the executors.

Both sides are dealt to blocks by a hash; a block is one row of arrays. Every
query block meets every row block through an equi-join on the row block's
number, so neither side passes through the driver. A task scores one pair with
numpy and emits, per query, only the first k candidates by (score rounded
to nine places, falling; name, rising). A candidate of the overall first k is
among the first k of the block that holds its best row, and whoever precedes it
there precedes it overall, so merging the blocks' lists gives the exact result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerscope.operators.ranking import RANK_DECIMALS
from peerscope.session import write_table


def packed(rows: DataFrame, key: str, values: dict[str, Column], per_block: int, block_col: str,
           kind: Column | None = None) -> DataFrame:
    """(block, kind, one array per value): the rows in blocks of about ``per_block``.

    Rows of different ``kind`` (for example vector lengths) are never in one block.
    """
    table = write_table(rows.select(F.col(key).alias("_key"), (kind if kind is not None else F.lit(0)).alias("kind"),
                                    *[c.alias(n) for n, c in values.items()]), "block-rows")
    blocks = max(1, math.ceil(table.count() / per_block))
    dealt = table.groupBy(F.pmod(F.xxhash64("_key"), F.lit(blocks)).alias(block_col), "kind").agg(
        F.collect_list(F.struct(*values)).alias("_rows"))
    return dealt.select(block_col, "kind", *[F.col(f"_rows.{n}").alias(n) for n in values])


def every_pair(queries: DataFrame, rows: DataFrame, row_block: str) -> DataFrame:
    """Every query block beside every row block of its kind."""
    routed = queries.join(rows.select(row_block, "kind"), "kind")
    return routed.join(rows, [row_block, "kind"])


def best_by_name(scores: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column maxima of a (queries, rows) matrix per distinct name; NaN is skipped."""
    codes, distinct = pd.factorize(names, sort=True)
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0])
    return np.fmax.reduceat(scores[:, order], starts, axis=1), np.asarray(distinct, dtype=object)


# candidates for each place of the lists, or one in so many scores, up to which they are ranked one by one
_FEW, _SHARE = 16, 32


def _first_of(scores: np.ndarray, near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The first k per row of the marked places, if those are few."""
    if np.count_nonzero(near) > max(_FEW * k * len(scores), scores.size // _SHARE):
        return None
    q, c = np.nonzero(near)
    value = scores[q, c]
    value = np.where(np.isnan(value), -np.inf, np.round(value, RANK_DECIMALS))
    by = np.lexsort((c, -value, q))
    kept = np.sort(by[np.arange(len(by)) - np.searchsorted(q, q[by]) < k])
    return q[kept], c[kept]


def first_k(scores: np.ndarray, names: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) positions of the first k per row; ``names`` are in rising order.

    Columns with a NaN score come last, as NULL scores do in a ranking. ``least``:
    a score of each row below which nothing is wanted, and may be left out.
    """
    k = min(k, scores.shape[1])
    if least is not None and (found := _first_of(scores, ~(scores < least[:, None]), k)) is not None:
        return found
    if k < scores.shape[1]:
        filled = np.where(np.isnan(scores), -np.inf, scores)
        kth = np.partition(filled, -k, axis=1)[:, -k, None]
        # rounding lifts nothing from further below to the k-th place
        if (found := _first_of(filled, filled >= kth - 2 * 10.0 ** -RANK_DECIMALS, k)) is not None:
            return found
        rounded = np.round(filled, RANK_DECIMALS)
        kth = np.round(kth, RANK_DECIMALS)
        above = rounded > kth
        # ties at the k-th place: the first names fill the places that are left
        room = k - above.sum(axis=1, keepdims=True)
        tied = rounded == kth
        keep = above | (tied & (np.cumsum(tied, axis=1) <= room))
    else:
        keep = np.ones(scores.shape, bool)
    return np.nonzero(keep)
