"""Dense 0-based ids in a sort order, assigned without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peerscope.session import materialize

_ROW_BITS = 33  # monotonically_increasing_id = partition << 33 | row in partition


def with_dense_id(df: DataFrame, order_col: str, id_col: str = "paper_id") -> DataFrame:
    """Add ``id_col`` = position of the row in ``order_col`` order (0-based, dense).

    The sorted table is checkpointed so both passes see the same partitions;
    only the per-partition row counts (one row per partition) are ranked in
    one window, and they are broadcast back.
    """
    s = materialize(df.orderBy(order_col).withColumn("_mid", F.monotonically_increasing_id()))
    s = s.withColumn("_part", F.shiftright("_mid", _ROW_BITS))
    counts = s.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_part",
        (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0))
         - F.col("_n")).alias("_offset"))
    local = F.col("_mid").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (s.join(F.broadcast(offsets), "_part")
             .withColumn(id_col, (F.col("_offset") + local).cast("long"))
             .drop("_mid", "_part", "_offset"))
