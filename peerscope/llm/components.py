"""Connected components of a link table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peerscope.llm.common import written


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a long, b long); root = one node of its component.

    Every node points to the smallest of itself and its neighbours, pointers
    are followed once more, and links are carried over to where their ends
    point; links within one node go. Each round leaves at most half of the
    nodes that have links, so the number of rounds is logarithmic. A round is
    plain aggregates and equi-joins on a table that shrinks, written to the
    shared folder; links never reach the driver.
    """
    edges = written(links.where("a != b").select(F.least("a", "b").alias("a"),
                                                 F.greatest("a", "b").alias("b")).distinct(),
                    "cc-links")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    roots = nodes.select("node", F.col("node").alias("root"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("to"))
        up = parent.select(F.col("node").alias("to"), F.col("to").alias("top"))
        grand = written(parent.join(up, "to").select("node", "top"), "cc-tops")
        # one more join a round; the rounds are few, so the roots stay a plan until they are read
        roots = (roots.join(grand.withColumnRenamed("node", "_node"), F.col("root") == F.col("_node"), "left")
                 .select("node", F.coalesce("top", "root").alias("root")))
        ends = [grand.select(F.col("node").alias(c), F.col("top").alias(f"top_{c}")) for c in "ab"]
        edges = written(
            edges.join(ends[0], "a").join(ends[1], "b").where("top_a != top_b")
            .select(F.least("top_a", "top_b").alias("a"), F.greatest("top_a", "top_b").alias("b"))
            .distinct(), "cc-links")
    return written(roots, "cc-roots")
