"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words. A document of a source with
target ratio r is wanted r times: floor(r) whole copies, and one more with
probability r - floor(r). The fractional probabilities are rounded by the
pivotal method: two documents meet, copy mass (probability times words) moves
from one to the other at random and without bias, until one of the two is 0
or 1; the other goes on. Mass is kept at every meeting, so the words taken from
a source differ from its target by part of one document only. Meetings form a
reduction tree: leaves of about ``leaf_rows`` documents of one source, then
their residuals in groups, level by level, up to one residual per source.

Defined results: null or empty text has size 0 and is never worth a word; a
null source is a source of its own (last in order); repeated rows are rows of
their own; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peerscope.llm.common import WORD_PATTERN, free_name, union_all, written
from peerscope.sources.ids import with_dense_id

_FIELDS = ("doc_id long, source string, size long, source_size long, target double, "
           "base int, p double, node long, extra int")


def document_sizes(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, source, size): words of each text."""
    words = F.regexp_count(F.col(text_col), F.lit(WORD_PATTERN))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"),
                       F.coalesce(words, F.lit(0)).cast("long").alias("size"))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3),
                   max_ratio: float = 3.0) -> DataFrame:
    """(source, source_size, n_docs, target).

    Sources in code-point order, null last, weigh ``weights`` in turn and share
    the total number of words; a target above ``max_ratio`` times its source
    stops there and the excess goes to the others by weight. The fixed point
    is one number, the words per unit of weight, raised until no further source
    is capped; each step is one aggregate over the source table.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"),
                                             F.count(F.lit(1)).alias("n_docs"))
    order = F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"),
                     F.coalesce("source", F.lit("")))
    numbered = with_dense_id(per_source.withColumn("_order", order), "_order", "_rank")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighted = written(numbered.select(
        "source", "source_size", "n_docs",
        F.element_at(cycle, (F.col("_rank") % len(weights) + 1).cast("int")).alias("weight"),
        (F.col("source_size") * max_ratio).alias("ceiling")), "mix-sources")
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while total:
        over = F.col("weight") * level >= F.col("ceiling")
        row = weighted.agg(
            F.sum(F.when(over & (F.lit(level) > 0), F.col("ceiling")).otherwise(0.0)).alias("taken"),
            F.sum(F.when(over & (F.lit(level) > 0), 0.0).otherwise(F.col("weight"))).alias("open"),
            F.sum((over & (F.lit(level) > 0)).cast("long")).alias("capped")).first()
        if row["capped"] == capped or not row["open"]:
            break
        capped, level = row["capped"], (total - row["taken"]) / row["open"]
    return weighted.select("source", "source_size", "n_docs",
                           F.least("ceiling", F.col("weight") * F.lit(float(level))).alias("target"))


def _pivot(rows: pd.DataFrame, seed: int, level: int) -> pd.DataFrame:
    """Round the probabilities of one group; at most one row keeps a fraction.

    Large documents meet first, so that the one left over at the end, whose
    fraction is the group's rounding error, tends to be small.
    """
    rows = rows.sort_values(["size", "doc_id"], ascending=[False, True], kind="stable",
                            ignore_index=True)
    size, p = rows["size"].to_numpy(), rows["p"].to_numpy().copy()
    key = (int(rows["doc_id"].fillna(0).iloc[0]), int(rows["node"].iloc[0]), level, seed)
    draws = np.random.default_rng([k & 0xFFFFFFFF for k in key]).random(len(rows))
    held = -1
    for j in range(len(rows)):
        if not 0.0 < p[j] < 1.0:
            continue
        if size[j] == 0:            # no words to move: rounded on its own
            p[j] = 1.0 if draws[j] < p[j] else 0.0
            continue
        if held < 0:
            held = j
            continue
        i, ratio = held, size[held] / size[j]
        up = min(1.0 - p[i], p[j] / ratio)
        down = min(p[i], (1.0 - p[j]) / ratio)
        rise = draws[j] * (up + down) < down
        if rise:
            i_done, j_done = up == 1.0 - p[i], up == p[j] / ratio
            p[i], p[j] = (1.0 if i_done else p[i] + up), (0.0 if j_done else p[j] - up * ratio)
        else:
            i_done, j_done = down == p[i], down == (1.0 - p[j]) / ratio
            p[i], p[j] = (0.0 if i_done else p[i] - down), (1.0 if j_done else p[j] + down * ratio)
        held = -1 if i_done and j_done else j if i_done else i
    rows["p"] = np.clip(p, 0.0, 1.0)
    return rows


def _reduce_level(open_rows: DataFrame, seed: int, level: int, last: bool) -> DataFrame:
    def group(rows: pd.DataFrame) -> pd.DataFrame:
        out = _pivot(rows, seed, level)
        p = out["p"].to_numpy()
        left = (p > 0.0) & (p < 1.0)
        if last:
            draw = np.random.default_rng([seed, level, int(out["size"].sum()) & 0xFFFFFFFF]).random()
            p = np.where(left, (draw < p).astype(float), p)
            left[:] = False
        out["p"] = p
        out["extra"] = np.where(left, -1, np.rint(p)).astype("int32")
        return out

    return open_rows.groupBy("source", "node").applyInPandas(group, _FIELDS)


def mix_sources(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_ratio: float = 3.0,
                leaf_rows: int = 1024, fan_in: int = 256, seed: int = 7,
                text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    ``copies`` is how often the mix takes the document, ``taken`` its words.
    Groups are dealt by a hash of doc_id, so a rerun decides alike. Only
    numbers are shuffled, and a source of any size is spread over its leaves.
    """
    sizes = written(document_sizes(docs, text_col), "mix-sizes")
    targets = written(source_targets(sizes, weights, max_ratio), "mix-targets")
    largest = targets.agg(F.max("n_docs")).first()[0] or 0
    # sources are joined null-safely; the table has one row per source
    joined = sizes.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    ratio = F.when(F.col("t.source_size") > 0,
                   F.least(F.lit(float(max_ratio)), F.col("t.target") / F.col("t.source_size"))
                   ).otherwise(0.0)
    leaves = F.ceil(F.col("t.n_docs") / leaf_rows).cast("long")
    state = joined.select(
        "d.doc_id", "d.source", "d.size", "t.source_size", "t.target",
        F.floor(ratio).cast("int").alias("base"), (ratio - F.floor(ratio)).alias("p"),
        F.coalesce(F.pmod(F.xxhash64("d.doc_id", F.lit(seed)), leaves), F.lit(0)).alias("node"),
        F.lit(-1).alias("extra"))
    levels = 1 + max(0, math.ceil(math.log(max(1, math.ceil(largest / leaf_rows)), fan_in) - 1e-9))
    done = []
    for level in range(levels):
        state = written(_reduce_level(state, seed, level, level == levels - 1), f"mix-level{level}")
        done.append(state.where("extra >= 0"))
        state = state.where("extra < 0").withColumn("node", F.floor(F.col("node") / fan_in))
    copies = F.col("base") + F.col("extra")
    return union_all(done).select("doc_id", "source", "size", "source_size", "target",
                                  copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def repeat_documents(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """The documents as the mix takes them: each row as many times as its copies.

    Rows that agree in doc_id, source and size are matched to the decisions of
    such rows one by one.
    """
    names = {n: free_name(docs, n) for n in ("_turn", "_copies", "_size", "_id", "_source", "_words", "_t")}
    turn, times, size = names["_turn"], names["_copies"], names["_size"]
    words = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    left = docs.withColumn(size, words)
    left = left.withColumn(turn, F.row_number().over(Window.partitionBy("doc_id", "source", size).orderBy(F.lit(0))))
    alike = Window.partitionBy("doc_id", "source", "size").orderBy(F.desc("copies"))
    right = (mix.withColumn(turn, F.row_number().over(alike)).where("copies > 0")
             .select(F.col("doc_id").alias(names["_id"]), F.col("source").alias(names["_source"]),
                     F.col("size").alias(names["_words"]), F.col(turn).alias(names["_t"]), F.col("copies").alias(times)))
    kept = left.join(right, F.col("doc_id").eqNullSafe(F.col(names["_id"]))
                     & F.col("source").eqNullSafe(F.col(names["_source"]))
                     & (F.col(size) == F.col(names["_words"])) & (F.col(turn) == F.col(names["_t"])))
    return (kept.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times))))
            .select(*docs.columns))
