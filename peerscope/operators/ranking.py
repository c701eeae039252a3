"""Author ranking: group max per author, zero-score padding, top-k per query.

Every paper of the corpus has a score for a submission, so an author who
shares nothing with it still ranks at 0.0. The sparse join only produces
positive pairs; the missing authors are added back as padding rows. With
at most K positive authors needed, the alphabetically first 2K authors
always contain enough zero-score candidates (ties are broken by name).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# ranks are decided on scores rounded to this many decimals, then on the
# author name, so that float summation order cannot reorder equal scores
RANK_DECIMALS = 9


def author_list(docs: DataFrame, author_col: str = "author",
                placeholder: str | None = None) -> DataFrame:
    """Sorted distinct non-null authors; optionally without a placeholder name."""
    a = docs.select(author_col).where(F.col(author_col).isNotNull())
    if placeholder is not None:
        a = a.where(F.col(author_col) != placeholder)
    return a.distinct().orderBy(author_col)


def padding_candidates(authors: DataFrame, k: int, author_col: str = "author"):
    """Scalar subquery: array of the 2k alphabetically smallest author names."""
    first = (authors.select(author_col).where(F.col(author_col).isNotNull()).distinct()
                    .orderBy(author_col).limit(2 * k))
    return first.agg(F.collect_list(author_col)).scalar()


def author_best(scores: DataFrame, query_col: str = "query_id",
                author_col: str = "author") -> DataFrame:
    """Best paper score per (query, author). NULL authors are dropped, NaN is skipped."""
    s = F.nanvl(F.col("score"), F.lit(None).cast("double"))
    return (scores.where(F.col(author_col).isNotNull())
                  .groupBy(query_col, author_col).agg(F.max(s).alias("score")))


def top_k(best: DataFrame, k: int, query_col: str = "query_id",
          author_col: str = "author") -> DataFrame:
    """Rows with rank <= k per query, rank 1..m dense, ties by author ascending."""
    w = Window.partitionBy(query_col).orderBy(
        F.round("score", RANK_DECIMALS).desc_nulls_last(), F.col(author_col).asc())
    return (best.withColumn("rank", F.row_number().over(w))
                .where(F.col("rank") <= k)
                .select(query_col, "rank", author_col, "score"))


def top_papers(scores: DataFrame, k: int, query_col: str = "query_id",
               id_col: str = "doc_id") -> DataFrame:
    """The k best papers per query with their scores and authors, ties by id."""
    w = Window.partitionBy(query_col).orderBy(
        F.round("score", RANK_DECIMALS).desc_nulls_last(), F.col(id_col).asc())
    return (scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                  .select(query_col, "rank", id_col, "author", "score"))


def rank_authors(scores: DataFrame, k: int = 5, queries: DataFrame | None = None,
                 authors: DataFrame | None = None, query_col: str = "query_id",
                 author_col: str = "author") -> DataFrame:
    """Top-k authors per query from per-paper (or per-author) scores.

    ``queries`` (query_id) and ``authors`` (author) switch on zero-score
    padding: every listed query gets k rows as long as the corpus has k
    authors, even when no paper shares a term with it.
    """
    rows = scores.select(query_col, author_col, "score")
    if queries is not None and authors is not None:
        pads = queries.select(query_col).distinct().select(
            query_col, F.explode(padding_candidates(authors, k, author_col)).alias(author_col),
            F.lit(0.0).alias("score"))
        rows = rows.unionByName(pads)
    return top_k(author_best(rows, query_col, author_col), k, query_col, author_col)


def rank_single(scores: DataFrame, k: int = 5, author_col: str = "author") -> DataFrame:
    """One submission: ``orderBy().limit(k)`` (planned as TakeOrderedAndProject)."""
    best = (scores.where(F.col(author_col).isNotNull())
                  .groupBy(author_col)
                  .agg(F.max(F.nanvl(F.col("score"), F.lit(None).cast("double"))).alias("score")))
    order = [F.round("score", RANK_DECIMALS).desc_nulls_last(), F.col(author_col).asc()]
    top = best.orderBy(*order).limit(k)
    # k rows at most: numbering them in one window is free
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select(
        "rank", author_col, "score")


def result_table(ranked: DataFrame, score_label: str = "Score",
                 author_col: str = "author") -> DataFrame:
    """Presentation projection: (Author, Score) in rank order columns."""
    cols = [c for c in ("query_id", "rank") if c in ranked.columns]
    return ranked.select(*cols, F.col(author_col).alias("Author"),
                         F.col("score").alias(score_label))
