import math

from peerscope.operators.ranking import rank_authors, rank_single


def _scores(spark, rows):
    return spark.createDataFrame(rows, "query_id long, author string, score double")


def test_x15_null_author_dropped_nan_skipped(spark):
    s = _scores(spark, [(1, None, 0.9), (1, "a", math.nan), (1, "a", 0.2), (1, "b", 0.1)])
    got = [(r.rank, r.author, r.score) for r in rank_authors(s, 5).orderBy("rank").collect()]
    assert got == [(1, "a", 0.2), (2, "b", 0.1)]


def test_x16_ties_by_author_ascending(spark):
    s = _scores(spark, [(1, "c", 0.5), (1, "a", 0.5), (1, "b", 0.5 + 1e-12)])
    got = [r.author for r in rank_authors(s, 3).orderBy("rank").collect()]
    assert got == ["a", "b", "c"]


def test_group_max_and_top_k_per_query(spark):
    s = _scores(spark, [(1, "a", 0.1), (1, "a", 0.7), (1, "b", 0.3), (2, "b", 0.9), (2, "c", 0.8),
                        (2, "a", 0.1)])
    got = [(r.query_id, r.rank, r.author) for r in
           rank_authors(s, 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, "a"), (1, 2, "b"), (2, 1, "b"), (2, 2, "c")]


def test_padding_fills_missing_authors_with_zero(spark):
    s = _scores(spark, [(1, "d", 0.4)])
    authors = spark.createDataFrame([(a,) for a in ["e", "d", "c", "b", "a", None]], "author string")
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    got = [(r.query_id, r.rank, r.author, r.score) for r in
           rank_authors(s, 3, queries=queries, authors=authors).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, "d", 0.4), (1, 2, "a", 0.0), (1, 3, "b", 0.0),
                   (2, 1, "a", 0.0), (2, 2, "b", 0.0), (2, 3, "c", 0.0)]


def test_single_query_limit_form(spark):
    s = spark.createDataFrame([("a", 0.1), ("b", 0.9), ("c", 0.5)], "author string, score double")
    ranked = rank_single(s, 2)
    assert [(r.rank, r.author) for r in ranked.collect()] == [(1, "b"), (2, "c")]
    assert "TakeOrderedAndProject" in ranked._jdf.queryExecution().executedPlan().toString()


def test_r14_r15_author_list_sorted_distinct_without_placeholder(spark):
    from peerscope.operators.ranking import author_list
    docs = spark.createDataFrame([("b",), ("Unknown_Author",), ("a",), (None,), ("b",)], "author string")
    assert [r.author for r in author_list(docs).collect()] == ["Unknown_Author", "a", "b"]
    assert [r.author for r in author_list(docs, placeholder="Unknown_Author").collect()] == ["a", "b"]


def test_r16_r17_point_lookups(spark):
    from peerscope.sources.tables import select_papers
    corpus = spark.createDataFrame([(0, "/x/a.pdf"), (1, "/x/b.pdf"), (2, "/x/b.pdf")],
                                   "doc_id long, full_path string")
    assert [r.doc_id for r in select_papers(corpus, ids=[2]).collect()] == [2]
    assert [r.doc_id for r in select_papers(corpus, paths=["/x/b.pdf"]).collect()] == [1]


def test_r18_k_bounds_and_r19_projection(spark):
    import pytest
    from peerscope.operators.ranking import result_table
    from peerscope.operators.recommend import check_k
    assert check_k(3) == 3 and check_k(20) == 20
    for bad in (2, 21, 5.0, True):
        with pytest.raises(ValueError):
            check_k(bad)
    ranked = spark.createDataFrame([(1, 1, "a", 0.5)], "query_id long, rank int, author string, score double")
    assert result_table(ranked).columns == ["query_id", "rank", "Author", "Score"]
