import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from peerscope.operators.recommend import recommend_tfidf
from peerscope.operators.tfidf import fit_tfidf, sparse_cosine, term_counts, transform_tfidf


def _grams(text):
    w = [t for t in text.split(" ") if len(t) >= 2]
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def _reference_weights(texts, min_df, max_df):
    """Independent plain-Python smoothed TF-IDF with L2 rows."""
    n = len(texts)
    counts = [Counter(_grams(t)) for t in texts]
    df = Counter(term for c in counts for term in c)
    lo = min_df if isinstance(min_df, int) else min_df * n
    hi = max_df if isinstance(max_df, int) else max_df * n
    vocab = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items() if lo <= d <= hi}
    rows = {}
    for i, c in enumerate(counts):
        w = {t: tf * vocab[t] for t, tf in c.items() if t in vocab}
        norm = math.sqrt(sum(v * v for v in w.values()))
        rows[i] = {t: v / norm for t, v in w.items()} if norm else {}
    return vocab, rows


TEXTS = ["deep model learning", "deep model graph", "graph learning data model",
         "data data model", ""]


def _corpus(spark, texts=TEXTS, authors=None):
    authors = authors or [f"a{i % 3}" for i in range(len(texts))]
    return spark.createDataFrame([(i, authors[i], t) for i, t in enumerate(texts)],
                                 "doc_id long, author string, processed_text string")


def test_golden_weights_match_plain_python(spark):
    index = fit_tfidf(_corpus(spark), min_df=2, max_df=1.0)
    vocab, rows = _reference_weights(TEXTS, 2, 1.0)
    got_vocab = {r.term: r.idf for r in index.vocab.collect()}
    assert got_vocab.keys() == vocab.keys()
    for t in vocab:
        assert got_vocab[t] == pytest.approx(vocab[t], rel=1e-12)
    got = {(r.doc_id, r.term): r.weight for r in index.postings.collect()}
    want = {(i, t): v for i, w in rows.items() for t, v in w.items()}
    assert got.keys() == want.keys()
    for key, v in want.items():
        assert got[key] == pytest.approx(v, rel=1e-12)


def test_rows_have_unit_norm_and_empty_text_counts_in_n(spark):
    index = fit_tfidf(_corpus(spark), min_df=1, max_df=1.0)
    assert index.n_docs == 5
    norms = index.postings.groupBy("doc_id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()
    assert all(r.s == pytest.approx(1.0) for r in norms)


def test_x10_pruning_bounds_inclusive(spark):
    # n = 10; term "t4" in 4 docs, "t5" in 5, "t8" in 8, "t9" in 9; max_df 0.8 -> 8 docs
    texts = []
    for i in range(10):
        words = [w for w, d in (("tfour", 4), ("tfive", 5), ("teight", 8), ("tnine", 9)) if i < d]
        texts.append(" ".join(words))
    corpus = spark.createDataFrame([(i, "a", t) for i, t in enumerate(texts)],
                                   "doc_id long, author string, processed_text string")
    index = fit_tfidf(corpus, min_df=5, max_df=0.8, ngram_max=1)
    assert sorted(r.term for r in index.vocab.collect()) == ["teight", "tfive"]


def test_x11_idf_value(spark):
    corpus = spark.createDataFrame([(0, "a", "zz"), (1, "a", "yy"), (2, "a", "xx")],
                                   "doc_id long, author string, processed_text string")
    index = fit_tfidf(corpus, min_df=1, max_df=1.0, ngram_max=1)
    idf = {r.term: r.idf for r in index.vocab.collect()}
    assert idf["zz"] == pytest.approx(1.6931471805599454, abs=1e-15)


def test_x13_all_terms_pruned_raises(spark):
    with pytest.raises(ValueError, match="no terms remain"):
        fit_tfidf(_corpus(spark), min_df=5, max_df=1.0)
    with pytest.raises(ValueError, match="fewer documents than min_df"):
        fit_tfidf(_corpus(spark), min_df=50)


def test_term_counts_match_counter(spark):
    got = {(r.doc_id, r.term): r.tf for r in term_counts(_corpus(spark)).collect()}
    want = {(i, t): c for i, text in enumerate(TEXTS) for t, c in Counter(_grams(text)).items()}
    assert got == want


def test_sparse_cosine_equals_dense_dot(spark):
    index = fit_tfidf(_corpus(spark), min_df=1, max_df=1.0)
    q = spark.createDataFrame([(7, "model learning graph")], "query_id long, processed_text string")
    scores = {r.doc_id: r.score for r in sparse_cosine(transform_tfidf(q, index), index).collect()}
    vocab, rows = _reference_weights(TEXTS, 1, 1.0)
    qc = Counter(_grams("model learning graph"))
    qw = {t: c * vocab[t] for t, c in qc.items() if t in vocab}
    qn = math.sqrt(sum(v * v for v in qw.values()))
    for i, w in rows.items():
        dot = sum(qw.get(t, 0.0) / qn * v for t, v in w.items())
        if dot > 0:
            assert scores[i] == pytest.approx(dot, rel=1e-12)
        else:
            assert i not in scores


def test_x12_unknown_words_rank_k_authors_at_zero(spark):
    authors = ["b", "a", "c", "d", "e"]
    index = fit_tfidf(_corpus(spark, authors=authors), min_df=1, max_df=1.0)
    subs = spark.createDataFrame([(1, "qqqq zzzz"), (2, "")], "query_id long, processed_text string")
    got = recommend_tfidf(subs, index, k=3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.author, r.score) for r in got] == [
        (1, 1, "a", 0.0), (1, 2, "b", 0.0), (1, 3, "c", 0.0)]


def test_block_scoring_equals_join_scoring(spark):
    import random
    rng = random.Random(3)
    vocab = ["alpha", "beta", "gamma", "delta", "omega", "theta", "kappa", "sigma", "zeta"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 30))) for _ in range(60)]
    texts[5] = ""  # an empty paper: its author may only appear through padding
    authors = [f"au{i % 7}" for i in range(60)]
    authors[5] = "zz_only_empty"
    corpus = spark.createDataFrame([(i, authors[i], t) for i, t in enumerate(texts)],
                                   "doc_id long, author string, processed_text string")
    index = fit_tfidf(corpus, min_df=2, max_df=0.9)
    subs = spark.createDataFrame(
        [(q, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 12)))) for q in range(25)]
        + [(99, "unknownword another")], "query_id long, processed_text string")
    block = sorted((r.query_id, r.rank, r.author, round(r.score, 9)) for r in
                   recommend_tfidf(subs, index, k=9, scoring="block").collect())
    join = sorted((r.query_id, r.rank, r.author, round(r.score, 9)) for r in
                  recommend_tfidf(subs, index, k=9, scoring="join").collect())
    assert block == join
    assert len(block) == 26 * 8  # 8 authors in the corpus, k = 9


def test_block_product_in_any_chunk_size(monkeypatch):
    import numpy as np

    import peerscope.operators.sparse_block as sb
    from peerscope.operators.blocks import best_by_name, first_k

    q = np.array([10, 11, 11]), np.array([0, 0, 1]), np.array([0.6, 0.8, 1.0])
    d = np.array([10, 11, 10, 11, 12]), np.array([0, 1, 2, 2, 3]), np.array([1.0, 1.0, 0.6, 0.8, 1.0])
    want = np.array([[0.6, 0.8, 1.0, 0.0], [0.0, 1.0, 0.8, 0.0]])
    for products in (4_000_000, 2, 1):
        monkeypatch.setattr(sb, "_TARGET_PRODUCTS", products)
        assert np.allclose(sb._products(*q, *d, 2, 4), want)
    best, names = best_by_name(want, np.array(["a", "b", "a", "c"], dtype=object))
    assert names.tolist() == ["a", "b", "c"] and np.allclose(best, [[1.0, 0.8, 0.0], [0.8, 1.0, 0.0]])
    assert sb._products(*(x[:0] for x in q), *d, 2, 4).tolist() == np.zeros((2, 4)).tolist()
    # ties at the last place go to the first names
    rows, columns = first_k(np.array([[0.5, 0.5, 0.5, 0.9], [np.nan, 0.1, 0.2, np.nan]]), np.arange(4), 2)
    assert list(zip(rows.tolist(), columns.tolist())) == [(0, 0), (0, 3), (1, 1), (1, 2)]
