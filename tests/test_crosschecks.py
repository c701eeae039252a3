"""Cross-checks of the relational operators against Spark ML's built-ins."""

import pytest
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from peerscope.functions.text import model_tokens
from peerscope.operators.dense import author_profiles
from peerscope.operators.tfidf import term_counts


def test_term_counts_equal_count_vectorizer(spark):
    texts = ["deep model deep", "model graph xx", "", "a bb cc bb bb"]
    corpus = spark.createDataFrame([(i, "a", t) for i, t in enumerate(texts)],
                                   "doc_id long, author string, processed_text string")
    words = corpus.select("doc_id", model_tokens("processed_text").alias("w"))
    model = CountVectorizer(inputCol="w", outputCol="v", minDF=1.0).fit(words)
    vocab = model.vocabulary
    want = {}
    for r in model.transform(words).collect():
        for idx, cnt in zip(r.v.indices, r.v.values):
            want[(r.doc_id, vocab[idx])] = int(cnt)
    got = {(r.doc_id, r.term): r.tf for r in term_counts(corpus, ngram_max=1).collect()}
    assert got == want


def test_profiles_equal_summarizer_mean(spark):
    rows = [(0, "a", [1.0, 2.0, 3.0]), (1, "a", [3.0, 0.0, -1.0]), (2, "b", [0.5, 0.5, 0.5])]
    corpus = spark.createDataFrame(rows, "paper_id long, author string, embedding array<double>")
    ours = {r.author: r.profile for r in author_profiles(corpus).collect()}
    vec = spark.createDataFrame([(a, Vectors.dense(v)) for _, a, v in rows], ["author", "v"])
    ml = {r.author: list(r.m) for r in
          vec.groupBy("author").agg(Summarizer.mean(F.col("v")).alias("m")).collect()}
    assert ours.keys() == ml.keys()
    for a in ours:
        assert ours[a] == pytest.approx(ml[a])
