"""The README quick start, end to end on a generated folder tree."""

import os
import random

from pyspark.sql import functions as F

import peerscope as ps


def test_quick_start_workflow(spark, tmp_dir):
    rng = random.Random(1)
    words = "graph model learning data network theory deep signal vision robot".split()
    root = os.path.join(tmp_dir, "papers")
    for a in range(4):
        folder = os.path.join(root, f"author{a}")
        os.makedirs(folder)
        for p in range(8):
            with open(os.path.join(folder, f"p{p}.pdf"), "w") as f:
                f.write(" ".join(rng.choice(words[a * 2:a * 2 + 5]) for _ in range(60)))
    corpus, failed = ps.build_corpus(spark, root)
    corpus = corpus.withColumnRenamed("paper_id", "doc_id")
    index = ps.fit_tfidf(corpus, min_df=2)
    vectors = ps.hashing_vectors(corpus, dim=64).withColumnRenamed("doc_id", "paper_id")
    vector_corpus = vectors.join(
        corpus.select(F.col("doc_id").alias("paper_id"), "author"), "paper_id")
    ps.save_index(os.path.join(tmp_dir, "index"), corpus, vectors, index)
    subs = (corpus.select(F.col("doc_id").alias("query_id"), "raw_text")
            .join(vectors.withColumnRenamed("paper_id", "query_id"), "query_id")
            .withColumn("processed_text", ps.normalize_text("raw_text", min_token_len=2)))
    top = ps.recommend(subs, index, vector_corpus, k=3).collect()
    assert failed.count() == 0
    # every paper is its own exact copy (score 1 >= 0.98), so its author is excluded
    own = {r.doc_id: r.author for r in corpus.collect()}
    assert top and all(r.author != own[r.query_id] for r in top)
    assert all(r.rank <= 3 for r in top)
    assert ps.similar_authors(ps.author_profiles(vector_corpus), k=2).count() == 8
