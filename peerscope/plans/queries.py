"""The registered queries: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads the whole driver tables it names. Double outputs are
rounded to 6 decimals so results compare across engines; ranks are taken
on scores rounded to 9 decimals with ties by author name.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerscope.functions.text import normalize_text
from peerscope.operators.bounded_index import bounded_papers
from peerscope.operators.dense import (author_profiles, dense_top_papers, recommend_dense,
                                      similar_authors)
from peerscope.operators.encode import hashed_counts, hashing_vectors
from peerscope.operators.evaluate import compare_methods, evaluate
from peerscope.operators.exclusions import excluded_authors, listed_authors
from peerscope.operators.extract import (concat_pages, extract_text, failed_documents,
                                         page_stages)
from peerscope.operators.lsa import corpus_vectors, fit_lsa
from peerscope.operators.ranking import author_list, top_papers
from peerscope.operators.recommend import (excluded_by_score, recommend, recommend_tfidf,
                                           submission_status, valid_submissions)
from peerscope.operators.sizing import Limits
from peerscope.operators.tfidf import fit_tfidf, sparse_cosine, term_counts, transform_tfidf
from peerscope.plans.stand_ins import author_directory
from peerscope.session import scratch_path, write_table
from peerscope.sources.index_io import load_index, save_index
from peerscope.sources.sinks import export_csv, read_csv
from peerscope.sources.tables import (benchmark_submissions, documents_corpus, embedding_corpus,
                                      read_table, select_papers, spread)
from peerscope.sources.vectors import align_vectors
from peerscope.streaming.recommendations import stream_recommendations

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
K = 5
OVERFETCH = 5


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def r6(c) -> F.Column:
    return F.round(c, 6)


_INDEXES: dict[tuple, object] = {}


def _index(spark, sf_dir, min_df=5, max_df=0.8):
    """The fitted index of the documents, built once per application and table version.

    Like a served model it is fitted once and reused by every query of the
    session; its vocabulary and postings are written tables, so reuse
    survives lost executors. Rewritten documents (another modification time) are
    fitted anew.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/documents.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    version = sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path))
    key = (spark.sparkContext.applicationId, tuple(version), min_df, max_df)
    if key not in _INDEXES:
        _INDEXES[key] = fit_tfidf(documents_corpus(spark, sf_dir), min_df=min_df, max_df=max_df)
    return _INDEXES[key]


@query("q01_corpus_summary")
def q01_corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(read_table(spark, sf_dir, "documents"), "doc_id")
    ok = F.col("text").isNotNull() & (F.col("text") != "")
    processed = normalize_text("text")
    return d.groupBy(F.col("source").alias("author")).agg(
        F.count_if(ok).alias("n_papers"),
        F.count_if(~ok).alias("n_failed"),
        F.count_if(ok & (processed == "")).alias("n_empty_processed"),
        F.sum(F.when(ok, F.col("n_chars"))).alias("total_chars"),
    )


@query("q02_normalize_text")
def q02_normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = documents_corpus(spark, sf_dir)
    return c.select("doc_id", "processed_text",
                    normalize_text("raw_text", min_token_len=2).alias("query_text"))


@query("q03_term_counts")
def q03_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_counts(documents_corpus(spark, sf_dir), author_col=None)


@query("q04_vocabulary")
def q04_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _index(spark, sf_dir).vocab
    return v.select("term", "df", r6("idf").alias("idf"))


@query("q04b_vocabulary_max_df")
def q04b_vocabulary_max_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _index(spark, sf_dir, max_df=0.25).vocab
    return v.select("term", "df", r6("idf").alias("idf"))


@query("q05_tfidf_weights")
def q05_tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _index(spark, sf_dir).postings
    return p.select("doc_id", "term", "tf", r6("weight").alias("weight"))


@query("q06_transform_queries")
def q06_transform_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    q = transform_tfidf(benchmark_submissions(spark, sf_dir), index)
    return q.select("query_id", "term", "tf", r6("weight").alias("weight"))


@query("q07_sparse_cosine")
def q07_sparse_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closest documents of every submission with their cosine."""
    index = _index(spark, sf_dir)
    q = transform_tfidf(benchmark_submissions(spark, sf_dir), index)
    s = top_papers(sparse_cosine(q, index), K)
    return s.select("query_id", "rank", "doc_id", "author", r6("score").alias("score"))


@query("q08_recommend_tfidf")
def q08_recommend_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _index(spark, sf_dir)
    r = recommend_tfidf(benchmark_submissions(spark, sf_dir), index, k=K)
    return r.select("query_id", "rank", "author", r6("score").alias("score"))


@query("q09_recommend_single")
def q09_recommend_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lists by block scoring, over every document of the corpus as a submission."""
    index = _index(spark, sf_dir)
    subs = documents_corpus(spark, sf_dir, min_token_len=2).select(
        F.col("doc_id").alias("query_id"), "processed_text")
    r = recommend_tfidf(subs, index, k=K, scoring="block")
    return r.select("query_id", "rank", "author", r6("score").alias("score"))


def _embedding_queries(spark, sf_dir):
    """Every paper vector submitted as a query (the paper is also in the corpus)."""
    return embedding_corpus(spark, sf_dir).select(F.col("paper_id").alias("query_id"), "embedding")


@query("q10_dense_cosine")
def q10_dense_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closest papers of every paper vector (itself included) with their cosine."""
    s = dense_top_papers(_embedding_queries(spark, sf_dir), embedding_corpus(spark, sf_dir), k=K)
    return s.select("query_id", "rank", "paper_id", "author", r6("score").alias("score"))


@query("q11_recommend_embedding")
def q11_recommend_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = embedding_corpus(spark, sf_dir)
    r = recommend_dense(_embedding_queries(spark, sf_dir), corpus, k=K)
    return r.select("query_id", "rank", "author", r6("score").alias("score"))


@query("q12_exclude_by_score")
def q12_exclude_by_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = embedding_corpus(spark, sf_dir)
    raw = recommend_dense(_embedding_queries(spark, sf_dir), corpus, k=K + OVERFETCH)
    return excluded_by_score(raw).select("query_id", "author")


@query("q16_author_profiles")
def q16_author_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = author_profiles(embedding_corpus(spark, sf_dir))
    return p.select("author", F.posexplode("profile").alias("dim", "value")).select(
        "author", "dim", r6("value").alias("value"))


@query("q17_author_similarity")
def q17_author_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the author matrix for a table of authors: those with more papers than the mean."""
    corpus = write_table(embedding_corpus(spark, sf_dir), "vectors")
    sizes = corpus.where(F.col("author").isNotNull()).groupBy("author").count()
    prolific = sizes.where(F.col("count") > sizes.agg(F.avg("count")).scalar()).select("author")
    s = similar_authors(author_profiles(corpus), k=2 * K, authors=prolific)
    return s.select("author", "rank", "similar_author", r6("similarity").alias("similarity"))


@query("q18_similar_authors")
def q18_similar_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = similar_authors(author_profiles(embedding_corpus(spark, sf_dir)), k=K)
    return s.select("author", "rank", "similar_author", r6("similarity").alias("similarity"))


def _named(spark, sf_dir):
    """Documents as submissions plus the author directory derived from them."""
    corpus = documents_corpus(spark, sf_dir)
    subs = corpus.select(F.col("doc_id").alias("query_id"), "raw_text")
    return subs, author_directory(corpus)


@query("q13_listed_authors")
def q13_listed_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    subs, directory = _named(spark, sf_dir)
    return listed_authors(subs, directory).select("query_id", "author")


@query("q14_listed_authors_blocked")
def q14_listed_authors_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of every key length (the whole name, its first 4 and its first 2 letters)."""
    subs, directory = _named(spark, sf_dir)
    short = [directory.select(F.concat_ws(":", "author", F.lit(n)).alias("author"),
                              F.substring("name", 1, n).alias("name")) for n in (2, 4, 100)]
    names = short[0].unionByName(short[1]).unionByName(short[2])
    return listed_authors(subs, names).select("query_id", "author")


class _Online:
    """The online flow on driver data: every document is submitted.

    TF-IDF scores against all documents; vector scores against the papers that have a
    vector (author = the paper's source), for the submissions that have one.
    """

    def __init__(self, spark, sf_dir, k=K, overfetch=OVERFETCH):
        # read by the index, the alignment, the submissions and the directory
        corpus = write_table(documents_corpus(spark, sf_dir), "corpus")
        self.corpus = corpus
        self.index = _index(spark, sf_dir)
        vecs = read_table(spark, sf_dir, "embeddings").select(
            "vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
        aligned = align_vectors(corpus.select("doc_id", "author"), vecs)
        papers = corpus.select(F.col("doc_id").alias("query_id"), "raw_text",
                               normalize_text("raw_text", min_token_len=2).alias("processed_text"))
        self.submitted = papers.join(vecs.withColumnRenamed("vec_id", "query_id"), "query_id", "left")
        self.subs = write_table(valid_submissions(self.submitted), "submitted")
        self.dense_corpus = aligned.select(F.col("doc_id").alias("paper_id"), "author", "embedding")
        self.k, self.fetch = k, k + overfetch

    def tfidf(self, k):
        return recommend_tfidf(self.subs, self.index, k=k, scoring="block")

    def dense(self, k):
        return recommend_dense(self.subs.select("query_id", "embedding"), self.dense_corpus, k=k)

    def exclusions(self):
        by_score = excluded_by_score(self.dense(self.fetch))
        by_name = listed_authors(self.subs, author_directory(self.corpus))
        return excluded_authors(by_score, by_name)


@query("q15_recommend_filtered")
def q15_recommend_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _Online(spark, sf_dir)
    r = recommend(o.subs, o.index, o.dense_corpus, author_directory(o.corpus), k=o.k,
                  overfetch=o.fetch - o.k, scoring="block")
    return r.select("query_id", "method", "rank", "author", r6("score").alias("score"))


@query("q19_align_vectors")
def q19_align_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = documents_corpus(spark, sf_dir).select("doc_id", "author")
    vecs = read_table(spark, sf_dir, "embeddings")
    a = align_vectors(corpus, vecs)
    return a.select(F.col("doc_id").alias("paper_id"), "author", "label",
                    F.size("embedding").alias("dim"))


def _comparison(o):
    c = compare_methods(o.tfidf(o.k), o.dense(o.k))
    return c.select("query_id", "rank", "tfidf_author", r6("tfidf_score").alias("tfidf_score"),
                    "embedding_author", r6("embedding_score").alias("embedding_score"))


@query("q20_compare_methods")
def q20_compare_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _Online(spark, sf_dir)
    truth = o.corpus.select(F.col("doc_id").alias("query_id"),
                            F.col("author").alias("actual_author"))
    return _comparison(o).join(truth, "query_id", "left")


@query("q21_evaluate_sample")
def q21_evaluate_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is in the sample, with the reason where a method has no list."""
    o = _Online(spark, sf_dir)
    sample = o.corpus.select(F.col("doc_id").alias("query_id"))
    ev = evaluate(sample, o.corpus, _comparison(o), submission_status(o.submitted))
    return ev.select("query_id", "status", "actual_author", "rank", "tfidf_author",
                     "tfidf_score", "embedding_author", "embedding_score")


@query("q29_listed_distinct_union")
def q29_listed_distinct_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _Online(spark, sf_dir).exclusions()


@query("q22_concat_pages")
def q22_concat_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = read_table(spark, sf_dir, "conversations")
    return concat_pages(conv, doc_col="conv_id", page_col="turn", text_col="text")


@query("q23_extract_fallback")
def q23_extract_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    ex = extract_text(pages, page_stages("html"))
    return ex.select("page_id", "extractor", "status", F.col("raw_text").alias("text"))


@query("q24_failed_documents")
def q24_failed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead letter of pages and of documents handed in as pages.

    Documents are plain text without any markup, so all three stages really fail on them.
    """
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    docs = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("page_id"), F.concat(F.lit("doc:"), "doc_id").alias("url"),
        F.col("text").alias("html"))
    ex = extract_text(pages.unionByName(docs), page_stages("html"))
    return failed_documents(ex, ["page_id", "url"])


def _saved_index(spark, sf_dir):
    corpus = documents_corpus(spark, sf_dir)
    vectors = embedding_corpus(spark, sf_dir)
    path = scratch_path(spark, "index")
    save_index(path, corpus, vectors, _index(spark, sf_dir))
    return load_index(spark, path)


@query("q25_parquet_roundtrip")
def q25_parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings written to Parquet with the whole index and read back."""
    p = _saved_index(spark, sf_dir).tfidf.postings
    return p.select("doc_id", "term", "tf", r6("weight").alias("weight"))


@query("q26_csv_roundtrip")
def q26_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = documents_corpus(spark, sf_dir).select(
        "author", F.format_string("doc_%d.pdf", "doc_id").alias("paper"), "processed_text")
    path = scratch_path(spark, "csv")
    if not export_csv(corpus, path):
        raise RuntimeError("CSV export failed")
    return read_csv(spark, path, "author string, paper string, processed_text string")


@query("q27_hash_encode")
def q27_hash_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hashed_counts(documents_corpus(spark, sf_dir), dim=64)
    return h.select("doc_id", "dim", r6("value").alias("value"))


@query("q28_stream_recommendations")
def q28_stream_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items streamed as arriving files, scored against the saved index."""
    index = _saved_index(spark, sf_dir).tfidf
    schema = read_table(spark, sf_dir, "benchmark").schema
    sink = scratch_path(spark, "stream-out")
    q = stream_recommendations(
        spark, f"{sf_dir.rstrip('/')}/bench[m]ark.parquet", schema, index, sink,
        scratch_path(spark, "stream-ckpt"), k=K, base_path=sf_dir)
    q.awaitTermination()
    out = spark.read.parquet(sink)
    return out.select("query_id", "rank", "author", r6("score").alias("score"))


@query("q30_text_to_recommendations")
def q30_text_to_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text to filtered lists: benchmark items are cleaned, encoded and recommended to.

    Papers and submissions are encoded by hashing; names are the corpus authors' own.
    """
    corpus = documents_corpus(spark, sf_dir, min_token_len=2)
    papers = hashing_vectors(corpus).join(corpus.select("doc_id", "author"), "doc_id") \
        .withColumnRenamed("doc_id", "paper_id")
    subs = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"),
                                                         F.col("text").alias("raw_text"))
    r = recommend(subs, _index(spark, sf_dir), papers, k=K,
                  encode=lambda t: hashing_vectors(t, id_col="query_id"))
    return r.select("query_id", "method", "rank", "author", r6("score").alias("score"))


@query("q31_author_list")
def q31_author_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors of the corpus without the placeholder (here the most frequent author)."""
    docs = documents_corpus(spark, sf_dir)
    sizes = docs.where(F.col("author").isNotNull()).groupBy("author").count()
    top = sizes.agg(F.max(F.struct("count", "author"))["author"]).first()[0]
    return author_list(docs, placeholder=top)


@query("q32_point_lookups")
def q32_point_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers by position and by path: the first and last position, the path in the middle."""
    docs = documents_corpus(spark, sf_dir).select(
        "doc_id", "author", F.format_string("doc_%d.pdf", "doc_id").alias("full_path"))
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    by_id = select_papers(docs, ids=[low, high])
    by_path = select_papers(docs, paths=[f"doc_{(low + high) // 2}.pdf"])
    return by_id.withColumn("found_by", F.lit("position")).unionByName(
        by_path.withColumn("found_by", F.lit("path")))


@query("q33_saved_vectors")
def q33_saved_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of the saved index, read back."""
    v = _saved_index(spark, sf_dir).vectors
    return v.select("paper_id", F.posexplode("embedding").alias("dim", "x")).select(
        "paper_id", "dim", F.round(F.col("x").cast("double"), 6).alias("value"))


@query("q34_bounded_papers")
def q34_bounded_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closest documents of every submission from the score-bounded index (the lists of q07)."""
    index = _index(spark, sf_dir)
    q = transform_tfidf(benchmark_submissions(spark, sf_dir), index)
    return bounded_papers(q, index, K).select("query_id", "rank", "doc_id", "author", r6("score").alias("score"))


@query("q35_bounded_authors")
def q35_bounded_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The authors of q08 from the score-bounded index."""
    r = recommend_tfidf(benchmark_submissions(spark, sf_dir), _index(spark, sf_dir), k=K, scoring="bounded")
    return r.select("query_id", "rank", "author", r6("score").alias("score"))


# small blocks, so that tables of any size are searched around pivots
_PIVOTED = Limits(block_rows=256, whole_blocks=0)


@query("q36_pivoted_papers")
def q36_pivoted_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closest papers of every paper vector (q10) without the block pairs that pivots rule out."""
    s = dense_top_papers(_embedding_queries(spark, sf_dir), embedding_corpus(spark, sf_dir), k=K, limits=_PIVOTED)
    return s.select("query_id", "rank", "paper_id", "author", r6("score").alias("score"))


@query("q37_pivoted_authors")
def q37_pivoted_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar authors (q18) found around pivots."""
    s = similar_authors(author_profiles(embedding_corpus(spark, sf_dir)), k=K, limits=_PIVOTED)
    return s.select("author", "rank", "similar_author", r6("similarity").alias("similarity"))


_LSA_MODELS: dict[int, object] = {}


def _lsa(spark, sf_dir, dim=64):
    """The encoder of the session's index, fitted once."""
    index = _index(spark, sf_dir)
    key = id(index)
    if key not in _LSA_MODELS:
        _LSA_MODELS[key] = fit_lsa(index, dim=dim)
    return _LSA_MODELS[key]


@query("q38_lsa_vectors")
def q38_lsa_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learnt vectors of all documents: unit length for every document with a known term."""
    v = corpus_vectors(_lsa(spark, sf_dir))
    squares = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x * x)
    return v.select(F.col("paper_id").alias("doc_id"), "author", F.size("embedding").alias("dim"),
                    r6(F.sqrt(squares)).alias("norm"))
