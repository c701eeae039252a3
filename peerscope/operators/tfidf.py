"""Sparse TF-IDF index as relational tables.

* ``term_counts``  (doc_id, author, term, tf) -- 1- and 2-grams per document
* ``fit_tfidf``    vocabulary (term, df, idf) and postings
                   (doc_id, author, term, tf, weight) with L2-unit rows, kept
                   as one row of arrays per document
* ``transform_tfidf`` the same weighting for unseen texts on the fitted vocabulary
* ``sparse_cosine``  inverted-index join: only pairs sharing a term are formed

Weights follow the smoothed scheme: idf = ln((1 + n) / (1 + df)) + 1,
w = tf * idf / ||tf * idf||_2; terms are kept when min_df <= df <= max_df
(an int bound is a count, a float bound a fraction of n).
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import functions as F

from peerscope.operators.sizing import DEFAULT_LIMITS, Limits, broadcast_if
from peerscope.session import write_table

_ROWS_OUT = 200_000     # rows of counts sent on at once


@dataclass
class TfidfIndex:
    vocab: DataFrame       # term, term_id, df, idf
    postings: DataFrame    # doc_id, author, term, term_id, tf, weight
    docs: DataFrame        # doc_id, author
    n_docs: int
    vocab_size: int
    # per-document vectors, materialised on first use by the block scorer
    cache: dict = field(default_factory=dict, repr=False)


def entries(index: TfidfIndex) -> DataFrame:
    """(doc_id, author, term_id, weight): the postings without the terms themselves."""
    return index.cache.get("entries", index.postings)


def _grams(text: str | None, ngram_max: int) -> list[str]:
    """The 1/2-grams of a processed text: words of two letters or more, and neighbours joined by a space."""
    words = [w for w in (text or "").split(" ") if len(w) >= 2]
    return words if ngram_max == 1 else words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def _check_ngrams(ngram_max: int) -> None:
    if ngram_max not in (1, 2):
        raise ValueError("ngram_max must be 1 or 2")


def term_counts(corpus: DataFrame, id_col: str = "doc_id", author_col: str | None = "author",
                text_col: str = "processed_text", ngram_max: int = 2) -> DataFrame:
    """Raw count of every 1/2-gram per document: (doc_id[, author], term, tf).

    Counted inside the document's row. No shuffle is needed, and all rows of
    a document stay in the partition of its input row.
    """
    _check_ngrams(ngram_max)
    keys = [id_col] + ([author_col] if author_col else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, terms, tfs = [], [], []
            for i, text in enumerate(batch.column(len(keys))):
                counts = Counter(_grams(text.as_py(), ngram_max))
                at += [i] * len(counts)
                terms += counts
                tfs += counts.values()
                if len(at) >= _ROWS_OUT or i == batch.num_rows - 1:
                    rows = pa.array(at, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [*(c.take(rows) for c in batch.columns[:len(keys)]), pa.array(terms, pa.string()),
                         pa.array(tfs, pa.int64())], names=[*keys, "term", "tf"])
                    at, terms, tfs = [], [], []

    types = {f.name: f.dataType.simpleString() for f in corpus.schema.fields}
    return corpus.select(*keys, text_col).mapInArrow(
        run, ", ".join([*(f"`{c}` {types[c]}" for c in keys), "term string", "tf long"]))


def _doc_bounds(n_docs: int, min_df: float, max_df: float) -> tuple[float, float]:
    low = float(min_df) if isinstance(min_df, int) else float(min_df) * n_docs
    high = float(max_df) if isinstance(max_df, int) else float(max_df) * n_docs
    if high < low:
        raise ValueError("max_df corresponds to fewer documents than min_df")
    return low, high


def vocabulary(counts: DataFrame, n_docs: int, min_df: float = 5, max_df: float = 0.8) -> DataFrame:
    """(term, df, idf) for the terms inside the document-frequency bounds."""
    low, high = _doc_bounds(n_docs, min_df, max_df)
    df = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return (df.where((F.col("df") >= F.lit(low)) & (F.col("df") <= F.lit(high)))
              .withColumn("idf", F.log((F.lit(1.0) + n_docs) / (F.col("df") + 1.0)) + 1.0))


def _weighted(counts: DataFrame, vocab: DataFrame, vocab_size: int, id_col: str,
              limits: Limits) -> tuple[DataFrame, DataFrame]:
    """Join counts with the vocabulary; return the weighted rows and per-document L2 norms."""
    v = vocab.select("term", "term_id", "idf")
    rows = counts.count()
    if rows < vocab_size:
        raw = v.join(broadcast_if(counts, rows, limits.vocab_broadcast_rows), "term")
    else:
        raw = counts.join(broadcast_if(v, vocab_size, limits.vocab_broadcast_rows), "term")
    raw = raw.withColumn("w", F.col("tf") * F.col("idf"))
    # one partial sum per document inside its partition, then a small exchange
    norms = raw.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw, norms


def _local_terms(n_buckets: int, ngram_max: int):
    """The distinct terms of a chunk of documents with their document frequencies, one row per bucket of terms."""
    def run(chunk: pa.Table) -> pa.Table:
        df = Counter()
        for text in chunk.column(3).to_pylist():
            df.update(set(_grams(text, ngram_max)))
        buckets: dict[int, list[str]] = {}
        for term in sorted(df):
            buckets.setdefault(zlib.crc32(term.encode()) % n_buckets, []).append(term)
        number = chunk.column(0)[0].as_py()
        return pa.table({"bucket": pa.array(list(buckets), pa.int32()), "chunk": pa.array([number] * len(buckets), pa.int32()),
                         "terms": pa.array([_pack(t) for t in buckets.values()], pa.binary()),
                         "dfs": pa.array([[df[t] for t in terms] for terms in buckets.values()], pa.list_(pa.int64()))})
    return run


def _pack(terms: list[str]) -> bytes:
    """Sorted terms, which hold no line end, as one compressed value."""
    return zlib.compress("\n".join(terms).encode(), 1)


def _unpack(packed: bytes) -> list[str]:
    return zlib.decompress(packed).decode().split("\n")


def _number_terms(n_buckets: int, low: float, high: float):
    """The kept terms of a bucket (chunk NULL), and for every chunk those it has, with numbers and frequencies."""
    def run(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        chunks = [pa.array(_unpack(t), pa.string()) for t in rows.column("terms").to_pylist()]
        coded = pa.concat_arrays(chunks).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        flat = pa.concat_arrays([c.flatten() for c in rows.column("dfs").chunks])
        df = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(df, codes, flat.to_numpy(zero_copy_only=False))
        kept = (df >= low) & (df <= high)
        # a term's number tells its bucket, so that numbers of different buckets differ
        number = (np.cumsum(kept) - 1) * n_buckets + bucket
        out = [(None, coded.dictionary.filter(pa.array(kept)).to_pylist(), number[kept], df[kept])]
        ends = np.cumsum([len(c) for c in chunks])
        for chunk, terms, hi in zip(rows.column("chunk").to_pylist(), chunks, ends):
            mine = codes[hi - len(terms):hi]
            known = kept[mine]
            if known.any():
                out.append((chunk, terms.filter(pa.array(known)).to_pylist(), number[mine[known]], df[mine[known]]))
        return pa.table({"chunk": pa.array([o[0] for o in out], pa.int32()),
                         "words": pa.array([o[1] if o[0] is None else None for o in out], pa.list_(pa.string())),
                         "terms": pa.array([None if o[0] is None else _pack(o[1]) for o in out], pa.binary()),
                         "term_ids": pa.array([o[2] for o in out], pa.list_(pa.int64())),
                         "dfs": pa.array([o[3] for o in out], pa.list_(pa.int64()))})
    return run


def _document_rows(n_docs: int, ngram_max: int, names: list[str], spelt: bool = True):
    """One row per (document, author) of a chunk: its known terms in order, their counts, and the document's norm.

    ``spelt``: with the terms themselves beside their numbers.
    """
    def run(chunk: pa.Table, known: pa.Table) -> pa.Table:
        words = [t for packed in known.column("terms").to_pylist() for t in _unpack(packed)]
        numbers, dfs = (np.concatenate([np.zeros(0, np.int64), *(x.values.to_numpy(zero_copy_only=False) for x in known.column(c))])
                        for c in ("term_ids", "dfs"))
        order = sorted(range(len(words)), key=words.__getitem__)
        at = {words[i]: place for place, i in enumerate(order)}
        numbers, dfs = numbers[order], dfs[order]
        idf = np.log((1.0 + n_docs) / (dfs + 1.0)) + 1.0
        first, found = {}, {}
        for i, (doc, author, text) in enumerate(zip(*(chunk.column(c).to_pylist() for c in (1, 2, 3)))):
            rows = sorted((at[t], n) for t, n in Counter(_grams(text, ngram_max)).items() if t in at)
            if rows and doc is not None:
                first.setdefault((doc, author), i)
                found.setdefault((doc, author), []).extend(rows)
        flat = [row for rows in found.values() for row in rows]
        places, tfs = (np.array([r[c] for r in flat], np.int64) for c in (0, 1))
        lengths = np.array([len(rows) for rows in found.values()], np.int64)
        offsets = pa.array(np.append(0, np.cumsum(lengths)), pa.int32())
        # the norm is the document's, whatever number of rows it has
        docs = {doc: n for n, doc in enumerate(dict.fromkeys(doc for doc, _ in found))}
        of_row = np.array([docs[doc] for doc, _ in found], np.int64)
        squares = np.bincount(np.repeat(of_row, lengths), (tfs * idf[places]) ** 2, len(docs))
        terms = [pa.array([words[i] for i in order], pa.string()).take(pa.array(places))] if spelt else []
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (
            *terms, pa.array(numbers[places], pa.int64()), pa.array(tfs, pa.int64()), pa.array(dfs[places], pa.int64()))]
        rows = pa.array(list(first.values()), pa.int64())
        return pa.table([chunk.column(1).take(rows), chunk.column(2).take(rows), *lists, pa.array(np.sqrt(squares)[of_row], pa.float64())],
                        names=[*names, *["terms"] * spelt, "term_ids", "tfs", "dfs", "norm"])
    return run


def _known_terms(local: pa.Table, vocab: pa.Table) -> pa.Table:
    """Of the terms that chunks have in a bucket those of the vocabulary, with their numbers and frequencies."""
    chunks = [pa.array(_unpack(t), pa.string()) for t in local.column("terms").to_pylist()]
    place = pc.index_in(pa.chunked_array(chunks, pa.string()), value_set=vocab.column("term").combine_chunks())
    known, place = place.is_valid().to_numpy(), place.fill_null(0).to_numpy()
    number, df = (vocab.column(c).to_numpy() for c in ("term_id", "df"))
    out, at = [], 0
    for chunk, terms in zip(local.column("chunk").to_pylist(), chunks):
        mine, at = slice(at, at + len(terms)), at + len(terms)
        if known[mine].any():
            of = place[mine][known[mine]]
            out.append((chunk, _pack(terms.filter(pa.array(known[mine])).to_pylist()), number[of], df[of]))
    return pa.table({"chunk": pa.array([o[0] for o in out], pa.int32()), "terms": pa.array([o[1] for o in out], pa.binary()),
                     "term_ids": pa.array([o[2] for o in out], pa.list_(pa.int64())),
                     "dfs": pa.array([o[3] for o in out], pa.list_(pa.int64()))})


def _weight(tf: Column, df: Column, norm: Column, n_docs: int) -> Column:
    return tf * (F.log((F.lit(1.0) + n_docs) / (df + 1.0)) + 1.0) / norm


def weighted_rows(rows: DataFrame, n_docs: int, id_col: str = "doc_id", author_col: str = "author") -> DataFrame:
    """(id, author, terms, weights) of document rows (id, author, terms, tfs, dfs, norm)."""
    weights = F.zip_with("tfs", "dfs", lambda tf, df: _weight(tf, df, F.col("norm"), n_docs))
    return rows.select(id_col, author_col, "terms", weights.alias("weights"))


def fit_tfidf(corpus: DataFrame, min_df: float = 5, max_df: float = 0.8, ngram_max: int = 2,
              id_col: str = "doc_id", author_col: str = "author", text_col: str = "processed_text",
              limits: Limits = DEFAULT_LIMITS) -> TfidfIndex:
    """Fit vocabulary and idf on ``corpus`` and weight its documents.

    ``n`` counts every corpus row, including texts left empty by cleaning.
    Raises ``ValueError`` when no term survives the bounds.

    Documents lie in chunks of bounded text. Only the distinct terms of a
    chunk travel, not those of every document: by bucket of terms, where they
    are counted and numbered, and back to the chunk, where the documents are
    weighted. The index is one row of arrays per document; ``postings`` reads
    it row by row.
    """
    _check_ngrams(ngram_max)
    base = write_table(corpus.select(id_col, author_col, text_col), "texts", codec="zstd")
    n_docs, chars = base.agg(F.count(F.lit(1)), F.sum(F.octet_length(text_col))).first()
    if n_docs == 0:
        raise ValueError("empty corpus")
    low, high = _doc_bounds(n_docs, min_df, max_df)
    cores = base.sparkSession.sparkContext.defaultParallelism
    chunks = max(min(cores, n_docs), math.ceil((chars or 0) / limits.chunk_bytes))
    buckets = max(min(cores, n_docs), math.ceil(chunks / 2))
    # rows of one document together; those without an id are counted but have no postings
    spread = F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(F.xxhash64(id_col))
    dealt = base.select(F.pmod(spread, F.lit(chunks)).cast("int").alias("_chunk"), id_col, author_col, text_col)
    local = dealt.groupBy("_chunk").applyInArrow(
        _local_terms(buckets, ngram_max), "bucket int, chunk int, terms binary, dfs array<long>")
    numbered = write_table(local.groupBy("bucket").applyInArrow(
        _number_terms(buckets, low, high),
        "chunk int, words array<string>, terms binary, term_ids array<long>, dfs array<long>"), "numbered-terms", codec="zstd")
    idf = F.log((F.lit(1.0) + n_docs) / (F.col("df") + 1.0)) + 1.0
    vocab = write_table(
        numbered.where(F.col("chunk").isNull()).select(F.inline(F.arrays_zip("words", "dfs", "term_ids")))
        .select(F.col("words").alias("term"), F.col("dfs").alias("df"), "term_ids")
        .select("term", "df", idf.alias("idf"), F.col("term_ids").alias("term_id")), "vocabulary")
    vocab_size = vocab.count()
    if vocab_size == 0:
        raise ValueError("After pruning, no terms remain. Try a lower min_df or a higher max_df.")
    types = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    known = numbered.where(F.col("chunk").isNotNull()).select(F.col("chunk").alias("_chunk"), "terms", "term_ids", "dfs")
    rows = dealt.groupBy("_chunk").cogroup(known.groupBy("_chunk")).applyInArrow(
        _document_rows(n_docs, ngram_max, [id_col, author_col]),
        f"`{id_col}` {types[id_col]}, `{author_col}` {types[author_col]}, terms array<string>, term_ids array<long>, "
        "tfs array<long>, dfs array<long>, norm double")
    # weighted once; every use of the index reads the written rows
    rows = write_table(rows, "documents", codec="zstd")
    n = n_docs
    counts = rows.select(id_col, author_col, F.col("term_ids").alias("terms"), "tfs", "dfs", "norm")
    vectors = weighted_rows(counts, n, id_col, author_col)
    postings = rows.select(id_col, author_col, "norm", F.inline(F.arrays_zip("terms", "term_ids", "tfs", "dfs"))).select(
        id_col, author_col, F.col("terms").alias("term"), F.col("term_ids").alias("term_id"), F.col("tfs").alias("tf"),
        _weight(F.col("tfs"), F.col("dfs"), F.col("norm"), n).alias("weight"))
    # (doc_id, author, term_id, weight) without the terms themselves
    entries = rows.select(id_col, author_col, "norm", F.inline(F.arrays_zip("term_ids", "tfs", "dfs"))).select(
        id_col, author_col, F.col("term_ids").alias("term_id"),
        _weight(F.col("tfs"), F.col("dfs"), F.col("norm"), n).alias("weight"))
    return TfidfIndex(vocab=vocab, postings=postings, docs=base.select(id_col, author_col), n_docs=n_docs, vocab_size=vocab_size,
                      cache={("document_vectors", id_col, author_col): vectors, ("document_counts", id_col, author_col): counts,
                             "entries": entries})


def transform_tfidf(texts: DataFrame, index: TfidfIndex, id_col: str = "query_id",
                    text_col: str = "processed_text", ngram_max: int = 2,
                    limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Weight unseen texts on the fitted vocabulary: (query_id, term, term_id, tf, weight).

    Out-of-vocabulary terms are dropped; a text with no known term has no
    rows (its vector is zero and every cosine with it is 0).
    """
    counts = write_table(term_counts(texts.select(id_col, text_col), id_col, None, text_col, ngram_max), "query-terms")
    raw, norms = _weighted(counts, index.vocab, index.vocab_size, id_col, limits)
    return (raw.join(norms, id_col)
               .select(id_col, "term", "term_id", "tf",
                       (F.col("w") / F.col("norm")).alias("weight")))


def transform_chunks(texts: DataFrame, index: TfidfIndex, id_col: str = "query_id", text_col: str = "processed_text",
                     ngram_max: int = 2, limits: Limits = DEFAULT_LIMITS) -> tuple[GroupedData, GroupedData, Callable]:
    """``transform_tfidf`` for whole corpora: two grouped tables to be cogrouped, and the function that weights a chunk.

    Texts lie in chunks, as the documents of ``fit_tfidf`` do: the distinct terms of
    a chunk meet the vocabulary by bucket of terms and come back with their
    numbers. The function gives (id, _author, term_ids, tfs, dfs, norm), one row per
    id with a known term. ``texts`` is read three times and should be a written table.
    """
    _check_ngrams(ngram_max)
    rows, chars = texts.agg(F.count(F.lit(1)), F.sum(F.octet_length(text_col))).first()
    cores = texts.sparkSession.sparkContext.defaultParallelism
    chunks = max(1, min(cores, rows), math.ceil((chars or 0) / limits.chunk_bytes))
    dealt = texts.select(F.pmod(F.xxhash64(id_col), F.lit(chunks)).cast("int").alias("_chunk"), id_col,
                         F.lit(None).cast("string").alias("_author"), text_col).where(F.col(id_col).isNotNull())
    local = dealt.groupBy("_chunk").applyInArrow(
        _local_terms(chunks, ngram_max), "bucket int, chunk int, terms binary, dfs array<long>").drop("dfs")
    vocab = index.vocab.select("term", "term_id", "df", F.pmod(F.crc32("term"), F.lit(chunks)).cast("int").alias("bucket"))
    known = local.groupBy("bucket").cogroup(vocab.groupBy("bucket")).applyInArrow(
        _known_terms, "chunk int, terms binary, term_ids array<long>, dfs array<long>")
    return (dealt.groupBy("_chunk"), known.withColumnRenamed("chunk", "_chunk").groupBy("_chunk"),
            _document_rows(index.n_docs, ngram_max, [id_col, "_author"], spelt=False))


def sparse_cosine(query_vectors: DataFrame, index: TfidfIndex, query_col: str = "query_id",
                  id_col: str = "doc_id", author_col: str = "author",
                  limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """Cosine of unit vectors through the inverted index.

    Returns (query_id, doc_id, author, score) for the pairs that share at
    least one term; every other pair scores 0 and is not formed. One equi-join
    on the term: few queries are broadcast, so that the postings stay where
    they are; otherwise Spark splits the partitions of a term that very many
    documents share (AQE skew join).
    """
    q = write_table(query_vectors.select(query_col, "term_id", F.col("weight").alias("wq")), "query-weights")
    q = broadcast_if(q, q.count(), limits.vocab_broadcast_rows)
    products = entries(index).select(id_col, author_col, "term_id", "weight").join(q, "term_id").select(
        query_col, id_col, author_col, (F.col("wq") * F.col("weight")).alias("p"))
    return products.groupBy(query_col, id_col, author_col).agg(F.sum("p").alias("score"))
