"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peerscope.llm.ann_graph import nearest_neighbours, valid_vectors
from peerscope.llm.bm25_search import bm25_top_k
from peerscope.llm.bpe import bpe_encode
from peerscope.llm.centroids import centroid_clusters, integer_vectors
from peerscope.llm.collocations import collocations
from peerscope.llm.common import held_out, table
from peerscope.llm.html_text import extract_main_text
from peerscope.llm.language_id import fit_language, predict_language
from peerscope.llm.line_dedup import dedup_lines
from peerscope.llm.mixing import mix_sources
from peerscope.llm.ngram_join import ngram_components
from peerscope.llm.token_counts import token_counts
from peerscope.llm.token_store import read_tokens, token_checksums, write_tokens
from peerscope.llm.toxicity import THRESHOLD, fit_toxicity, score_toxicity
from peerscope.session import scratch_path


def tokenizer_file(name: str) -> str:
    """A public tokenizer file of this machine (the same place on every executor)."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (mix_sources(table(spark, sf_dir, "documents"))
            .select("doc_id", "size", "source_size", "target", "taken", "source", "copies"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (dedup_lines(table(spark, sf_dir, "documents"))
            .select("doc_id", "n_lines", "n_dropped",
                    F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = valid_vectors(table(spark, sf_dir, "embeddings"))
    return nearest_neighbours(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return (score_toxicity(docs, model)
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))


def op6_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    queries = docs.where(F.col("doc_id") % 100 == 0).withColumnRenamed("doc_id", "query_id")
    return bm25_top_k(docs, queries).withColumn("score", F.round("score", 6))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens-orc")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_file("byte_bpe_50k.json"))
    return token_checksums(read_tokens(spark, path))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe_encode(docs, tokenizer_file("word_bpe_49k.json"))
    return coded.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    predicted = predict_language(docs.select("doc_id", "text"), fit_language(docs))
    return predicted.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text",
                                           F.char_length("text").cast("long").alias("n_chars"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, tokenizer_file("piece_bpe_32k.model"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return centroid_clusters(vectors).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia",
                                             "centroid_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_line_dedup": op2_line_dedup,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_toxicity": op4_toxicity,
    "op5_token_store": op5_token_store,
    "op6_bm25_top_k": op6_bm25_top_k,
    "op7_ngram_join": op7_ngram_join,
    "op8_bpe": op8_bpe,
    "op9_language_id": op9_language_id,
    "op10_html_text": op10_html_text,
    "op11_collocations": op11_collocations,
    "op12_token_counts": op12_token_counts,
    "op13_centroids": op13_centroids,
}

_LINE_DEDUP_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
heavy AS (
  SELECT k, max(doc_id) AS holder FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT keyed.doc_id, pos, line, heavy.k IS NOT NULL AND keyed.doc_id <> holder AS gone
  FROM keyed LEFT JOIN heavy ON keyed.k = heavy.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_BM25_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(string_split_regex(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+')) AS term
  FROM documents WHERE text IS NOT NULL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term <> '' GROUP BY doc_id, term),
len AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY doc_id),
size AS (SELECT count(*) AS n, avg(len) AS average FROM len),
idf AS (SELECT term, ln(1 + ((SELECT n FROM size) - count(*) + 0.5) / (count(*) + 0.5)) AS idf
        FROM tf GROUP BY term),
weight AS (
  SELECT tf.doc_id, tf.term,
         idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (SELECT average FROM size))) AS w
  FROM tf JOIN len ON tf.doc_id = len.doc_id JOIN idf ON tf.term = idf.term),
scored AS (
  SELECT q.doc_id AS query_id, d.doc_id, round(sum(d.w), 9) AS score
  FROM tf q JOIN weight d ON q.term = d.term
  WHERE q.doc_id % 100 = 0 AND q.doc_id <> d.doc_id
  GROUP BY q.doc_id, d.doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored)
SELECT query_id, rank, doc_id, round(score, 6) AS score FROM ranked WHERE rank <= 10
"""

_COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM starts, range(1, 6) AS r(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, phrase, k, count(*) AS f FROM grams GROUP BY lang, phrase, k),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, phrase, k, f AS a FROM f WHERE k >= 2 AND f >= 100),
kept AS (
  SELECT * FROM candidates c WHERE NOT EXISTS (
    SELECT 1 FROM candidates d WHERE d.lang = c.lang AND d.k > c.k AND 100 * d.a >= 100 * c.a
      AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (
  SELECT lang, phrase, a, j, array_to_string(string_split(phrase, ' ')[1:j], ' ') AS head,
         array_to_string(string_split(phrase, ' ')[j + 1:], ' ') AS rest
  FROM kept, range(1, 5) AS r(j) WHERE j < k),
scored AS (
  SELECT c.lang, c.phrase, c.a, h.f AS l, t.f AS r, n.n,
         ((1000::HUGEINT * c.a * n.n) // (h.f::HUGEINT * t.f))::BIGINT AS score, j
  FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head
  JOIN f t ON t.lang = c.lang AND t.phrase = c.rest JOIN n ON n.lang = c.lang),
weakest AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS first FROM scored),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM weakest WHERE first = 1)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


def _centroids_sql(clusters: int = 40, rounds: int = 5, seed: int = 2, components: int = 64) -> str:
    """Lloyd rounds one after the other; equal distances go to the smaller number."""
    steps = [f"""
kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {components}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {components}),
parts AS MATERIALIZED (SELECT vec_id, unnest(v) AS x, unnest(range({components})) AS i FROM kept),
first AS (
  SELECT vec_id, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c
  FROM kept QUALIFY c < {clusters}),
cent0 AS MATERIALIZED (SELECT c, i, x FROM parts JOIN first USING (vec_id))"""]
    for r in range(rounds + 1):
        steps.append(f"""
dist{r} AS (
  SELECT p.vec_id, t.c, sum((p.x - t.x) * (p.x - t.x))::BIGINT AS d
  FROM parts p JOIN cent{r} t ON p.i = t.i GROUP BY p.vec_id, t.c),
near{r} AS MATERIALIZED (
  SELECT vec_id, c, d FROM dist{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)""")
        if r < rounds:
            steps.append(f"""
sums{r} AS (
  SELECT a.c, p.i, sum(p.x)::BIGINT AS s, count(*) AS n
  FROM near{r} a JOIN parts p ON p.vec_id = a.vec_id GROUP BY a.c, p.i),
cent{r + 1} AS MATERIALIZED (
  SELECT t.c, t.i, coalesce((s - ((s % n) + n) % n) // n, t.x) AS x
  FROM cent{r} t LEFT JOIN sums{r} s ON s.c = t.c AND s.i = t.i)""")
    steps.append(f"""
hashes AS (
  SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM cent{rounds} GROUP BY c)
SELECT vec_id, near{rounds}.c::INT AS cluster, d AS distance,
       (sum(d) OVER (PARTITION BY near{rounds}.c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM near{rounds} JOIN hashes ON hashes.c = near{rounds}.c""")
    return "WITH" + ",".join(steps)


ORACLE: dict[str, str] = {
    "op2_line_dedup": _LINE_DEDUP_SQL,
    "op6_bm25_top_k": _BM25_SQL,
    "op11_collocations": _COLLOCATIONS_SQL,
    "op13_centroids": _centroids_sql(),
}
