"""Independent DuckDB SQL for every registered query.

The same formulas as the Spark operators, written as plain SQL over the
driver tables (``documents``, ``benchmark``, ``embeddings``, ...). Only the
fixed values (stop words, contractions) are shared with the library.
"""

from __future__ import annotations

from peerscope.functions.text import CONTRACTIONS, STOP_WORDS

# Python's whitespace as an RE2 class body
_WS = r"\t\n\v\f\r \x{1c}-\x{1f}\x{85}\p{Z}"
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_NON_BLANK = rf"[^{_WS}]"

K = 5
OVERFETCH = 5
EXCLUDE_AT = 0.98
PREFIX = 2000


def tokens_sql(expr: str, min_len: int = 1) -> str:
    t = f"regexp_replace(lower(coalesce({expr}, '')), '[^a-zA-Z{_WS}]', '', 'g')"
    for word, left, right in CONTRACTIONS:
        t = rf"regexp_replace({t}, '\b{word}\b', '{left} {right}', 'g')"
    return (f"list_filter(string_split_regex({t}, '[{_WS}]+'), "
            f"lambda x: length(x) >= {max(min_len, 1)} AND x NOT IN ({_STOP}))")


def norm_sql(expr: str, min_len: int = 1) -> str:
    return f"array_to_string({tokens_sql(expr, min_len)}, ' ')"


def corpus_cte() -> str:
    return f"""corpus AS (
  SELECT doc_id, source AS author, text AS raw_text, {norm_sql('text', 1)} AS processed_text
  FROM documents WHERE text IS NOT NULL AND text <> '')"""


def grams_cte(name: str, src: str, key: str, extra: str = "") -> str:
    """(key[, extra], term, tf) for the 1/2-grams of ``processed_text`` of ``src``."""
    cols = f"{key}{', ' + extra if extra else ''}"
    return f"""{name}_w AS (
  SELECT {cols}, list_filter(string_split(processed_text, ' '), lambda x: length(x) >= 2) AS w
  FROM {src}),
{name}_g AS (
  SELECT {cols}, unnest(list_concat(w, list_transform(range(1, len(w)),
         lambda i: w[i] || ' ' || w[i + 1]))) AS term
  FROM {name}_w),
{name} AS (SELECT {cols}, term, count(*) AS tf FROM {name}_g GROUP BY ALL)"""


def index_ctes(min_df: int = 5, max_df: float = 0.8) -> str:
    return f"""{corpus_cte()},
{grams_cte('tc', 'corpus', 'doc_id', 'author')},
ndocs AS (SELECT count(*)::DOUBLE AS n FROM corpus),
dfs AS (SELECT term, count(*) AS df FROM tc GROUP BY term),
vocab AS (
  SELECT term, df, ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf
  FROM dfs, ndocs WHERE df >= {min_df} AND df <= {max_df} * n),
raw AS (SELECT doc_id, author, term, tf, tf * idf AS w FROM tc JOIN vocab USING (term)),
postings AS (
  SELECT doc_id, author, term, tf, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight
  FROM raw)"""


def query_vector_ctes(src: str = "subs") -> str:
    """Weighted, unit-length query vectors ``qvec`` for the texts of ``src``."""
    return f"""{grams_cte('qtc', src, 'query_id')},
qraw AS (SELECT query_id, term, tf, tf * idf AS w FROM qtc JOIN vocab USING (term)),
qvec AS (
  SELECT query_id, term, tf, w / sqrt(sum(w * w) OVER (PARTITION BY query_id)) AS weight
  FROM qraw),
pairs AS (
  SELECT query_id, doc_id, author, sum(q.weight * p.weight) AS score
  FROM qvec q JOIN postings p USING (term) GROUP BY ALL)"""


def subs_cte() -> str:
    return f"""subs AS (
  SELECT item_id AS query_id, text AS raw_text, {norm_sql('text', 2)} AS processed_text
  FROM benchmark)"""


def padded_tfidf_ranking(qids: str, k: int, name: str = "tfidf_ranked") -> str:
    """Every (query, author) scored, missing pairs at 0.0, ranked; rank <= k kept."""
    return f"""{name}_best AS (SELECT query_id, author, max(score) AS score FROM pairs GROUP BY ALL),
{name}_all AS (
  SELECT q.query_id, a.author, coalesce(b.score, 0.0) AS score
  FROM {qids} q CROSS JOIN (SELECT DISTINCT author FROM corpus WHERE author IS NOT NULL) a
  LEFT JOIN {name}_best b ON b.query_id = q.query_id AND b.author = a.author),
{name} AS (
  SELECT query_id, author, score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, author) AS rank
  FROM {name}_all QUALIFY rank <= {k})"""


ORACLE: dict[str, str] = {}


def oracle(name: str):
    def deco(fn):
        ORACLE[name] = fn()
        return fn
    return deco


@oracle("q01_corpus_summary")
def _q01():
    return f"""
WITH d AS (
  SELECT source AS author, n_chars, text IS NOT NULL AND text <> '' AS ok,
         {norm_sql('text', 1)} AS processed_text
  FROM documents)
SELECT author,
       count_if(ok) AS n_papers,
       count_if(NOT ok) AS n_failed,
       count_if(ok AND processed_text = '') AS n_empty_processed,
       CAST(sum(CASE WHEN ok THEN n_chars END) AS BIGINT) AS total_chars
FROM d GROUP BY author"""


@oracle("q02_normalize_text")
def _q02():
    return f"""
SELECT doc_id, {norm_sql('text', 1)} AS processed_text, {norm_sql('text', 2)} AS query_text
FROM documents WHERE text IS NOT NULL AND text <> ''"""


@oracle("q03_term_counts")
def _q03():
    return f"""
WITH {corpus_cte()},
{grams_cte('tc', 'corpus', 'doc_id')}
SELECT doc_id, term, tf FROM tc"""


@oracle("q04_vocabulary")
def _q04():
    return f"""
WITH {index_ctes()}
SELECT term, df, round(idf, 6) AS idf FROM vocab"""


@oracle("q04b_vocabulary_max_df")
def _q04b():
    return f"""
WITH {index_ctes(5, 0.25)}
SELECT term, df, round(idf, 6) AS idf FROM vocab"""


@oracle("q05_tfidf_weights")
def _q05():
    return f"""
WITH {index_ctes()}
SELECT doc_id, term, tf, round(weight, 6) AS weight FROM postings"""


@oracle("q06_transform_queries")
def _q06():
    return f"""
WITH {index_ctes()},
{subs_cte()},
{query_vector_ctes()}
SELECT query_id, term, tf, round(weight, 6) AS weight FROM qvec"""


@oracle("q07_sparse_cosine")
def _q07():
    return f"""
WITH {index_ctes()},
{subs_cte()},
{query_vector_ctes()},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank
  FROM pairs QUALIFY rank <= {K})
SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, author, round(score, 6) AS score FROM ranked"""


@oracle("q08_recommend_tfidf")
def _q08():
    return f"""
WITH {index_ctes()},
{subs_cte()},
{query_vector_ctes()},
qids AS (SELECT query_id FROM subs WHERE processed_text <> ''),
{padded_tfidf_ranking('qids', K)}
SELECT query_id, CAST(rank AS INTEGER) AS rank, author, round(score, 6) AS score
FROM tfidf_ranked"""


@oracle("q09_recommend_single")
def _q09():
    return f"""
WITH {index_ctes()},
subs0 AS (
  SELECT doc_id AS query_id, raw_text, {norm_sql('raw_text', 2)} AS processed_text FROM corpus),
{query_vector_ctes('subs0')},
qids AS (SELECT query_id FROM subs0 WHERE processed_text <> ''),
{padded_tfidf_ranking('qids', K)}
SELECT query_id, CAST(rank AS INTEGER) AS rank, author, round(score, 6) AS score FROM tfidf_ranked"""


def vectors_cte() -> str:
    return """vecs AS (
  SELECT vec_id AS paper_id, CAST(label AS VARCHAR) AS author,
         CAST(embedding AS DOUBLE[]) AS v,
         sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS nv
  FROM embeddings)"""


def cosine_sql(a: str, b: str) -> str:
    return (f"CASE WHEN {a}.nv = 0 OR {b}.nv = 0 THEN 0.0 "
            f"ELSE list_dot_product({a}.v, {b}.v) / ({a}.nv * {b}.nv) END")


def dense_best_cte() -> str:
    return f"""{vectors_cte()},
dense_best AS (
  SELECT q.paper_id AS query_id, c.author, max({cosine_sql('q', 'c')}) AS score
  FROM vecs q JOIN vecs c ON len(q.v) = len(c.v)
  WHERE c.author IS NOT NULL GROUP BY ALL)"""


def dense_ranked_cte(k: int) -> str:
    return f"""dense_ranked AS (
  SELECT query_id, author, score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, author) AS rank
  FROM dense_best QUALIFY rank <= {k})"""


def profiles_cte() -> str:
    return """plong AS (
  SELECT CAST(label AS VARCHAR) AS author, generate_subscripts(embedding, 1) - 1 AS dim,
         CAST(unnest(embedding) AS DOUBLE) AS x
  FROM embeddings WHERE label IS NOT NULL),
pmean AS (
  SELECT author, dim, avg(CASE WHEN isnan(x) THEN NULL ELSE x END) AS m
  FROM plong GROUP BY ALL),
profiles AS (
  SELECT author, list(m ORDER BY dim) AS v, sqrt(sum(m * m)) AS nv
  FROM pmean GROUP BY author HAVING count(m) = count(*))"""


@oracle("q10_dense_cosine")
def _q10():
    return f"""
WITH {vectors_cte()},
pair AS (
  SELECT q.paper_id AS query_id, c.paper_id, c.author, {cosine_sql('q', 'c')} AS score
  FROM vecs q JOIN vecs c ON len(q.v) = len(c.v) WHERE c.author IS NOT NULL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, paper_id) AS rank
  FROM pair QUALIFY rank <= {K})
SELECT query_id, CAST(rank AS INTEGER) AS rank, paper_id, author, round(score, 6) AS score FROM ranked"""


@oracle("q11_recommend_embedding")
def _q11():
    return f"""
WITH {dense_best_cte()},
{dense_ranked_cte(K)}
SELECT query_id, CAST(rank AS INTEGER) AS rank, author, round(score, 6) AS score
FROM dense_ranked"""


@oracle("q12_exclude_by_score")
def _q12():
    return f"""
WITH {dense_best_cte()},
{dense_ranked_cte(K + OVERFETCH)}
SELECT query_id, author FROM dense_ranked WHERE score >= {EXCLUDE_AT}"""


@oracle("q16_author_profiles")
def _q16():
    return f"""
WITH {profiles_cte()}
SELECT author, CAST(dim AS INTEGER) AS dim, round(m, 6) AS value
FROM pmean WHERE author IN (SELECT author FROM profiles)"""


@oracle("q17_author_similarity")
def _q17():
    return f"""
WITH {profiles_cte()},
sizes AS (SELECT CAST(label AS VARCHAR) AS author, count(*) AS n FROM embeddings
          WHERE label IS NOT NULL GROUP BY label),
wanted AS (SELECT author FROM sizes WHERE n > (SELECT avg(n) FROM sizes)),
sims AS (
  SELECT a.author, b.author AS similar_author, {cosine_sql('a', 'b')} AS similarity
  FROM profiles a JOIN profiles b ON a.author <> b.author
  WHERE a.author IN (SELECT author FROM wanted)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY author
                               ORDER BY round(similarity, 9) DESC, similar_author) AS rank
  FROM sims QUALIFY rank <= {2 * K})
SELECT author, CAST(rank AS INTEGER) AS rank, similar_author, round(similarity, 6) AS similarity
FROM ranked"""


@oracle("q18_similar_authors")
def _q18():
    return f"""
WITH {profiles_cte()},
sims AS (
  SELECT a.author, b.author AS similar_author, {cosine_sql('a', 'b')} AS similarity
  FROM profiles a JOIN profiles b ON a.author <> b.author),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY author
                               ORDER BY round(similarity, 9) DESC, similar_author) AS rank
  FROM sims QUALIFY rank <= {K})
SELECT author, CAST(rank AS INTEGER) AS rank, similar_author, round(similarity, 6) AS similarity
FROM ranked"""


def names_cte() -> str:
    return """names AS (
  SELECT author, arg_min(name, doc_id) AS name
  FROM (SELECT doc_id, author,
               list_min(list_filter(string_split(processed_text, ' '), lambda x: length(x) >= 6))
               AS name
        FROM corpus)
  WHERE name IS NOT NULL AND author IS NOT NULL GROUP BY author)"""


def listed_sql(subs: str) -> str:
    return f"""SELECT DISTINCT s.query_id, n.author FROM {subs} s, names n
WHERE contains(lower(substr(s.raw_text, 1, {PREFIX})), lower(n.name))"""


@oracle("q13_listed_authors")
def _q13():
    return f"""
WITH {corpus_cte()},
{names_cte()},
subs AS (SELECT doc_id AS query_id, raw_text FROM corpus)
{listed_sql('subs')}"""


@oracle("q14_listed_authors_blocked")
def _q14():
    return f"""
WITH {corpus_cte()},
{names_cte()},
subs AS (SELECT doc_id AS query_id, raw_text FROM corpus),
parts AS (SELECT author || ':' || n AS author, substr(name, 1, n) AS name
          FROM names CROSS JOIN (SELECT unnest([2, 4, 100]) AS n))
{listed_sql('subs').replace('names n', 'parts n')}"""


def online_ctes() -> str:
    fetch = K + OVERFETCH
    return f"""{index_ctes()},
aligned AS (
  SELECT c.doc_id, c.author, CAST(e.embedding AS DOUBLE[]) AS v,
         sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) AS nv
  FROM corpus c JOIN embeddings e ON c.doc_id = e.vec_id),
subs_all AS (
  SELECT doc_id AS query_id, raw_text, {norm_sql('raw_text', 2)} AS processed_text FROM corpus),
subs AS (SELECT * FROM subs_all WHERE processed_text <> ''),
{query_vector_ctes('subs')},
qids AS (SELECT query_id FROM subs),
{padded_tfidf_ranking('qids', fetch, 'tfidf_fetch')},
{padded_tfidf_ranking('qids', K, 'tfidf_k')},
dense_best AS (
  SELECT q.doc_id AS query_id, c.author, max({cosine_sql('q', 'c')}) AS score
  FROM aligned q JOIN aligned c ON len(q.v) = len(c.v)
  WHERE q.doc_id IN (SELECT query_id FROM subs) AND c.author IS NOT NULL GROUP BY ALL),
dense_fetch AS (
  SELECT query_id, author, score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, author) AS rank
  FROM dense_best QUALIFY rank <= {fetch}),
dense_k AS (SELECT * FROM dense_fetch WHERE rank <= {K}),
{names_cte()},
listed AS ({listed_sql('subs')}),
excl AS (
  SELECT query_id, author FROM dense_fetch WHERE score >= {EXCLUDE_AT}
  UNION SELECT query_id, author FROM listed)"""


def _filtered(src: str, method: str) -> str:
    return f"""SELECT query_id, '{method}' AS method, author, score,
       row_number() OVER (PARTITION BY query_id ORDER BY rank) AS new_rank
FROM {src} r
WHERE NOT EXISTS (SELECT 1 FROM excl x WHERE x.query_id = r.query_id AND x.author = r.author)
QUALIFY new_rank <= {K}"""


@oracle("q15_recommend_filtered")
def _q15():
    return f"""
WITH {online_ctes()},
f AS ({_filtered('tfidf_fetch', 'tfidf')} UNION ALL {_filtered('dense_fetch', 'embedding')})
SELECT query_id, method, CAST(new_rank AS INTEGER) AS rank, author, round(score, 6) AS score
FROM f"""


@oracle("q19_align_vectors")
def _q19():
    return f"""
WITH {corpus_cte()}
SELECT c.doc_id AS paper_id, c.author, e.label, CAST(len(e.embedding) AS INTEGER) AS dim
FROM corpus c JOIN embeddings e ON c.doc_id = e.vec_id"""


def comparison_cte() -> str:
    return """cmp AS (
  SELECT coalesce(t.query_id, d.query_id) AS query_id, CAST(coalesce(t.rank, d.rank) AS INTEGER) AS rank,
         t.author AS tfidf_author, round(t.score, 6) AS tfidf_score,
         d.author AS embedding_author, round(d.score, 6) AS embedding_score
  FROM tfidf_k t FULL JOIN dense_k d ON t.query_id = d.query_id AND t.rank = d.rank)"""


@oracle("q20_compare_methods")
def _q20():
    return f"""
WITH {online_ctes()},
{comparison_cte()}
SELECT cmp.*, c.author AS actual_author FROM cmp LEFT JOIN corpus c ON c.doc_id = cmp.query_id"""


@oracle("q21_evaluate_sample")
def _q21():
    return f"""
WITH {online_ctes()},
{comparison_cte()}
SELECT s.query_id,
       CASE WHEN s.processed_text = '' THEN 'no_text' WHEN a.doc_id IS NULL THEN 'no_vector' ELSE 'ok' END
         AS status,
       c.author AS actual_author, cmp.rank, cmp.tfidf_author, cmp.tfidf_score, cmp.embedding_author,
       cmp.embedding_score
FROM subs_all s JOIN corpus c ON c.doc_id = s.query_id
LEFT JOIN aligned a ON a.doc_id = s.query_id LEFT JOIN cmp ON cmp.query_id = s.query_id"""


@oracle("q29_listed_distinct_union")
def _q29():
    return f"""
WITH {online_ctes()}
SELECT query_id, author FROM excl"""


_TAG = "'<[^>]*>'"


def _blank_free(x: str) -> str:
    return f"coalesce(regexp_matches({x}, '{_NON_BLANK}'), false)"


def page_stage_ctes(src: str = "pages") -> str:
    return rf"""a AS (
  SELECT page_id, url, html,
         regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1) AS art FROM {src}),
st AS (
  SELECT page_id, url,
    regexp_replace(array_to_string(regexp_extract_all(art, '(?s)<p(?:\s[^>]*)?>(.*?)</p>', 1),
                   chr(10)), {_TAG}, '', 'g') AS s1,
    regexp_replace(regexp_replace(art, {_TAG}, '', 'g'),
                   '\A[{_WS}]+|[{_WS}]+\z', '', 'g') AS s2,
    regexp_replace(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), {_TAG}, '', 'g') AS s3
  FROM a)"""


@oracle("q22_concat_pages")
def _q22():
    return """
SELECT conv_id, count(*) AS n_pages, string_agg(text, '' ORDER BY turn) AS text
FROM conversations GROUP BY conv_id"""


@oracle("q23_extract_fallback")
def _q23():
    return f"""
WITH {page_stage_ctes()}
SELECT page_id,
  CASE WHEN {_blank_free('s1')} THEN 'paragraphs' WHEN {_blank_free('s2')} THEN 'article'
       WHEN {_blank_free('s3')} THEN 'title' END AS extractor,
  CASE WHEN {_blank_free('s1')} OR {_blank_free('s2')} OR {_blank_free('s3')} THEN 'ok'
       ELSE 'no_text' END AS status,
  CASE WHEN {_blank_free('s1')} THEN s1 WHEN {_blank_free('s2')} THEN s2
       WHEN {_blank_free('s3')} THEN s3 ELSE '' END AS text
FROM st"""


@oracle("q24_failed_documents")
def _q24():
    return f"""
WITH handed AS (SELECT page_id, url, html FROM pages
  UNION ALL SELECT doc_id, 'doc:' || doc_id, text FROM documents),
{page_stage_ctes('handed')}
SELECT page_id, url, 'no_text' AS reason FROM st
WHERE NOT {_blank_free('s1')} AND NOT {_blank_free('s2')} AND NOT {_blank_free('s3')}"""


ORACLE["q25_parquet_roundtrip"] = ORACLE["q05_tfidf_weights"]


@oracle("q26_csv_roundtrip")
def _q26():
    return f"""
WITH {corpus_cte()}
SELECT author, 'doc_' || doc_id || '.pdf' AS paper, processed_text FROM corpus"""


@oracle("q27_hash_encode")
def _q27():
    return f"""
WITH {corpus_cte()},
t AS (SELECT doc_id, unnest(list_filter(string_split(processed_text, ' '),
                                         lambda x: length(x) > 0)) AS tok FROM corpus),
b AS (SELECT doc_id, CAST(('0x' || substr(md5(tok), 1, 8))::BIGINT % 64 AS INTEGER) AS dim FROM t),
c AS (SELECT doc_id, dim, count(*) AS n FROM b GROUP BY ALL)
SELECT doc_id, dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS value FROM c"""


ORACLE["q28_stream_recommendations"] = ORACLE["q08_recommend_tfidf"]


def hash_vectors(src: str, key: str) -> str:
    """(key, v DOUBLE[64], nv): unit hash vectors of ``processed_text``, zero for blank texts."""
    return f"""{src}_tok AS (
  SELECT {key}, CAST(('0x' || substr(md5(tok), 1, 8))::BIGINT % 64 AS INTEGER) AS dim, count(*) AS n
  FROM (SELECT {key}, unnest(list_filter(string_split(processed_text, ' '), lambda x: length(x) > 0)) AS tok
        FROM {src}) GROUP BY ALL),
{src}_map AS (
  SELECT {key}, map_from_entries(list((dim, n))) AS m, sqrt(sum(n * n)) AS nv FROM {src}_tok GROUP BY {key}),
{src}_vec AS (
  SELECT s.{key}, list_transform(range(64), lambda d: coalesce(m[CAST(d AS INTEGER)] / nv, 0.0)) AS v,
         CASE WHEN nv IS NULL THEN 0.0 ELSE 1.0 END AS nv
  FROM {src} s LEFT JOIN {src}_map p ON p.{key} = s.{key})"""


@oracle("q30_text_to_recommendations")
def _q30():
    fetch = K + OVERFETCH
    return f"""
WITH {index_ctes()},
subs AS (
  SELECT * FROM (SELECT item_id AS query_id, text AS raw_text, {norm_sql('text', 2)} AS processed_text
                 FROM benchmark) WHERE processed_text <> ''),
papers AS (
  SELECT doc_id, author, {norm_sql('raw_text', 2)} AS processed_text FROM corpus),
{query_vector_ctes('subs')},
qids AS (SELECT query_id FROM subs),
{padded_tfidf_ranking('qids', fetch, 'tfidf_fetch')},
{hash_vectors('subs', 'query_id')},
{hash_vectors('papers', 'doc_id')},
dense_fetch AS (
  SELECT query_id, author, score,
         row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, author) AS rank
  FROM (SELECT q.query_id, p.author, max({cosine_sql('q', 'c')}) AS score
        FROM subs_vec q CROSS JOIN papers_vec c JOIN papers p ON p.doc_id = c.doc_id
        WHERE p.author IS NOT NULL GROUP BY ALL) QUALIFY rank <= {fetch}),
names AS (SELECT DISTINCT author, author AS name FROM corpus WHERE author IS NOT NULL),
listed AS ({listed_sql('subs')}),
excl AS (
  SELECT query_id, author FROM dense_fetch WHERE score >= {EXCLUDE_AT}
  UNION SELECT query_id, author FROM listed),
f AS ({_filtered('tfidf_fetch', 'tfidf')} UNION ALL {_filtered('dense_fetch', 'embedding')})
SELECT query_id, method, CAST(new_rank AS INTEGER) AS rank, author, round(score, 6) AS score FROM f"""


@oracle("q31_author_list")
def _q31():
    return f"""
WITH {corpus_cte()},
sizes AS (SELECT author, count(*) AS n FROM corpus WHERE author IS NOT NULL GROUP BY author)
SELECT author FROM sizes
WHERE author <> (SELECT author FROM sizes ORDER BY n DESC, author DESC LIMIT 1)"""


@oracle("q32_point_lookups")
def _q32():
    return f"""
WITH {corpus_cte()},
docs AS (SELECT doc_id, author, 'doc_' || doc_id || '.pdf' AS full_path FROM corpus),
ends AS (SELECT min(doc_id) AS lo, max(doc_id) AS hi FROM docs)
SELECT docs.*, 'position' AS found_by FROM docs, ends WHERE doc_id IN (lo, hi)
UNION ALL
SELECT docs.*, 'path' FROM docs, ends WHERE full_path = 'doc_' || ((lo + hi) // 2) || '.pdf'"""


@oracle("q33_saved_vectors")
def _q33():
    return """
SELECT vec_id AS paper_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim,
       round(CAST(unnest(embedding) AS DOUBLE), 6) AS value
FROM embeddings"""


# other plans for the same results
ORACLE["q34_bounded_papers"] = ORACLE["q07_sparse_cosine"]
ORACLE["q35_bounded_authors"] = ORACLE["q08_recommend_tfidf"]
ORACLE["q36_pivoted_papers"] = ORACLE["q10_dense_cosine"]
ORACLE["q37_pivoted_authors"] = ORACLE["q18_similar_authors"]


@oracle("q38_lsa_vectors")
def _q38():
    return f"""
WITH {index_ctes()}
SELECT DISTINCT doc_id, author, CAST(64 AS INTEGER) AS dim, 1.0::DOUBLE AS norm FROM postings"""
