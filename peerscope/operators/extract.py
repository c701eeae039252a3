"""Staged text extraction, page concatenation, dead letters, ingest summary.

A stage is either a Column expression (evaluated in the JVM) or a Python
function ``pandas.Series -> pandas.Series`` over the raw column. Stages are
tried in order; the first output holding a non-whitespace character wins.
Neighbouring Python stages run in one Arrow-batched pandas UDF, each on the
rows of the batch that are still without text. A stage that raises, or takes
longer than ``timeout_s`` for a row, gives that row no text and the next stage
goes on.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import signal
import threading

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerscope.functions.text import WHITESPACE_CLASS, is_blank

Stage = tuple[str, "Column | Callable[[pd.Series], pd.Series]"]

# --- fixed values: HTML patterns of the page stages ------------------------
ARTICLE_RE = r"(?s)<article[^>]*>(.*?)</article>"
PARAGRAPH_RE = r"(?s)<p(?:\s[^>]*)?>(.*?)</p>"
TITLE_RE = r"(?s)<title[^>]*>(.*?)</title>"
TAG_RE = r"<[^>]*>"
# ---------------------------------------------------------------------------

_EDGE_WS = rf"\A[{WHITESPACE_CLASS}]+|[{WHITESPACE_CLASS}]+\z"


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, TAG_RE, "")


def strip_ws(c: Column) -> Column:
    """Remove leading and trailing whitespace in Python's (Unicode) sense."""
    return F.regexp_replace(c, _EDGE_WS, "")


def article_html(html: str = "html") -> Column:
    return F.regexp_extract(F.col(html), ARTICLE_RE, 1)


def paragraph_stage(html: str = "html") -> Column:
    """Text of the paragraphs of the article (the page's text layer)."""
    paras = F.regexp_extract_all(article_html(html), F.lit(PARAGRAPH_RE), 1)
    return strip_tags(F.array_join(paras, "\n"))


def article_stage(html: str = "html") -> Column:
    """Whole article with tags removed, trimmed (this stage returns stripped text)."""
    return strip_ws(strip_tags(article_html(html)))


def title_stage(html: str = "html") -> Column:
    return strip_tags(F.regexp_extract(F.col(html), TITLE_RE, 1))


def page_stages(html: str = "html") -> list[Stage]:
    return [("paragraphs", paragraph_stage(html)), ("article", article_stage(html)),
            ("title", title_stage(html))]


def _run_limited(stage, values: pd.Series, timeout_s: float | None) -> pd.Series:
    """The stage's output; a raised error or a passed time limit is raised here."""
    if not timeout_s or threading.current_thread() is not threading.main_thread():
        return stage(values)

    def stop(*_):
        raise TimeoutError(f"no result within {timeout_s} s")

    before = signal.signal(signal.SIGALRM, stop)
    signal.setitimer(signal.ITIMER_REAL, timeout_s)
    try:
        return stage(values)
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def _tolerant(stage, values: pd.Series, timeout_s: float | None) -> list:
    """Stage output per row, None where it failed: the batch at once, or row by row."""
    if not timeout_s:
        try:
            return list(stage(values))
        except Exception:  # noqa: BLE001 - a failed stage is a stage without text
            if len(values) == 1:
                return [None]
    out = []
    for i in range(len(values)):
        try:
            out.append(list(_run_limited(stage, values.iloc[i:i + 1], timeout_s))[0])
        except Exception:  # noqa: BLE001
            out.append(None)
    return out


def _python_stages(stages: Sequence[Stage], timeout_s: float | None):
    """One pandas UDF (source, pending) -> struct(t, e) for a run of Python stages."""
    def run(source: pd.Series, pending: pd.Series) -> pd.DataFrame:
        texts, names = [None] * len(source), [None] * len(source)
        todo = [i for i, p in enumerate(pending) if p]
        for name, stage in stages:
            if not todo:
                break
            found = _tolerant(stage, source.iloc[todo], timeout_s)
            hit = [isinstance(t, str) and bool(t.strip()) for t in found]
            for i, t, h in zip(todo, found, hit):
                if h:
                    texts[i], names[i] = t, name
            todo = [i for i, h in zip(todo, hit) if not h]
        return pd.DataFrame({"t": texts, "e": names}, dtype=object)

    return F.pandas_udf(run, "t string, e string").asNondeterministic()


def extract_text(df: DataFrame, stages: Sequence[Stage], source_col: str | None = None,
                 guards: Sequence[tuple[str, Column]] = (),
                 timeout_s: float | None = None) -> DataFrame:
    """Add ``raw_text`` ('' when nothing was found), ``extractor`` and ``status``.

    ``guards`` are (status, predicate) pairs checked first: a row matching
    one (an encrypted or missing file) gets '' at once and no stage runs.
    ``status`` is 'ok', 'no_text' or the guard's name.
    """
    guard_status = F.lit(None).cast("string")
    for name, pred in reversed(list(guards)):
        guard_status = F.when(pred, F.lit(name)).otherwise(guard_status)
    out = df.withColumn("_guard", guard_status).withColumn(
        "raw_text", F.lit(None).cast("string")).withColumn("extractor", F.lit(None).cast("string"))
    runs: list[list[Stage]] = []
    for item in stages:
        python = not isinstance(item[1], Column)
        if python and runs and not isinstance(runs[-1][0][1], Column):
            runs[-1].append(item)
        else:
            runs.append([item])
    for run in runs:
        name, stage = run[0]
        pending = F.col("_guard").isNull() & F.col("raw_text").isNull()
        if isinstance(stage, Column):
            # the stage value is bound once to a lambda variable; coalesce
            # evaluates a later stage only for rows still without text
            found = F.get(F.transform(F.array(stage), lambda x: F.when(
                ~is_blank(x), F.struct(x.alias("t"), F.lit(name).alias("e")))), 0)
            hit = F.when(pending, found)
        else:
            if source_col is None:
                raise ValueError("a Python stage needs source_col")
            hit = _python_stages(run, timeout_s)(F.col(source_col), pending)
        out = out.withColumn("_hit", hit)
        out = (out.withColumn("raw_text", F.coalesce("raw_text", F.col("_hit.t")))
                  .withColumn("extractor", F.coalesce("extractor", F.col("_hit.e")))
                  .drop("_hit"))
    status = (F.when(F.col("_guard").isNotNull(), F.col("_guard"))
               .when(F.col("raw_text").isNull(), F.lit("no_text")).otherwise(F.lit("ok")))
    return (out.withColumn("status", status)
               .withColumn("raw_text", F.coalesce("raw_text", F.lit("")))
               .drop("_guard"))


def concat_pages(pages: DataFrame, doc_col: str = "doc_id", page_col: str = "page_no",
                 text_col: str = "text", error_col: str | None = None,
                 on_page_error: str = "skip", pages_per_block: int = 1024) -> DataFrame:
    """(doc_id, n_pages, text): page texts joined in page order, no separator.

    With ``error_col``, a failed page is left out (``on_page_error='skip'``;
    with no page left the text is '')
    or fails the whole document, whose text is then NULL (``'fail'``).
    Two levels, so a document with a huge number of pages is not ordered
    and merged in a single task: runs of ``pages_per_block`` consecutive
    page numbers are concatenated in parallel (key: document, block), then
    the block strings are joined in block order.
    """
    if on_page_error not in ("skip", "fail"):
        raise ValueError("on_page_error must be 'skip' or 'fail'")
    failed = F.col(error_col).isNotNull() if error_col is not None else F.lit(False)
    p = pages.withColumn("_page", F.when(~failed, F.col(text_col)))
    skip = error_col is not None and on_page_error == "skip"
    block = F.floor(F.col(page_col) / F.lit(pages_per_block)).alias("_block")
    blocks = p.groupBy(doc_col, block).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(failed).alias("_failed"),
        F.count("_page").alias("_texts"),
        F.expr(f"listagg(_page, '') WITHIN GROUP (ORDER BY {page_col})").alias("_t"))
    out = blocks.groupBy(doc_col).agg(
        F.sum("_n").alias("n_pages"),
        F.sum("_failed").alias("_failed"),
        F.sum("_texts").alias("_texts"),
        F.expr("listagg(_t, '') WITHIN GROUP (ORDER BY _block)").alias("text"))
    # no page text at all -> NULL, as a single-level string aggregate gives
    text = F.when(F.col("_texts") > 0, F.col("text"))
    if error_col is not None and on_page_error == "fail":
        text = F.when(F.col("_failed") == 0, text)
    if skip:
        # a document whose pages all failed stays, without text: it is a failed document
        text = F.when(F.col("_failed") == F.col("n_pages"), F.lit("")).otherwise(text)
        return out.select(doc_col, (F.col("n_pages") - F.col("_failed")).alias("n_pages"),
                          text.alias("text"))
    return out.select(doc_col, "n_pages", text.alias("text"))


def failed_documents(extracted: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """Dead letter: rows for which no stage produced text (or a guard fired)."""
    return extracted.where(F.col("status") != "ok").select(*id_cols, F.col("status").alias("reason"))


def kept_documents(extracted: DataFrame) -> DataFrame:
    """Rows kept for the corpus: extracted raw text is non-empty."""
    return extracted.where(F.col("raw_text") != "")


def ingest_summary(extracted: DataFrame) -> DataFrame:
    """(extractor, status, n): counts per winning stage and outcome."""
    return extracted.groupBy("extractor", "status").agg(F.count(F.lit(1)).alias("n"))
