import os

import pandas as pd
from pyspark.sql import functions as F

from peerscope.operators.evaluate import compare_methods
from peerscope.operators.extract import concat_pages, extract_text, failed_documents, page_stages
from peerscope.sources.corpus import build_corpus, scan_corpus
from peerscope.sources.sinks import export_csv, read_csv


def _write(root, rel, text):
    path = os.path.join(root, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_x26_scan_authors_and_suffix(spark, tmp_dir):
    _write(tmp_dir, "root.pdf", "top level paper")
    _write(tmp_dir, "A B/sub/x 100%.pdf", "nested paper")
    _write(tmp_dir, "C/q.PDF", "upper case suffix")
    got = sorted((r.author, r.paper) for r in scan_corpus(spark, tmp_dir).collect())
    assert got == [(".", "root.pdf"), ("A B", "x 100%.pdf")]


def test_build_corpus_dead_letter_and_dense_ids(spark, tmp_dir):
    _write(tmp_dir, "a/one.pdf", "Deep models")
    _write(tmp_dir, "a/two.pdf", "   ")
    _write(tmp_dir, "b/three.pdf", "Graph learning")
    corpus, failed = build_corpus(spark, tmp_dir)
    rows = sorted((r.paper_id, r.author, r.processed_text) for r in corpus.collect())
    assert rows == [(0, "a", "deep models"), (1, "b", "graph learning")]
    assert [r.full_path.endswith("two.pdf") for r in failed.collect()] == [True]


def test_x27_stage_order_guards_and_python_stage(spark):
    df = spark.createDataFrame([(1, " ", "s2 text", False), (2, "s1", "x", False),
                                (3, "s1", "x", True), (4, "", "", False)],
                               "id long, a string, b string, enc boolean")

    def upper_stage(s: pd.Series) -> pd.Series:
        return s.map(lambda v: "py:" + v if v == "" else "")

    stages = [("one", F.col("a")), ("two", F.col("b")), ("py", upper_stage)]
    out = extract_text(df, stages, source_col="b", guards=[("encrypted", F.col("enc"))])
    got = {r.id: (r.raw_text, r.extractor, r.status) for r in out.collect()}
    assert got == {1: ("s2 text", "two", "ok"), 2: ("s1", "one", "ok"),
                   3: ("", None, "encrypted"), 4: ("py:", "py", "ok")}
    none = extract_text(df.where("id = 4"), stages[:2])
    assert [r.reason for r in failed_documents(none, ["id"]).collect()] == ["no_text"]


def test_page_stages_fall_back(spark):
    html = ["<title>T1</title><article><p>para</p></article>",
            "<title>T2</title><article><h1> Head </h1><p><b>no close</article>",
            "<title>T3</title><article> </article>", None]
    df = spark.createDataFrame(list(enumerate(html)), "page_id long, html string")
    got = {r.page_id: (r.extractor, r.raw_text) for r in extract_text(df, page_stages()).collect()}
    assert got == {0: ("paragraphs", "para"), 1: ("article", "Head no close"),
                   2: ("title", "T3"), 3: (None, "")}


def test_x28_page_errors_skip_or_fail(spark):
    pages = spark.createDataFrame([(1, 1, "a", None), (1, 2, "b", "timeout"), (1, 3, "c", None),
                                   (2, 2, "y", None), (2, 1, "x", None)],
                                  "doc_id long, page_no int, text string, error string")
    skip = {r.doc_id: r.text for r in concat_pages(pages, error_col="error").collect()}
    fail = {r.doc_id: r.text for r in
            concat_pages(pages, error_col="error", on_page_error="fail").collect()}
    assert skip == {1: "ac", 2: "xy"}
    assert fail == {1: None, 2: "xy"}


def test_x29_csv_fields(spark, tmp_dir):
    df = spark.createDataFrame([('A "q"', "p,1.pdf", ""), ("b", "p2.pdf", None)],
                               "author string, paper string, processed_text string")
    path = os.path.join(tmp_dir, "out")
    assert export_csv(df, path)
    text = "".join(open(os.path.join(path, f), encoding="utf-8").read()
                   for f in sorted(os.listdir(path)) if f.endswith(".csv"))
    lines = [ln for ln in text.splitlines() if ln and ln != "author,paper,processed_text"]
    assert sorted(lines) == sorted(['"A ""q""","p,1.pdf",', "b,p2.pdf,"])
    back = read_csv(spark, path, "author string, paper string, processed_text string")
    assert sorted(tuple(r) for r in back.collect()) == [('A "q"', "p,1.pdf", ""), ("b", "p2.pdf", "")]


def test_x25_compare_lists_of_different_length(spark):
    a = spark.createDataFrame([(1, i, f"t{i}", 1.0 / i) for i in range(1, 4)],
                              "query_id long, rank int, author string, score double")
    b = spark.createDataFrame([(1, i, f"e{i}", 1.0 / i) for i in range(1, 6)],
                              "query_id long, rank int, author string, score double")
    rows = compare_methods(a, b).orderBy("rank").collect()
    assert [r.rank for r in rows] == [1, 2, 3, 4, 5]
    assert [r.tfidf_author for r in rows] == ["t1", "t2", "t3", None, None]


def test_concat_pages_across_blocks_keeps_page_order(spark):
    rows = [(1, p, chr(ord("a") + p)) for p in [7, 0, 3, 1, 6, 2, 5, 4]] + [(2, 0, None)]
    pages = spark.createDataFrame(rows, "doc_id long, page_no int, text string")
    got = {r.doc_id: (r.n_pages, r.text) for r in concat_pages(pages, pages_per_block=2).collect()}
    assert got == {1: (8, "abcdefgh"), 2: (1, None)}
