"""Pages as rows, limits that end native calls, submitted files as a stream."""

import os
import sys
import time

from pyspark import cloudpickle

import peerscope as ps
from peerscope.functions.text import normalize_text
from peerscope.operators.pages import PageStage, extract_files, page_rows, read_pages, text_pages
from peerscope.operators.recommend import recommend
from peerscope.sources.corpus import build_corpus
from peerscope.streaming.recommendations import stream_submitted_files


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks do not import test modules


class Marked:
    """Pages of a text; some do what real readers do on bad files."""

    def __init__(self, content):
        if content.startswith(b"locked"):
            raise ValueError("encrypted")
        self.pages = content.decode().split("\f") if content else []

    def __len__(self):
        return len(self.pages)

    def __getitem__(self, i):
        text = self.pages[i]
        if text == "hang":
            import ctypes
            ctypes.CDLL(None).pause()       # a native call that no signal handler of Python ends
        if text == "die":
            os._exit(9)
        if text == "raise":
            raise RuntimeError("bad page")
        return text


def blank(content):
    return [" ", "\n"]


QUICK = PageStage("marked", Marked, True, 0.6)


def test_a_hanging_page_costs_its_limit_and_nothing_else():
    start = time.time()
    rows, reason = read_pages(b"one\fhang\ftwo\fdie\fraise\fthree", QUICK)
    assert reason is None and 0.5 < time.time() - start < 6
    assert rows == [(0, "one", None), (1, None, "timeout"), (2, "two", None), (3, None, "process died"),
                    (4, None, "RuntimeError: bad page"), (5, "three", None)]


def test_a_strict_stage_is_given_up_at_its_first_failed_page():
    rows, reason = read_pages(b"one\fraise\ftwo", QUICK._replace(tolerant=False))
    assert reason == "page 1: RuntimeError: bad page" and len(rows) == 2


FILES = [("a", b"one\fhang\ftwo"), ("b", b"locked"), ("c", b""), ("d", None), ("e", b"raise"), ("f", b" \f\n"),
         ("g", b"\xff\xfe"), ("h", "é\fü".encode())]


def test_pages_are_rows_with_provenance(spark):
    files = spark.createDataFrame(FILES, "full_path string, content binary")
    stages = [PageStage("blank", blank), PageStage("strict", Marked, False, 0.6), QUICK]
    got = sorted((tuple(r) for r in page_rows(files, stages, ["full_path"]).collect()), key=lambda r: (r[0], r[2] or 0))
    by = {}
    for path, *rest in got:
        by.setdefault(path, []).append(tuple(rest))
    assert by["a"] == [("marked", 0, "one", None), ("marked", 1, None, "timeout"), ("marked", 2, "two", None)]
    assert by["h"] == [("strict", 0, "é", None), ("strict", 1, "ü", None)]
    assert by["b"] == [(None, None, None, "marked: ValueError: encrypted")]
    assert by["c"] == [(None, None, None, "marked: no_pages")] and by["d"] == [(None, None, None, "no_content")]
    assert by["f"] == [(None, None, None, "no_text")] and len(by) == 8
    assert by["e"][0][3].startswith("strict: page 0") and by["g"][0][3].startswith("marked: UnicodeDecodeError")


def test_documents_from_pages(spark):
    files = spark.createDataFrame(FILES, "full_path string, content binary")
    for policy, text, status in (("skip", "onetwo", "ok"), ("fail", "", "failed_page")):
        docs, pages = extract_files(files, [QUICK], on_page_error=policy)
        got = {r.full_path: r for r in docs.collect()}
        assert (got["a"].raw_text, got["a"].status, got["a"].n_pages, got["a"].n_failed) == (text, status, 3, 1)
        assert got["h"].raw_text == "éü" and got["h"].extractor == "marked"
        assert {p for p, r in got.items() if r.status != "ok"} == set("bcdefg") | ({"a"} if policy == "fail" else set())


def _write(folder, name, data):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "wb") as f:
        f.write(data)


def test_corpus_from_page_readers(spark, tmp_dir):
    for name, data in (("a/one.pdf", b"Deep\fmodels"), ("a/two.pdf", b"locked"), ("b/three.pdf", b"Graph hang")):
        _write(os.path.join(tmp_dir, os.path.dirname(name)), os.path.basename(name), data)
    corpus, failed = build_corpus(spark, tmp_dir, readers=[QUICK])
    assert sorted((r.author, r.raw_text, r.extractor) for r in corpus.collect()) == [
        ("a", "Deepmodels", "marked"), ("b", "Graph hang", "marked")]
    assert [r.reason for r in failed.collect()] == ["marked: ValueError: encrypted"]


def test_stream_of_files_with_a_corrupt_one_and_a_replay(spark, tmp_dir):
    words = ["graph", "query", "index", "neural", "signal", "vision"]
    corpus = spark.createDataFrame([(i, f"au{i % 4}", " ".join(words[(i + j) % 6] for j in range(3 + i % 3)))
                                    for i in range(24)], "doc_id long, author string, processed_text string")
    index = ps.fit_tfidf(corpus, min_df=1, max_df=1.0)
    vectors = ps.hashing_vectors(corpus).join(corpus.select("doc_id", "author"), "doc_id") \
        .withColumnRenamed("doc_id", "paper_id")

    def encode(t):
        return ps.hashing_vectors(t, id_col="query_id")

    inbox, sink, dead, ckpt = (os.path.join(tmp_dir, n) for n in ("in", "out", "dead", "ckpt"))
    sent = {"x1.txt": b"Graph\f query", "x2.txt": b"locked", "x3.txt": b"neural signal"}
    for i, (name, data) in enumerate(sent.items()):
        _write(inbox, name, data)
        os.utime(os.path.join(inbox, name), (1_700_000_000 + i, 1_700_000_000 + i))
    _write(inbox, "not-matched.bin", b"graph")

    def run():
        stream_submitted_files(spark, inbox, index, sink, dead, ckpt, [QUICK], k=3, pattern="*.txt",
                               vector_corpus=vectors, encode=encode, max_files_per_trigger=1).awaitTermination()
        return (sorted(map(str, spark.read.parquet(sink).collect())), sorted(map(str, spark.read.parquet(dead).collect())))

    first = run()
    assert sorted(os.listdir(sink)) == sorted(os.listdir(dead)) == ["epoch=0", "epoch=1", "epoch=2"]
    for name in (os.path.join(ckpt, "commits", "2"), os.path.join(ckpt, "commits", ".2.crc")):
        if os.path.exists(name):
            os.unlink(name)
    assert run() == first
    lost = spark.read.parquet(dead).collect()
    assert [(r.path.rsplit("/", 1)[-1], r.reason, r.epoch) for r in lost] == [("x2.txt", "marked: ValueError: encrypted", 1)]
    texts = spark.createDataFrame([("x1.txt", "Graph query"), ("x3.txt", "neural signal")], "query_id string, raw_text string")
    batch = recommend(texts.withColumn("processed_text", normalize_text("raw_text", min_token_len=2)),
                      index, vectors, k=3, encode=encode)
    want = sorted((r.query_id, r.method, r["rank"], r.author, round(r.score, 9)) for r in batch.collect())
    got = sorted((r.query_id.rsplit("/", 1)[-1], r.method, r["rank"], r.author, round(r.score, 9))
                 for r in spark.read.parquet(sink).collect())
    assert got == want and {m for _, m, *_ in got} == {"tfidf", "embedding"}


def test_text_pages():
    assert text_pages("a\fb".encode()) == ["a", "b"]
