import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from peerscope.operators.encode import cached_model_loader, hashing_vectors, model_encoder
from peerscope.operators.extract import extract_text, ingest_summary


def _bucket(tok, dim):
    return int(hashlib.md5(tok.encode()).hexdigest()[:8], 16) % dim


def test_hashing_vectors_match_python_and_zero_for_empty(spark):
    docs = spark.createDataFrame([(1, "deep model deep"), (2, "")], "doc_id long, processed_text string")
    got = {r.doc_id: r.embedding for r in hashing_vectors(docs, dim=8).collect()}
    want = [0.0] * 8
    for tok in ["deep", "model", "deep"]:
        want[_bucket(tok, 8)] += 1
    norm = math.sqrt(sum(v * v for v in want))
    assert got[1] == pytest.approx([v / norm for v in want])
    assert got[2] == [0.0] * 8


def test_model_encoder_plugs_a_model_through_predict_batch_udf(spark):
    def load(name):
        def predict(texts: np.ndarray) -> np.ndarray:
            return np.stack([[float(len(t)), float(t.count(" "))] for t in texts]).astype(np.float32)
        return predict

    make = cached_model_loader("/nonexistent/model-cache", "tiny-model", load)
    encode = model_encoder(make, dim=2, batch_size=4)
    df = spark.createDataFrame([("a b",), ("abcd",)], "t string")
    got = [r.v for r in df.select(encode(F.col("t")).alias("v")).collect()]
    assert got == [[3.0, 1.0], [4.0, 0.0]]


def test_ingest_summary_counts_per_stage(spark):
    df = spark.createDataFrame([(1, "x", None), (2, None, "y"), (3, None, None)],
                               "id long, a string, b string")
    ex = extract_text(df, [("a", F.col("a")), ("b", F.col("b"))])
    got = {(r.extractor, r.status): r.n for r in ingest_summary(ex).collect()}
    assert got == {("a", "ok"): 1, ("b", "ok"): 1, (None, "no_text"): 1}
