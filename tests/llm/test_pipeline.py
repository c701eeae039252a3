import os

import pytest

import corpus_pipeline
from fixtures import awkward, empty

SF = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "mixing", "bpe"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver data not present")
def test_each_stage_on_awkward_documents(spark, tmp_dir):
    for k, docs in enumerate((awkward(spark), empty(spark))):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            assert docs.columns == columns
            stage(spark, docs, SF).write.parquet(f"{tmp_dir}/{k}-{name}")
            docs = spark.read.parquet(f"{tmp_dir}/{k}-{name}")
        assert docs.columns == ["doc_id", "source", "n_tokens", "ids", "decoded"]
        assert (docs.count() > 0) == (k == 0)
