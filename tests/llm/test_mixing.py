import math
import re
from collections import defaultdict

from pyspark.sql import functions as F

from fixtures import awkward, awkward_rows, empty
from peerscope.llm.mixing import _pivot, mix_sources, repeat_documents

import pandas as pd


def targets(sizes, weights=(1, 2, 3)):
    """Brute force: share out, cap at three times, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    got, left, open_ = dict.fromkeys(sizes, 0.0), float(sum(sizes.values())), set(sizes)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        share = {s: got[s] + left * weight[s] / total for s in open_}
        left = 0.0
        for s, x in share.items():
            got[s] = min(x, 3.0 * sizes[s])
            left += x - got[s]
        open_ = {s for s in open_ if got[s] < 3.0 * sizes[s]}
    return got


def test_targets_follow_weights_and_ceiling(spark):
    rows = mix_sources(awkward(spark)).collect()
    sizes = defaultdict(int)
    for r in awkward_rows():
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    want = targets(sizes)
    assert len(rows) == len(awkward_rows())
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-6)
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3


def test_taken_words_come_near_their_target_and_reruns_agree(spark):
    rows = [(i, "word " * (5 + i % 40), "en", ("hot" if i % 3 else f"s{i % 7}"), 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    first = mix_sources(docs, leaf_rows=64, fan_in=4).collect()
    taken, target = defaultdict(int), {}
    for r in first:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    for s in target:
        assert abs(taken[s] - target[s]) <= 45        # one document at most
    again = mix_sources(docs.repartition(7), leaf_rows=64, fan_in=4).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


def test_pivot_keeps_mass_and_leaves_one_fraction():
    rows = pd.DataFrame({"doc_id": range(50), "size": [1 + i % 9 for i in range(50)],
                         "p": [0.3] * 50, "node": 0})
    out = _pivot(rows, 1, 0)
    fractions = out["p"].between(0, 1, inclusive="neither").sum()
    assert fractions <= 1
    assert math.isclose((out["p"] * out["size"]).sum(), 0.3 * rows["size"].sum(), rel_tol=1e-9)


def test_pivot_is_unbiased():
    rows = pd.DataFrame({"doc_id": range(4), "size": [5, 3, 2, 1], "p": [0.4] * 4, "node": 0})
    mean = sum(_pivot(rows, seed, 0).set_index("doc_id")["p"] for seed in range(3000)) / 3000
    assert (abs(mean - 0.4) < 0.04).all()


def test_repeated_documents_match_the_mix(spark):
    docs = awkward(spark)
    mix = mix_sources(docs)
    out = repeat_documents(docs, mix)
    assert out.columns == docs.columns
    want = {r[0]: r[1] for r in mix.groupBy("doc_id").agg(F.sum("copies")).collect() if r[1]}
    got = {r[0]: r[1] for r in out.groupBy("doc_id").count().collect()}
    assert got == want


def test_empty_table(spark):
    assert mix_sources(empty(spark)).count() == 0
