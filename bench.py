"""Benchmark of the headline queries.

Runs at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]
and prints one JSON line. Each query is executed to completion through the
no-op sink (full plan, nothing collected); the first run of each query is
reported as cold, the second as warm. ``fit_tfidf`` is the full index build
from the raw documents (normalise, count, vocabulary, weights), timed on its
own; the recommendation queries use the session's fitted index, as a
served recommender does.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pyspark  # noqa: E402

from peerscope.operators.tfidf import fit_tfidf  # noqa: E402
from peerscope.plans.queries import QUERIES  # noqa: E402
from peerscope.session import get_session  # noqa: E402
from peerscope.sources.tables import documents_corpus  # noqa: E402

HEADLINE = ["q08_recommend_tfidf", "q11_recommend_embedding", "q17_author_similarity",
            "q15_recommend_filtered", "q18_similar_authors", "q13_listed_authors",
            "q14_listed_authors_blocked", "q23_extract_fallback"]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def fit_index(spark, sf_dir):
    """The index build: vocabulary + unit-length postings, fully computed."""
    return fit_tfidf(documents_corpus(spark, sf_dir)).postings


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    jobs = {"fit_tfidf": fit_index}
    jobs.update({name: QUERIES[name] for name in HEADLINE})
    cold, warm = {}, {}
    for name, fn in jobs.items():
        for store in (cold, warm):
            t0 = time.perf_counter()
            run(fn(spark, sf_dir))
            store[name] = round(time.perf_counter() - t0, 3)
            print(f"# {name}: {store[name]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_warm_total",
        "value": round(sum(warm.values()), 3),
        "unit": "sec",
        "queries": warm,
        "cold": cold,
        "sf": sf,
        "cpus": int(cpus),
        "spark": pyspark.__version__,
        "driver_memory": spark.conf.get("spark.driver.memory", "default"),
    }))


if __name__ == "__main__":
    main()
