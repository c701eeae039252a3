"""peerscope: expert recommendation on Spark.

Rank the authors of a corpus for incoming documents, by TF-IDF and by
dense vectors, with exclusions, author profiles and author similarity.
Everything is expressed with the DataFrame / SQL / Structured Streaming
API so Catalyst and AQE plan the work.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's functions by value.

    Python tasks (mapInPandas, pandas UDFs) then carry the code they call,
    so executors need no installed copy of the package.
    """
    import sys

    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover - pyspark is a hard dependency
        return
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()


# public API --------------------------------------------------------------
from peerscope.functions.text import normalize_text, word_tokens  # noqa: E402
from peerscope.operators.dense import (author_profiles, author_similarity,  # noqa: E402
                                       dense_author_scores, dense_top_papers, recommend_dense,
                                       similar_authors)
from peerscope.operators.encode import hashing_vectors, model_encoder  # noqa: E402
from peerscope.operators.evaluate import compare_methods, evaluate  # noqa: E402
from peerscope.operators.exclusions import excluded_authors, listed_authors  # noqa: E402
from peerscope.operators.extract import concat_pages, extract_text, failed_documents  # noqa: E402
from peerscope.operators.ranking import author_list, rank_authors  # noqa: E402
from peerscope.operators.recommend import (corpus_names, recommend, recommend_tfidf,  # noqa: E402
                                           submission_status)
from peerscope.operators.tfidf import fit_tfidf, sparse_cosine, transform_tfidf  # noqa: E402
from peerscope.sources.corpus import build_corpus, scan_corpus  # noqa: E402
from peerscope.sources.index_io import load_index, save_index  # noqa: E402
from peerscope.sources.sinks import export_csv  # noqa: E402
from peerscope.sources.vectors import (align_by_position, align_vectors,  # noqa: E402
                                       unmatched_ids)
from peerscope.streaming.recommendations import stream_recommendations  # noqa: E402

__all__ = [
    "normalize_text", "word_tokens", "author_profiles", "author_similarity",
    "dense_author_scores", "recommend_dense", "similar_authors", "hashing_vectors",
    "model_encoder", "compare_methods", "evaluate", "corpus_names", "excluded_authors",
    "listed_authors", "concat_pages", "extract_text", "failed_documents", "author_list",
    "rank_authors", "recommend", "recommend_tfidf", "fit_tfidf", "sparse_cosine",
    "transform_tfidf", "build_corpus", "scan_corpus", "load_index", "save_index", "export_csv",
    "align_vectors", "align_by_position", "unmatched_ids", "dense_top_papers",
    "submission_status", "stream_recommendations",
]
