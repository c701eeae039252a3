"""Toxic passages by maximum-scoring segment search over token log-odds.

Every token has a score: its log-odds between toxic and clean documents, counted
once per document, under a Dirichlet prior (a part by the token's share of all
tokens, and one document of either kind, so that rare words say little), less a margin that makes the expected score of clean text negative.
One linear scan finds all maximal scoring segments of a text. A segment counts as much as
its best stretch, in which a word that speaks against the text counts once and its repeats
are neutral; what is said elsewhere in the text changes nothing. On clean text the
best segment of n tokens follows an extreme-value law, P(S >= x) = 1 - exp(-K n
exp(-lambda x)); lambda solves sum p exp(lambda s) = 1 over the clean tokens unless the best
segments of clean documents have a heavier tail, and K is fitted to those. Segments with a small expected
number of chance occurrences are the toxic passages. A document's evidence
(the tail probability of its best segment and the summed excess of its passages)
becomes a probability by logistic regression on documents that the
log-odds were not learnt from.

Learning reads a bounded sample: at most ``max_per_class`` labelled documents
of each class, chosen by a hash of doc_id; the base rate is that of all labels.
Rows of the held-out fold are never learnt from.

Defined results: null, empty or letterless text has no passage and the score of no
evidence; with no label of one class every score is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from peerscope.llm.common import free_name, hash_below, held_out, release_memory, written

MAX_PER_CLASS = 10_000     # labelled documents of each class that are learnt from
MAX_TOKENS = 200_000       # tokens that the model keeps
_PREFIXES = (6, 5, 4)      # leading characters that stand in for a word too rare to know
_MIN_COUNT = 3
_PRIOR_TOKENS = 2_000.0    # weight of the prior, in tokens
_MARGIN = 0.7
_CACHE_PIECES = 100_000
_LETTERS = re.compile(r"[^\W\d_]+")
THRESHOLD = 0.3


@dataclass
class ToxicityModel:
    scores: dict[str, float]
    lam: float = 1.0
    k: float = 0.1
    weights: tuple[float, float, float] = (-30.0, 0.0, 0.0)
    max_evalue: float = 0.05

    def usable(self) -> bool:
        return bool(self.scores)


def _names(word: str) -> list[str]:
    """A word as itself and by its leading characters, most telling first."""
    return [word] + [f"{word[:n]}*" for n in _PREFIXES if len(word) > n]


class PieceScores(dict):
    """white-space-free piece of text -> score of its words; forgets all when full."""

    def __init__(self, known: dict[str, float]):
        super().__init__()
        self.known, self.unknown = known, known.get("", -_MARGIN)

    def word(self, word: str) -> float:
        return next((self.known[n] for n in _names(word) if n in self.known), self.unknown)

    def __missing__(self, piece: str) -> float:
        if len(self) >= _CACHE_PIECES:
            self.clear()
        value = self[piece] = sum(map(self.word, _LETTERS.findall(piece.lower())), 0.0)
        return value


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, sum) of a score sequence, in linear time.

    Positive scores enter from left to right as segments with the sums left of
    them and up to their end; a new segment is joined to the last one that starts
    lower, when it also ends higher, and everything in between (each positive
    score joins once, so the scan is linear).
    """
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    open_segments: list[list[float]] = []      # start, end, left sum, right sum, lower neighbour
    for i, left, right in zip(at.tolist(), sums[at].tolist(), sums[at + 1].tolist()):
        start, end = i, i + 1
        while True:
            j = len(open_segments) - 1
            while j >= 0 and open_segments[j][2] >= left:
                j = int(open_segments[j][4])
            if j < 0 or open_segments[j][3] >= right:
                break
            start, left = int(open_segments[j][0]), open_segments[j][2]
            del open_segments[j:]
        open_segments.append([start, end, left, right, j])
    return [(int(s), int(e), right - left) for s, e, left, right, _ in open_segments]


def _features(segments: list[tuple[int, int, float]], n: int, model: ToxicityModel) -> tuple[float, float]:
    """Evidence of a document: -log of the best segment's tail probability, and the passages' excess."""
    if not segments or not n:
        return 0.0, 0.0
    base = math.log(model.k * n) if model.k * n > 0 else 0.0
    excess = [model.lam * s - base for _, _, s in segments]
    best = max(excess)
    chance = math.exp(-best) if best > -700 else math.inf
    tail = best if best > 30 else -math.log(-math.expm1(-chance)) if chance < 700 else 0.0
    limit = -math.log(model.max_evalue)
    return min(tail, 60.0), math.log1p(sum(x for x in excess if x > limit))


def _logistic(x: tuple[float, float], weights: tuple[float, float, float]) -> float:
    z = weights[0] + weights[1] * x[0] + weights[2] * x[1]
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _best_stretch(words: list[str], scores: np.ndarray) -> float:
    """The largest sum of a stretch in which every positive word counts once, repeats as 0.

    ``sums[i]`` is the sum of the stretch from the i-th positive word up to the current
    one, less the negative scores left of either. A word adds to the stretches that start after
    its last occurrence. Stretches lie in blocks with an addend and a maximum each, so
    a word costs the square root of the number of words.
    """
    at = np.flatnonzero(scores > 0)
    n, width = len(at), max(64, math.isqrt(len(at)))
    cost = np.cumsum(np.minimum(scores, 0))[at]      # negative scores left of each positive word
    sums = np.full(-(-n // width) * width, -np.inf)
    added, top = np.zeros(len(sums) // width), np.full(len(sums) // width, -np.inf)
    last: dict[str, int] = {}
    best = 0.0
    for j, (i, left) in enumerate(zip(at.tolist(), cost.tolist())):
        block = j // width
        sums[j] = -left - added[block]
        lo, gain = last.get(words[i], -1) + 1, scores[i]
        last[words[i]] = j
        first = lo // width
        if first == block:
            sums[lo:j + 1] += gain
        else:
            sums[lo:(first + 1) * width] += gain
            top[first] = sums[first * width:(first + 1) * width].max() + added[first]
            added[first + 1:block] += gain
            top[first + 1:block] += gain
            sums[block * width:j + 1] += gain
        top[block] = sums[block * width:j + 1].max() + added[block]
        best = max(best, float(top[:block + 1].max()) + left)
    return best


def _text_segments(text: str | None, pieces: PieceScores) -> tuple[list[str], list[tuple[int, int, float]]]:
    """The words of a text and its maximal segments, each with the sum of its best stretch."""
    words = text.split() if text else []
    scores = np.fromiter(map(pieces.__getitem__, words), np.float64, len(words))
    segments = []
    for start, end, total in maximal_segments(scores):
        own = words[start:end]
        if end - start > 1 and len(set(own)) < len(own):
            total = _best_stretch(own, scores[start:end])
        segments.append((start, end, total))
    return words, segments


# -- learning -------------------------------------------------------------------

def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[bool, bool], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (toxic, second), (c, d) in counts.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), pa.string()), pa.array([toxic] * len(c)), pa.array([second] * len(c)),
                 pa.array(list(c.values()), pa.int64()), pa.array([d[t] for t in c], pa.int64())],
                names=["token", "toxic", "second", "n", "docs"])
        counts.clear()

    for batch in batches:
        for text, toxic, second in zip(*(c.to_pylist() for c in batch.columns)):
            words = Counter(_LETTERS.findall((text or "").lower()))
            total, docs = counts.setdefault((bool(toxic), bool(second)), (Counter(), Counter()))
            for word, n in words.items():
                for name in _names(word):
                    total[name] += n
            docs.update({name for word in words for name in _names(word)})
            total[""] += sum(words.values())
            docs[""] += len(words)
        if sum(len(c) for c, _ in counts.values()) > 150_000:
            yield from flush()
    yield from flush()
    release_memory()


def _log_odds(rows: Iterable[tuple[str, int, int]], tokens: tuple[int, int]) -> dict[str, float]:
    """Dirichlet-smoothed log-odds less the margin; the word "" stands for unknown words."""
    n_toxic, n_clean = tokens
    out = {"": -_MARGIN}
    for token, toxic, clean in rows:
        prior = 1.0 + _PRIOR_TOKENS * (toxic + clean) / (n_toxic + n_clean)
        a, b = toxic + prior, clean + prior
        rest_a, rest_b = n_toxic + _PRIOR_TOKENS - a, n_clean + _PRIOR_TOKENS - b
        if a > 0 and b > 0 and rest_a > 0 and rest_b > 0:
            out[token] = math.log(a / rest_a) - math.log(b / rest_b) - _MARGIN
    return out


def _solve_lambda(scores: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1 (the expected score is negative)."""
    low, high = 0.0, 1e-3
    if not (scores > 0).any():
        return 1.0
    value = lambda x: float((shares * np.exp(np.minimum(x * scores, 500))).sum())
    while value(high) < 1 and high < 100:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 1 else (low, mid)
    return high


def _fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps; slopes are kept from going negative."""
    design = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    ridge = np.diag([1e-3, 1e-2, 1e-2]) * max(1.0, weight.sum() / 100)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        gradient = design.T @ (weight * (y - p)) - ridge @ w
        hessian = (design * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ design + ridge
        step = np.linalg.solve(hessian, gradient)
        w = w + step / max(1.0, float(np.abs(step).max()) / 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), max(0.0, float(w[1])), max(0.0, float(w[2]))


def _token_scores(counts: DataFrame, second: bool | None) -> dict[str, float]:
    """Log-odds of the ``MAX_TOKENS`` most frequent tokens."""
    part = counts if second is None else counts.where(F.col("second") == second)
    sums = part.groupBy("token").agg(F.sum(F.when(F.col("toxic"), F.col("docs")).otherwise(0)).alias("t"),
                                     F.sum(F.when(~F.col("toxic"), F.col("docs")).otherwise(0)).alias("c"))
    total = sums.where("token = ''").first()
    if total is None or not total["t"] or not total["c"]:
        return {}
    rows = (sums.where((F.col("token") != "") & (F.col("t") + F.col("c") >= _MIN_COUNT))
            .orderBy(F.desc(F.col("t") + F.col("c")), "token").limit(MAX_TOKENS)
            .toArrow())
    odds = _log_odds(zip(*(rows[c].to_pylist() for c in ("token", "t", "c"))), (total["t"], total["c"]))
    del rows
    release_memory()
    return odds


def _measure(scores: dict[str, float]):
    """Task function: (toxic, tokens, best segment, all segment scores) of each calibration document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceScores(scores)
        for batch in batches:
            toxic, n, segments = [], [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words, found = _text_segments(text, pieces)
                toxic.append(bool(label))
                n.append(len(words))
                segments.append([x for _, _, x in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(toxic), pa.array(n, pa.int64()), pa.array(segments, pa.list_(pa.float64()))],
                names=["toxic", "n", "segments"])
    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> ToxicityModel:
    """Learn from the labelled rows outside the held-out fold (see the module text)."""
    marks = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
             .where(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic")))
    rates = {row["toxic"]: row["count"] for row in marks.groupBy("toxic").count().collect()}
    if not rates.get(True) or not rates.get(False):
        return ToxicityModel({})
    # of a large class, only rows with small hashes are sorted: about twice as many as are wanted
    chosen = [marks.where((F.col("toxic") == flag) & hash_below(F.col("doc_id"), (2 * max_per_class + 200) / rates[flag]))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class) for flag in (True, False)]
    # at most 2 * max_per_class rows of two numbers are broadcast
    sample = F.broadcast(chosen[0].union(chosen[1]))
    second = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0
    text = docs.select("doc_id", "text").join(sample, "doc_id")
    counts = text.select("text", "toxic", second.alias("second")).mapInArrow(
        _count_tokens, "token string, toxic boolean, second boolean, n long, docs long")
    counts = counts.groupBy("token", "toxic", "second").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = written(counts, "toxicity-tokens")

    # calibration: log-odds from two thirds of the sample, evidence on the last third
    partial = _token_scores(counts, False)
    if not partial:
        return ToxicityModel({})
    measured = (text.where(second).select("text", "toxic")
                .mapInArrow(_measure(partial), "toxic boolean, n long, segments array<double>").toArrow())
    model = ToxicityModel(partial)
    clean = counts.where((F.col("token") != "") & ~F.col("token").endswith("*") & ~F.col("toxic")) \
                  .groupBy("token").agg(F.sum("n").alias("n")) \
                  .orderBy(F.desc("n"), "token").limit(MAX_TOKENS).toArrow()
    pieces = PieceScores(partial)
    values = np.array([pieces.word(w) for w in clean["token"].to_pylist()])
    shares = clean["n"].to_numpy().astype(float)
    del clean, pieces
    release_memory()
    model.lam = _solve_lambda(values, shares / max(1.0, shares.sum()))
    y, n = np.array(measured["toxic"].to_pylist(), bool), measured["n"].to_numpy()
    segments = measured["segments"].to_pylist()
    del measured
    quiet = np.flatnonzero(~y & (n > 0))
    best = np.array([max(segments[i], default=0.0) for i in quiet])
    if len(best):
        # words the sample does not know well are noisier than the model says: the law may not
        # fall faster than the tail of the best segments, and K makes one in ten exceed the 9th decile
        decile, tail = np.quantile(best, [0.9, 0.99])
        if tail > decile:
            model.lam = min(model.lam, math.log(10) / (tail - decile))
        model.k = float(-math.log(0.9) * math.exp(min(model.lam * decile, 50)) / np.median(n[quiet]))
    model.k = min(1.0, max(1e-6, model.k))
    x = np.array([_features([(0, 0, v) for v in found], words, model)
                  for found, words in zip(segments, n.tolist())]).reshape(-1, 2)
    if not y.any() or y.all():
        return ToxicityModel({})
    # classes weigh as in all labels
    share = {flag: rates[flag] / sum(rates.values()) for flag in (True, False)}
    weight = np.where(y, share[True] / y.mean(), share[False] / (1 - y.mean()))
    model.weights = _fit_logistic(x, y.astype(float), weight)
    del segments, model.scores, partial
    model.scores = _token_scores(counts, None)
    return model


# -- scoring --------------------------------------------------------------------

def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text",
                   out_col: str = "score") -> DataFrame:
    """``docs`` with its columns and the probability of being toxic added."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = ToxicityModel(**shared.value)
        pieces = PieceScores(m.scores)
        for column in columns:
            out = []
            for text in column:
                if not m.usable():
                    out.append(0.0)
                    continue
                words, segments = _text_segments(text.as_py(), pieces)
                out.append(_logistic(_features(segments, len(words), m), m.weights))
            yield pa.array(out, pa.float64())
        release_memory()

    # only the text goes to Python and only the score comes back
    return docs.withColumn(out_col, F.arrow_udf(run, DoubleType())(F.col(text_col)))


def toxic_passages(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """(doc_id, first_word, n_words, passage, score, evalue) of every significant passage."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = ToxicityModel(**shared.value)
        pieces = PieceScores(m.scores)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words, segments = _text_segments(text.as_py(), pieces)
                for start, end, s in segments:
                    chance = m.k * len(words) * math.exp(-m.lam * s)
                    if chance <= m.max_evalue:
                        rows.append((doc_id, start, end - start, " ".join(words[start:end]), s, chance))
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "first_word", "n_words", "passage", "score", "evalue"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col).mapInArrow(
        run, "doc_id long, first_word long, n_words long, passage string, score double, evalue double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not predicted toxic, with their columns."""
    name = free_name(docs, "_toxicity")
    scored = score_toxicity(docs, fit_toxicity(docs, labels), out_col=name)
    return scored.where(F.col(name) < threshold).select(*docs.columns)
