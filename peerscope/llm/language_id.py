"""Language identification by a bidirectional gated recurrent network over bytes.

Two GRUs read the bytes of a text window in both directions; at every byte a
softmax layer over both states labels the position with a language. A
document's probabilities are the mean over all its positions. Texts are read whole, in
windows of ``WINDOW`` bytes that go through the network side by side.

The network is trained in numpy by backpropagation through time (Adam,
cross-entropy at every position) on a bounded sample: ``PER_LANGUAGE`` documents of
each language, ``MAX_SAMPLE`` in all, chosen by a hash of doc_id, and ``CUTS`` windows
of each, spread over its text. Every lang value is learnt; units and steps
grow with their number.

Defined results: null, empty or letterless text is ``und`` with score 0; so is
everything when no label was learnt; ties go to the smaller language value.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from peerscope.llm.bpe import text_chunks
from peerscope.llm.common import hash_below, held_out

HIDDEN = 8              # units a direction, for up to 16 languages
WINDOW = 128
PER_LANGUAGE = 400      # documents of a language that are learnt from
MAX_SAMPLE = 80_000     # documents of all languages: with many languages, fewer of each
STEPS = 300
CUTS = 4
CUT_BYTES = 64
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
_BLOCK = 2048
_CHUNK_BYTES = 2_000_000


def units(classes: int) -> int:
    """Units a direction: they grow with the number of languages."""
    return min(64, max(HIDDEN, 2 * math.ceil(math.sqrt(classes))))


class ByteGru:
    """Both directions and the labelling layer; parameters are float32 arrays in a dict.

    Per direction d: in_d (256, 3H) input weights by byte, rec_d (H, 3H) recurrent
    weights, bias_d (3H), in the order update gate, reset gate, candidate; out_d (H, C).
    """

    def __init__(self, classes: int, hidden: int | None = None, seed: int = 3, params: dict | None = None):
        rng = np.random.default_rng(seed)
        if params is not None:
            hidden = len(params["rec_f"])
        self.h = hidden = hidden or units(classes)
        if params is None:
            params = {"bias": np.zeros(classes)}
            for d in "fb":
                params[f"in_{d}"] = rng.normal(0, 0.3, (256, 3 * hidden))
                params[f"rec_{d}"] = rng.normal(0, 0.6 / hidden ** 0.5, (hidden, 3 * hidden))
                params[f"bias_{d}"] = np.zeros(3 * hidden)
                params[f"out_{d}"] = rng.normal(0, 0.3, (hidden, classes))
        self.p = {k: np.asarray(v, np.float32) for k, v in params.items()}

    def _step(self, d: str, x: np.ndarray, h: np.ndarray):
        k = self.h
        gx = self.p[f"in_{d}"][x]
        gx += self.p[f"bias_{d}"]
        gh = h @ self.p[f"rec_{d}"]
        gates = gx[:, :2 * k] + gh[:, :2 * k]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates += 1.0
        gates *= 0.5                       # the logistic function
        z, r = gates[:, :k], gates[:, k:]
        n = gx[:, 2 * k:] + r * gh[:, 2 * k:]
        np.tanh(n, out=n)
        return n + z * (h - n), z, r, n, gh[:, 2 * k:]

    def logits(self, x: np.ndarray, filled: np.ndarray | None = None) -> np.ndarray:
        """(T, B) bytes -> (T, B, C) label scores of every position.

        ``filled``: bytes of each column that are text; the rest is padding, and
        the backward state is zero until the text begins.
        """
        ends = [] if filled is None else np.flatnonzero(filled < len(x))
        steps, width = x.shape
        out = np.empty((steps, width, len(self.p["bias"])), np.float32)
        out[:] = self.p["bias"]
        for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            h = np.zeros((width, self.h), np.float32)
            for t in order:
                h = self._step(d, x[t], h)[0]
                if d == "b" and len(ends):
                    h[ends[filled[ends] <= t]] = 0.0
                out[t] += h @ self.p[f"out_{d}"]
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy of all positions and its gradients, through time."""
        steps, width = x.shape
        k, p = self.h, self.p
        trace = {}
        logits = np.zeros((steps, width, len(p["bias"])), np.float32) + p["bias"]
        orders = {"f": list(range(steps)), "b": list(range(steps - 1, -1, -1))}
        for d, order in orders.items():
            h, kept = np.zeros((width, k), np.float32), []
            for t in order:
                before = h
                h, z, r, n, gh = self._step(d, x[t], h)
                keep = mask[t][:, None]
                h = np.where(keep, h, before)
                kept.append((before, z, r, n, gh, h))
                logits[t] += h @ p[f"out_{d}"]
            trace[d] = kept
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=2, keepdims=True)
        count = max(1, int(mask.sum()))
        pick = np.take_along_axis(prob, y[None, :, None].repeat(steps, 0), 2)[:, :, 0]
        loss = float(-(np.log(np.maximum(pick, 1e-9)) * mask).sum() / count)
        delta = prob
        np.put_along_axis(delta, y[None, :, None].repeat(steps, 0), pick[:, :, None] - 1, 2)
        delta *= mask[:, :, None] / count
        g = {name: np.zeros_like(v) for name, v in p.items()}
        g["bias"] = delta.sum(axis=(0, 1))
        for d, order in orders.items():
            dh = np.zeros((width, k), np.float32)
            for t, (before, z, r, n, gh, h) in zip(order[::-1], trace[d][::-1]):
                g[f"out_{d}"] += h.T @ delta[t]
                dh = dh + delta[t] @ p[f"out_{d}"].T
                keep = mask[t][:, None]
                now = dh * keep
                dn = now * (1 - z) * (1 - n * n)
                dz = now * (before - n) * z * (1 - z)
                dr = dn * gh * r * (1 - r)
                dx = np.concatenate([dz, dr, dn], axis=1)
                rec = np.concatenate([dz, dr, dn * r], axis=1)
                np.add.at(g[f"in_{d}"], x[t], dx)
                g[f"bias_{d}"] += dx.sum(axis=0)
                g[f"rec_{d}"] += before.T @ rec
                dh = np.where(keep, now * z + rec @ p[f"rec_{d}"].T, dh)
        return loss, g


def train(windows: list[bytes], labels: list[int], classes: int, steps: int | None = None, width: int = 96,
          rate: float = 0.03, seed: int = 5) -> ByteGru:
    """Adam over random minibatches that draw every class equally often."""
    net, rng = ByteGru(classes), np.random.default_rng(seed)
    steps = steps or STEPS * min(4, math.ceil(classes / 64))
    y = np.array(labels)
    longest = max(map(len, windows))
    x = np.zeros((len(windows), longest), np.uint8)
    mask = np.zeros((len(windows), longest), bool)
    for i, w in enumerate(windows):
        x[i, :len(w)] = np.frombuffer(w, np.uint8)
        mask[i, :len(w)] = True
    share = 1.0 / np.bincount(y, minlength=classes)[y]
    share /= share.sum()
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, steps + 1):
        rows = rng.choice(len(windows), width, p=share)
        _, g = net.gradients(x[rows].T, y[rows], mask[rows].T)
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, v in g.items():
            v = v * min(1.0, 1.0 / max(norm, 1e-9))
            first[k] += 0.1 * (v - first[k])
            second[k] += 0.01 * (v * v - second[k])
            net.p[k] -= (pace * (first[k] / (1 - 0.9 ** step))
                         / (np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return net


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of sampled documents, spread evenly over the whole text."""
    for batch in batches:
        cuts, langs = [], []
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            starts = {i * max(0, len(raw) - CUT_BYTES) // max(1, CUTS - 1) for i in range(CUTS)}
            for start in sorted(starts):
                if raw:
                    cuts.append(raw[start:start + CUT_BYTES])
                    langs.append(lang)
        yield pa.RecordBatch.from_arrays([pa.array(cuts, pa.binary()), pa.array(langs, pa.string())],
                                         names=["window", "lang"])


def fit_language(docs: DataFrame, per_language: int = PER_LANGUAGE, max_sample: int = MAX_SAMPLE) -> dict:
    """Train on documents with a lang outside the held-out fold: {"languages", "params"}.

    Every lang value of these documents is learnt, from ``per_language`` documents
    each, ``max_sample`` in all (one of each value at least).
    """
    known = (docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull()
                        & F.col("doc_id").isNotNull())
             .where(~held_out(F.col("doc_id"))))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    found = counts.count()
    per_language = max(1, min(per_language, max_sample // max(1, found)))
    # of a large language, only rows with small hashes are numbered: about twice as many as are wanted
    few = known.join(counts, "lang").where(hash_below(F.col("doc_id"), F.lit(2.0 * per_language + 200) / F.col("n")))
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = (few.withColumn("turn", F.row_number().over(by_hash)).where(F.col("turn") <= per_language)
              .select("text", "lang"))
    sample = picked.mapInArrow(_cut, "window binary, lang string").toPandas()
    sample = sample.sort_values(["lang", "window"], ignore_index=True)   # rows come in any order
    languages = sorted(set(sample["lang"]))
    if not languages:
        return {"languages": [], "params": None}
    index = {lang: i for i, lang in enumerate(languages)}
    net = train([bytes(w) for w in sample["window"]], [index[x] for x in sample["lang"]], len(languages))
    return {"languages": languages, "params": net.p}


def text_probabilities(net: ByteGru, texts: list[bytes]) -> np.ndarray:
    """(texts, C): mean label probabilities over all bytes of each text."""
    lengths = np.array([len(t) for t in texts])
    windows = -(-lengths // WINDOW)
    owner = np.repeat(np.arange(len(texts)), windows)
    padded = b"".join(t + bytes(int(w) * WINDOW - len(t)) for t, w in zip(texts, windows))
    grid = np.frombuffer(padded, np.uint8).reshape(-1, WINDOW)
    firsts = np.repeat(np.cumsum(windows) - windows, windows)
    filled = np.minimum(WINDOW, lengths[owner] - (np.arange(len(grid)) - firsts) * WINDOW)
    total = np.zeros((len(texts), len(net.p["bias"])))
    block = max(32, min(_BLOCK, 16 * _BLOCK // len(net.p["bias"])))
    for at in range(0, len(grid), block):
        x, n = grid[at:at + block].T, filled[at:at + block]
        scores = np.exp(net.logits(np.ascontiguousarray(x), n))
        scores /= scores.sum(axis=2, keepdims=True)
        scores *= (np.arange(WINDOW)[:, None] < n)[:, :, None]
        np.add.at(total, owner[at:at + block], scores.sum(axis=0))
    return total / np.maximum(lengths, 1)[:, None]


def label_positions(net: ByteGru, text: str) -> np.ndarray:
    """The label index of every byte of a text."""
    raw = text.encode("utf-8", "surrogatepass")
    labels = [net.logits(np.frombuffer(raw[i:i + WINDOW], np.uint8)[:, None])[:, 0].argmax(axis=1)
              for i in range(0, len(raw), WINDOW)]
    return np.concatenate(labels) if labels else np.empty(0, int)


def predict_language(docs: DataFrame, model: dict, text_col: str = "text",
                     lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the language and its probability added (columns of these names are replaced)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in (lang_col, score_col)]
    at = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, params = shared.value["languages"], shared.value["params"]
        net = ByteGru(len(languages), params=params) if languages else None
        for batch in batches:
            for i, j, texts in text_chunks(batch.column(at), _CHUNK_BYTES):
                lang, score = [UNDETERMINED] * (j - i), [0.0] * (j - i)
                real = [k for k, t in enumerate(texts) if net and t and _LETTER.search(t)]
                if real:
                    prob = text_probabilities(net, [texts[k].encode("utf-8", "surrogatepass")
                                                    for k in real])
                    for k, row in zip(real, prob):
                        best = int(row.argmax())
                        lang[k], score[k] = languages[best], min(1.0, float(row[best]))
                yield pa.RecordBatch.from_arrays(
                    [c.slice(i, j - i) for c in batch.columns]
                    + [pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                    names=[*kept, lang_col, score_col])

    schema = StructType([*(docs.schema[c] for c in kept), StructField(lang_col, StringType()),
                         StructField(score_col, DoubleType())])
    return docs.select(*kept).mapInArrow(run, schema)
