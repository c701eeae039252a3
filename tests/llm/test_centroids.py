import hashlib
import math
import random

import numpy as np
import pytest

from peerscope.llm import centroids as ce

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance int, ints string"


def brute(rows, components, clusters, rounds, seed=2):
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
            if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cent = [v for _, v in start[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cent))

    for _ in range(rounds):
        members = [[] for _ in cent]
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        cent = [[sum(x) // len(m) for x in zip(*m)] if m else c for m, c in zip(members, cent)]
    found = [(i, *nearest(v)) for i, v in kept]
    per = [sum(d for _, d, c in found if c == j) for j in range(len(cent))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cent]
    return sorted((-1 if i is None else i, c, d, per[c], sum(per), names[c]) for i, d, c in found)


def rows_of(n, components, seed, centres=6):
    rng = random.Random(seed)
    middle = [[rng.uniform(-1, 1) for _ in range(components)] for _ in range(centres)]
    return [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(middle)]) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], SCHEMA).repartition(3)


def got(spark, rows, components, **kw):
    vectors = ce.integer_vectors(frame(spark, rows), components)
    return sorted((-1 if r["vec_id"] is None else r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"],
                   r["inertia"], r["centroid_sha256"]) for r in ce.centroid_clusters(vectors, **kw).collect())


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ce, "BLOCK_ROWS", 37)
    rows = rows_of(400, 8, 1)
    rows += [(None, rows[0][1]), (500, None), (501, [0.5] * 7), (502, [None] + [0.5] * 7), (503, [float("nan")] * 8),
             (504, [float("inf")] + [0.0] * 7), (505, [0.0] * 8), (506, []), (3, rows[3][1]), (3, rows[9][1]),
             (507, [3e4] * 8), (508, [-3e4] * 8)] + [(600 + i, [0.25] * 8) for i in range(60)]
    for clusters, rounds in ((12, 5), (1, 2), (3, 0), (40, 3)):
        assert got(spark, rows, 8, clusters=clusters, rounds=rounds) == brute(rows, 8, clusters, rounds)


def test_few_or_no_vectors(spark):
    rows = rows_of(5, 4, 2)
    assert got(spark, rows, 4) == brute(rows, 4, 40, 5)
    assert got(spark, [(1, [1.0])], 4) == []
    with pytest.raises(ValueError):
        got(spark, [(None, [1.0] * 4)], 4)
    with pytest.raises(Exception, match="component too large"):
        got(spark, [(1, [1e30] * 4)], 4)


def test_only_expired_vectors_are_scanned():
    """Later rounds scan few vectors, and every skipped one still has its nearest centroid."""
    rng = np.random.default_rng(3)
    middle = rng.integers(-300, 300, (10, 16))
    x = middle[rng.integers(0, 10, 4000)] + rng.integers(-20, 20, (4000, 16))
    cent, drift, scanned = x[:10].copy(), np.zeros(10), []
    block = ce.Block.new(np.arange(4000), np.ones(4000, bool), x, cent)
    for _ in range(12):
        block.assign(cent, drift)
        block = ce.Block.unpack(block.pack(), 16)
        d = ce.distances(x, cent)
        assert (block.cluster == d.argmin(1)).all()
        moved = cent.copy()
        for c in range(10):
            if (block.cluster == c).any():
                moved[c] = x[block.cluster == c].sum(0) // (block.cluster == c).sum()
        step = np.sqrt(((moved - cent) ** 2).sum(1))
        others = np.array([np.delete(step, c).max() for c in range(10)])
        drift, cent = drift + (step + others) * (1 + ce.SLACK), moved
        probe = ce.Block.unpack(block.pack(), 16)
        probe.assign(cent, drift)
        scanned.append(probe.scanned)
    assert scanned[-1] < 400 and min(scanned) < 4000


def test_large_components_stay_exact():
    rng = np.random.default_rng(4)
    x, c = rng.integers(-2**24, 2**24, (50, 64)), rng.integers(-2**24, 2**24, (5, 64))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)) for w in c] for v in x]
    assert ce.distances(x, c).tolist() == want
