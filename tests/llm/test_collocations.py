import random
import re
from collections import Counter, defaultdict

from fixtures import awkward, awkward_rows, empty
from peerscope.llm import collocations as co


def brute(rows, order, min_count, top):
    f, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for i in range(len(words)):
                for k in range(1, min(order, len(words) - i) + 1):
                    f[lang or "und"][tuple(words[i:i + k])] += 1
    out = set()
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) >= 2 and a >= min_count}
        scored = []
        for p, a in found.items():
            inside = any(len(q) > len(p) and b >= a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                         for q, b in found.items())
            if not inside:
                score, k = min((1000 * a * total[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, left, right, total[lang], -s))
    return out


def got(df):
    rows = df.collect()
    found = {(r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in rows}
    assert len(found) == len(rows)
    return found


def prose(seed, n):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "the", "The", "é", "İ", "x\xa0y", "日本", "w\x1cz"] + [f"w{i}" for i in range(12)]
    texts = []
    for _ in range(n):
        words = [rng.choice(vocabulary) if rng.random() < 0.7 else "one fixed phrase of seven known words"
                 for _ in range(rng.randint(0, 60))]
        texts.append(("".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]) for w in words),
                      rng.choice(["en", "de", None, "und"])))
    return texts


def test_equals_brute_force(spark):
    rows = prose(1, 300) + [("a " * 400, "en"), ("a b " * 200, "de"), (None, "en"), ("", None), ("z z z z z " * 9, "fr")]
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    for order, least, top in ((5, 5, 2000), (5, 40, 20), (3, 2, 50), (2, 10, 2000)):
        assert got(co.collocations(docs, order, least, top)) == brute(rows, order, least, top), (order, least)


def test_a_full_slot_table_changes_nothing(spark, monkeypatch):
    rows = prose(2, 120)
    docs = spark.createDataFrame(rows, "text string, lang string")
    all_bits = (16, co.np.full(1 << 13, 255, dtype=co.np.uint8))
    monkeypatch.setattr(co, "heavy_filter", lambda *a: all_bits)
    assert got(co.collocations(docs, 5, 8)) == brute(rows, 5, 8, 2000)


def test_long_texts_are_cut_at_piece_ends(monkeypatch):
    monkeypatch.setattr(co, "BATCH_BYTES", 50)
    text = b"some words, of a text. " * 20 + b"x" * 200 + b" end"
    parts = list(co._part(text))
    assert b"".join(parts) == text and len(parts) > 5
    assert all(p[-1] in co.PIECE_ENDS for p in parts[:-1])


def test_paths(spark):
    chain = "p q r s t u v w".split()
    ring = "k l m".split() * 3
    edges = [("en", " ".join(chain[i:i + 5]), 7) for i in range(4)]
    edges += [("en", " ".join(ring[i:i + 5]), 9) for i in range(3)]
    edges += [("en", "a a a a a", 3), ("en", "a a a a b", 3), ("de", "p q r s t", 5), ("en", "s t u v x", 2)]
    paths = co.compact_paths(spark.createDataFrame(edges, "lang string, gram string, n long"))
    found = {(r["lang"], " ".join(r["words"]), r["n_edges"], r["n"]) for r in paths.collect()}
    # the node "s t u v" has two edges out: the chain ends there
    want = {("en", "p q r s t u v", 3, 7), ("en", "s t u v w", 1, 7), ("en", "s t u v x", 1, 2), ("de", "p q r s t", 1, 5),
            ("en", "a a a a a", 1, 3), ("en", "a a a a b", 1, 3)}
    assert found == want | {("en", g, 1, 9) for _, g, n in edges if n == 9}


def test_awkward_rows(spark):
    rows = [(r[1], r[2]) for r in awkward_rows()]
    assert got(co.collocations(awkward(spark), 5, 2)) == brute(rows, 5, 2, 2000)
    assert co.collocations(empty(spark)).count() == 0
