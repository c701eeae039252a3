import random

import pytest
import sentencepiece
from fixtures import awkward, awkward_rows, empty
from peerscope.llm.queries import tokenizer_file
from peerscope.llm.token_counts import MARK, PieceModel, TokenCounter, token_counts

MODEL = tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return PieceModel(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_proved_pieces_are_one_token_in_the_library(model, library):
    whole = model.whole_tokens()
    assert len(whole) > 1000
    for piece in model.scores:
        if piece.startswith(MARK) and piece != MARK:
            alone = library.encode(piece.replace(MARK, " ")[1:], out_type=str) == [piece]
            assert alone == (piece in whole)


def test_counts_equal_the_library(model, library):
    rng = random.Random(5)
    wide = [chr(c) for c in [*range(0, 0x250), *range(0x370, 0x400), *range(0x2000, 0x2070), 0x2581]]
    wide += list("日本👍ﬁẞ한국") + [" "] * 40
    near = list("abcdefghi st  \n\t..") + ["<s>", "</s>", "<0x0A>", "<unk>", MARK, " " * 17, " " * 33]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 80))) for pool in (wide, near) for _ in range(800)]
    texts += ["", " ", "  ", "a" * 3000, " " * 1000 + "x", "ab" * 400 + " z " + "lorem" * 100, "the of and"]
    counts = TokenCounter(MODEL, model.whole_tokens()).of_texts(texts)
    assert counts.tolist() == [len(ids) for ids in library.encode(texts)]


def test_whole_words_are_never_merged(model, library, monkeypatch):
    counter = TokenCounter(MODEL, model.whole_tokens())
    monkeypatch.setattr(counter.model, "count", lambda word: pytest.fail(word))
    assert counter.of_texts(["the man in the house"]).tolist() == [5] == [len(library.encode("the man in the house"))]


def test_short_and_long_merges_agree(model):
    rng = random.Random(6)
    for _ in range(300):
        word = MARK * rng.randint(1, 30) + "".join(rng.choice("abcdetionsrh") for _ in range(rng.randint(0, 30)))
        assert model._merge_short(word) == model._merge_long(word)


def test_frame(spark, library):
    rows = token_counts(awkward(spark).withColumns({}), MODEL, limit=5).collect()
    want = []
    for r in awkward_rows():
        n = len(library.encode(r[1] or ""))
        want.append((r[0] if r[0] is not None else -1, len((r[1] or "").encode()), n, n > 5))
    got = [(r["doc_id"] if r["doc_id"] is not None else -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows]
    assert sorted(got) == sorted(want)
    assert token_counts(empty(spark), MODEL).count() == 0


def test_clashing_columns_are_replaced(spark, library):
    docs = spark.createDataFrame([(1, "a b", 9, 9, "x")], "doc_id long, text string, n_tokens int, n_bytes int, text_to_count string")
    row = token_counts(docs, MODEL).first()
    assert (row["n_bytes"], row["n_tokens"], row["text_to_count"]) == (3, len(library.encode("a b")), "x")


def test_other_models_are_refused(tmp_path):
    with open(MODEL, "rb") as f:
        raw = f.read()
    broken = tmp_path / "identity.model"
    broken.write_bytes(raw.replace(b"identity", b"nmt_nfkc", 1).replace("▁t".encode(), "t▁".encode(), 1))
    with pytest.raises(ValueError):
        PieceModel(str(broken))
