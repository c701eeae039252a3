import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from fixtures import awkward, awkward_rows, empty
from peerscope.llm.bpe import WordBpe, bpe_encode
from peerscope.llm.queries import tokenizer_file
from peerscope.llm.token_store import PieceEncoder, find_tokens, read_tokens, token_checksums, write_tokens

WORD, BYTE = tokenizer_file("word_bpe_49k.json"), tokenizer_file("byte_bpe_50k.json")


def odd_texts():
    rng = random.Random(4)
    wide = [chr(c) for c in [*range(0, 0x250), *range(0x370, 0x400), *range(0x2000, 0x2070)]]
    wide += list("日ꯀ👍ﬁẞअ٠①﻿") + ["é", "ñ", "İ", "Σ"]
    near = list("ab'st re  \n\n\té..12") + ["<|endoftext|>", "<|startoftext|>"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for pool in (wide, near) * 1 for _ in range(600)]
    return texts + ["", " ", "a" * 3000, "'s't re", "x" * 300 + " " + "lorem" * 100]


@pytest.mark.parametrize("path", [WORD])
def test_words_merge_as_the_library_does(path):
    bpe, library = WordBpe(path), Tokenizer.from_file(path)
    texts = odd_texts()
    for text, (ids, decoded) in zip(texts, bpe.encode_batch(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert decoded == library.decode(want, skip_special_tokens=False)


def test_frame(spark):
    library = Tokenizer.from_file(WORD)
    rows = bpe_encode(awkward(spark), WORD).collect()
    want = sorted((r[0], tuple(library.encode(r[1] or "", add_special_tokens=False).ids))
                  for r in awkward_rows() if r[0] is not None)
    got = sorted((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist()))
                 for r in rows if r["doc_id"] is not None)
    assert got == want
    assert bpe_encode(empty(spark), WORD).count() == 0


def test_store_round_trip(spark, tmp_dir):
    library = Tokenizer.from_file(BYTE)
    texts = odd_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(len(texts), None), (7, "again"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    write_tokens(docs, f"{tmp_dir}/store", BYTE)
    stored = read_tokens(spark, f"{tmp_dir}/store")
    got = sorted(stored.collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted([r[0] for r in rows], key=lambda x: (x is not None, x or 0))
    place = 0
    for r in got:
        assert r["start"] == place and r["n_tokens"] == len(r["ids"]) and r["ids"][-1] == 2
        place += r["n_tokens"]
    by_id = {(r["doc_id"], tuple(r["ids"])) for r in got}
    assert by_id == {(i, (*library.encode(t or "", add_special_tokens=False).ids, 2)) for i, t in rows}
    sums = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in token_checksums(stored).collect()}
    for r in got:
        assert sums[r["doc_id"], r["start"]] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    assert {r["doc_id"] for r in find_tokens(spark, f"{tmp_dir}/store", [3, 9]).collect()} == {3, 9}


@pytest.mark.parametrize("most,most_bytes", [(600_000, 32_000_000), (40, 32_000_000), (600_000, 60), (0, 0)])
def test_remembered_pieces_change_no_ids(most, most_bytes):
    library, texts = Tokenizer.from_file(BYTE), odd_texts()
    encoder = PieceEncoder(BYTE, most, most_bytes)
    for _ in range(2):
        for i in range(0, len(texts), 37):
            some = texts[i:i + 37]
            flat, n = encoder.encode_batch(some, np.array([2], "<u4").tobytes())
            assert len(encoder.known) <= most and len(encoder.known) == len(encoder.known_n)
            for text, ids in zip(some, np.split(flat, np.cumsum(n)[:-1])):
                assert ids.tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]


def test_empty_store(spark, tmp_dir):
    write_tokens(empty(spark), f"{tmp_dir}/store", BYTE)
    assert token_checksums(read_tokens(spark, f"{tmp_dir}/store")).count() == 0
