"""Token ids and decoded texts against the public library of the vocabulary."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from reportmill.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def cases():
    rnd = random.Random(3)
    kinds = [lambda: rnd.randrange(32, 127), lambda: rnd.randrange(0, 0x500), lambda: rnd.randrange(0x2000, 0x3100), lambda: rnd.randrange(0x1F600, 0x1F640)]
    odd = ["".join(chr(rnd.choice(kinds)()) for _ in range(rnd.randrange(1, 40))) for _ in range(500)]
    return [
        "", "a", "hello's WORLD don't we'll <|endoftext|>x<|startoftext|>", "<|endoftext|><|endoftext|", "ΑΣ Σ ΟΔΟΣ", "İstanbul ß ẞ", "é café",
        "x\x1cy\x85z　w", "日本語テキスト 😀👍🏽 123 ½ ²", "a" * 5000, "abc" * 3000 + "é" * 300, "\x00\x01 � ​ x", "thnnthsh " * 2000, *odd,
    ]


def test_ids_and_texts_match_the_library(spark, library):
    rows = list(enumerate(cases()))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for r in bpe.decode(bpe.encode(frame, PATH), PATH).collect():
        want = library.encode(rows[r["id"]][1], add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == want
        assert r["n_tokens"] == len(want)
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)


def test_long_texts_are_cut_between_pieces(library, monkeypatch):
    monkeypatch.setattr(bpe, "_TEXT_PART", 50)
    text = "don't stop the thnnthsh, 42 times <|endoftext|> " * 40
    got = bpe.Encoder(bpe.read_model(PATH)).encode(text)
    assert np.frombuffer(got, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_a_boundary_never_splits_a_token(library):
    tool = bpe.Encoder(bpe.read_model(PATH))
    for token in list(library.get_vocab())[::97]:
        word = token.removesuffix("</w>")
        if token.endswith("</w>") and word.isascii() and word.isalpha():
            assert tool.boundaries(word.encode()) == []


def test_nulls_repeats_and_other_columns(spark):
    frame = spark.createDataFrame([(1, None, 2), (None, "a", 3), (1, "a", 2), (1, "a", 2)], "doc_id long, text string, ids int")
    rows = bpe.digests(frame, PATH).collect()
    assert sorted(r["n_tokens"] for r in rows) == [0, 1, 1, 1]
    assert bpe.digests(frame.limit(0), PATH).count() == 0
