"""Language identification by rank-order profiles."""

import random
from collections import Counter

import numpy as np
import pytest

from reportmill.llm import language

DOCS = "doc_id long, text string, lang string"


def grams(text):
    x = "".join(c.lower()[0] if c.isalpha() else " " for c in f" {text or ''} ")
    found = [x[i : i + n] for n in (1, 2, 3) for i in range(len(x) - n + 1)]
    return Counter(g for g in found if (g[1] != " " if len(g) == 3 else g.strip()))


def key(gram):
    return sum(ord(c) << 21 * i for i, c in enumerate(gram))


def brute(docs, taught, size):
    """(lang, score) per document, from plain counters."""
    totals = {}
    for k, text, lang in docs:
        if taught(k) and lang is not None and text is not None:
            totals.setdefault(lang, Counter()).update(grams(text))
    order = lambda c: sorted(c, key=lambda g: (-c[g], key(g)))[:size]
    profiles = {lang: {g: i for i, g in enumerate(order(c))} for lang, c in totals.items() if c}
    out = {}
    for k, text, _ in docs:
        own = grams(text)
        top = order(own)
        if not top or not profiles:
            out[k] = ("und", 0.0)
            continue
        places = {n: np.mean([i for i, g in enumerate(top) if own[g] == n]) for n in set(own.values()) if any(own[g] == n for g in top)}
        far = {lang: sum(abs(p[g] - places[own[g]]) if g in p else size for g in top) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        out[k] = (best, 1 - far[best] / (size * len(top)))
    return out


def text_of(rnd, letters, words):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 7))) for _ in range(words))


def corpus(rnd):
    spoken = {"aa": "abcdeé", "bb": "abxyzß", "ωω": "αβγδΩ"}
    rows = [(k, text_of(rnd, spoken[lang], rnd.randrange(1, 60)) + rnd.choice(["", "!! 12\n", "İ", "😀"]), lang) for k in range(120) for lang in [rnd.choice(list(spoken))]]
    return rows + [(200, None, "aa"), (201, "", "bb"), (202, " 12 -- 😀", "aa"), (203, "abc", None), (204, "漢字", None), (205, "Q", "aa")]


@pytest.mark.parametrize("size", [400, 25])
def test_against_counters(spark, monkeypatch, size):
    rnd = random.Random(size)
    monkeypatch.setattr(language, "STRETCH", 256)
    monkeypatch.setattr(language, "GATHERED", 64)
    rows = corpus(rnd)
    frame = spark.createDataFrame(rows, DOCS).repartition(3)
    got = {r["id"]: (r["lang_pred"], r["score"]) for r in language.identify(frame, language.F.col("doc_id") % 3 != 1, size=size).collect()}
    want = brute(rows, lambda k: k % 3 != 1, size)
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)
    assert got[200] == got[201] == got[202] == ("und", 0.0) and got[204][0] in {"aa", "bb", "ωω"}


def test_long_texts_are_cut_between_words(monkeypatch):
    rnd = random.Random(5)
    texts = [text_of(rnd, "abcé", 3000), "", text_of(rnd, "xyz", 40), "a" * 900]
    whole = language.counts(texts)
    monkeypatch.setattr(language, "STRETCH", 1000)
    cut = language.counts(texts)
    assert all((a[0] == b[0]).all() and (a[1] == b[1]).all() for a, b in zip(whole, cut, strict=True))


def test_repeats_and_clashing_columns(spark):
    rows = [(1, "abc abd", "aa", 7, "x", 0.5), (1, "abc abd", "aa", 7, "x", 0.5), (2, "xyz xyz", "bb", 8, "y", 0.1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, gram int, text_ string, Score double")
    found = language.identify(frame)
    assert found.columns == ["id", "lang_pred", "score", "text", "lang", "gram", "text_"]
    got = sorted((r["id"], r["lang_pred"], r["gram"]) for r in found.collect())
    assert got == [(1, "aa", 7), (1, "aa", 7), (2, "bb", 8)]
    assert language.identify(frame.limit(0)).count() == 0


def test_nothing_to_learn(spark):
    frame = spark.createDataFrame([(1, "abc", None), (2, None, "aa")], DOCS)
    assert {(r["lang_pred"], r["score"]) for r in language.identify(frame).collect()} == {("und", 0.0)}


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "MAX_LANGUAGES", 2)
    frame = spark.createDataFrame([(k, "abc", f"l{k}") for k in range(3)], DOCS)
    with pytest.raises(ValueError):
        language.identify(frame)
