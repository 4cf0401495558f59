"""Inverted index of character n-grams: which texts hold a word anywhere inside.

A text is listed under each of its distinct n-grams. A word is looked up under the rarest of
its own n-grams only, and the few texts found there are searched for the whole word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise, stored_small

#: Characters of an n-gram; a shorter word is its own n-gram.
GRAM = 4


def grams_of(text: Column, sizes: tuple[int, ...] = (GRAM,)) -> Column:
    """Distinct n-grams of a text, of each of the given sizes; size 0 is the empty one."""
    of = lambda n: F.array(F.lit("")) if n == 0 else F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
    return F.array_distinct(F.concat(*[of(n) for n in sizes]))


def postings(texts: DataFrame, sizes: tuple[int, ...] = (GRAM,), text: str = "folded") -> DataFrame:
    """(gram, chunk_id) for every distinct n-gram of every text. Store it to look words up again and again."""
    return texts.select("chunk_id", F.explode(grams_of(F.col(text), sizes)).alias("gram"))


def word_grams(words: DataFrame) -> DataFrame:
    """(word, gram) of distinct words."""
    own = F.when(F.length("word") < GRAM, F.array("word")).otherwise(grams_of(F.col("word")))
    return words.select("word").distinct().select("word", F.explode(own).alias("gram"))


def rarest(grams: DataFrame, listed: DataFrame) -> DataFrame:
    """(word, gram): of every word the n-gram that the fewest texts hold; words with an unlisted n-gram are left out.

    Only the asked n-grams are counted, and each task adds up its own before the shuffle.
    """
    counts = listed.join(grams.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("texts"))
    best = grams.join(counts, "gram", "left").groupBy("word").agg(
        F.min(F.struct("texts", "gram")).alias("best"), F.bool_or(F.col("texts").isNull()).alias("unknown")
    )
    return best.filter(~F.col("unknown")).select("word", F.col("best.gram").alias("gram"))


def containing(words: DataFrame, texts: DataFrame, stored: DataFrame | None = None, text: str = "folded") -> DataFrame:
    """(word, *texts.columns) for every asked word and every text that contains it.

    `stored` is a kept `postings` of these texts with all the sizes that words shorter than
    GRAM need; without it the texts are read twice, once for the counts of the asked n-grams and
    once for the lists of the rarest ones, and nothing but those lists is shuffled. Null
    words and texts meet nothing; repeated words count once.
    """
    words = words.filter(F.col("word").isNotNull())
    texts = texts.filter(F.col(text).isNotNull())
    grams = word_grams(words)
    if stored is None:
        short = words.filter(F.length("word") < GRAM).select(F.length("word").alias("n")).distinct()
        stored = postings(texts, (*sorted(r["n"] for r in short.collect()), GRAM), text)
    chosen = rarest(grams, stored)
    candidates = stored.join(chosen, "gram").select("word", "chunk_id")
    return texts.join(candidates, "chunk_id").filter(F.contains(F.col(text), F.col("word"))).select("word", *texts.columns)


def token_postings(texts: DataFrame, text: str = "folded") -> DataFrame:
    """(token, chunk_id) for every distinct run without white space of every text."""
    return texts.filter(F.col(text).isNotNull()).select("chunk_id", F.explode(F.array_distinct(F.split(text, r"[ \t\n\x0b\f\r]+"))).alias("token"))


def containing_words(words: DataFrame, texts: DataFrame, stored: DataFrame | None = None, text: str = "folded") -> DataFrame:
    """`containing` for words without white space: such a word lies inside one token of a text.

    The n-gram index is that of the distinct tokens. `stored` is a kept `token_postings` of
    these texts; without it the texts are cut into tokens twice. The tokens that hold a word
    are sent to the texts while they are few, so that the lists of all texts are not shuffled.
    """
    tokens = token_postings(texts, text) if stored is None else stored
    vocabulary = materialise(tokens.select("token").distinct(), "vocabulary").select(F.col("token").alias("chunk_id"), F.col("token").alias(text))
    inside = stored_small(containing(words, vocabulary, None, text).select("word", F.col("chunk_id").alias("token")), "word-tokens")
    hits = tokens.join(inside, "token").select("word", "chunk_id").distinct()
    return texts.join(hits, "chunk_id").select("word", *texts.columns)
