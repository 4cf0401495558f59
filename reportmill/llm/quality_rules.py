"""Line-first cleaning: rules per line, removal of failing lines, then a verdict on the loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, text_of, words

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Phrases of lines that are no prose; a line is tested in lower case.
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "privacy policy", "terms of service", "terms of use",
    "cookie", "javascript", "subscribe to", "sign up", "log in to", "click here", "read more", "lorem ipsum",
    "share this", "powered by", "skip to content",
)
BOILERPLATE_WORDS = 30
MENU_MARKS = "|»›·•"


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def repeated_words(items: Column) -> Column:
    """How many words lie in a 3-word window that occurs twice or more in the array.

    Windows are compared by a 64-bit hash. Sorted (hash, place) pairs show repeats as
    neighbours, so the work is n log n for a text of any length.
    """
    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(w[i], w[i + 1], w[i + 2]).alias("h"), i.alias("at")))

    def places(s: Column) -> Column:
        again = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda i: F.coalesce(F.get(s, i - 1)["h"] == F.get(s, i)["h"], F.lit(False))
            | F.coalesce(F.get(s, i + 1)["h"] == F.get(s, i)["h"], F.lit(False)),
        )
        return F.sort_array(F.transform(again, lambda i: F.get(s, i)["at"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.least(F.lit(3), p[i] - p[i - 1]).cast("long"))
        return F.when(F.size(p) == 0, F.lit(0).cast("long")).when(F.size(p) == 1, F.lit(3).cast("long")).otherwise(
            F.aggregate(gaps, F.lit(3).cast("long"), lambda a, b: a + b)
        )

    def judged(w: Column) -> Column:
        plain = let(windows(w), lambda x: F.when(F.size(F.array_distinct(x["h"])) == F.size(x), F.lit(0).cast("long")).otherwise(
            let(F.sort_array(x), lambda s: let(places(s), covered))
        ))
        return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(plain)

    return let(items, judged)


def _line_fails(line: Column, n: Column) -> Column:
    """Punctuation, navigation and boilerplate rules for a line of n words."""
    trimmed = F.trim(F.translate(line, SPACES, "      "))
    no_stop = ~trimmed.rlike(r"[.!?:;…][\"'”’)\]»]*($|\s)")
    shouted = (F.length(line) - F.length(F.replace(F.replace(line, F.lit("!!"), F.lit("")), F.lit("??"), F.lit("")))) / 2 > 0.3 * n
    littered = _count(line, SYMBOLS) > 0.5 * n
    menu = (_count(line, MENU_MARKS) >= 3) & (_count(line, MENU_MARKS) > 0.2 * n)
    boiler = (n <= BOILERPLATE_WORDS) & F.lower(line).rlike("|".join(BOILERPLATE))
    return no_stop | shouted | littered | menu | boiler


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat: int = 50, min_kept: int = 50) -> DataFrame:
    """Counts, cleaned text and verdict per row.

    A line is dropped when it has words and fails a rule: no sentence end anywhere in it
    (punctuation), shouted or littered with symbols (punctuation), a row of menu marks
    (navigation), or a fixed phrase in a short line (boilerplate). A row is kept when the
    whole text passes the base rules (at least min_words words, repeated words not over
    max_repeat percent) and its remaining lines hold at least min_kept percent of its words.

    Null or empty texts have zero counts and fail; repeated rows repeat; an empty table
    gives no rows. Everything is one projection: no shuffle, no Python.
    """
    text = text_of(text_col)
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    parts = F.transform(lines, lambda x: let(words(x), lambda w: F.struct(
        x.alias("line"), w.alias("words"), F.size(w).alias("n"), _line_fails(x, F.size(w)).alias("fails"),
    )))
    counted = docs.select(F.col(id_col).alias("id"), text.alias("text"), parts.alias("parts"))
    kept = F.filter("parts", lambda p: ~p["fails"])
    total = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["n"])
    left = F.aggregate(kept, F.lit(0).cast("long"), lambda a, p: a + p["n"])
    rows = counted.select(
        "id", total.alias("n_words"), F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        _count(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("parts") - F.size(F.array_distinct(F.col("parts")["line"]))).cast("long").alias("n_dup_lines"),
        repeated_words(F.flatten(F.col("parts")["words"])).alias("n_repeat_words"),
        left.alias("kept_words"), F.size("parts").alias("n_lines"), F.size(kept).alias("kept_lines"),
        F.array_join(F.transform(kept, lambda p: p["line"]), "\n").alias("cleaned"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn(
        "kept", ~failed & (100 * F.col("kept_words") >= min_kept * F.col("n_words"))
    )
