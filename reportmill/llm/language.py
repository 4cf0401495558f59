"""Language identification by rank-order profiles of letter n-grams.

A language's profile is the ranking of its most frequent n-grams over all teaching texts. A
document's own most frequent n-grams are ranked the same way; its language is the one whose
profile they are least out of place in: every n-gram costs the difference of its two ranks, or
the length of a profile where the language does not list it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, sliced, small_batches

#: N-grams of a profile, of a language and of a document.
PROFILE = 400
#: Bound on the languages that can be learned; it bounds what is sent to all tasks. There are under 8,000 living ones.
MAX_LANGUAGES = 8192
UNKNOWN = "und"
#: Code points that are turned into n-grams at once, and distinct n-grams a task gathers before it passes them on.
STRETCH, GATHERED = 1 << 20, 1 << 20
_GAP, _BITS = 32, 21


@lru_cache(maxsize=1)
def _alphabet() -> np.ndarray:
    """Code of every code point: the first of its lower case for a letter, else a gap."""
    table = np.full(0x110000, _GAP, np.int32)
    for c in range(0x110000):
        if chr(c).isalpha():
            table[c] = ord(chr(c).lower()[0])
    return table


def _pieces(texts: list[str]) -> Iterator[tuple[str, list[int], list[int]]]:
    """(joined text, owners, ends): texts joined with gaps between them, in stretches of about STRETCH characters.

    A longer text is cut at a character that is no letter; only a run of letters longer than
    a stretch is cut inside.
    """
    held: list[str] = []
    owners: list[int] = []
    size = 0
    for k, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = min(len(text), at + STRETCH)
            if end < len(text):
                cut = end
                while cut > at and text[cut - 1].isalpha():
                    cut -= 1
                end = cut if cut > at else end
            held.append(text[at:end])
            owners.append(k)
            size += end - at
            at = end
            if size >= STRETCH:
                yield " " + " ".join(held) + " ", owners, np.cumsum([len(h) + 1 for h in held]).tolist()
                held, owners, size = [], [], 0
    if held:
        yield " " + " ".join(held) + " ", owners, np.cumsum([len(h) + 1 for h in held]).tolist()


def _grams(joined: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """For one, two and three characters: (n-grams in order, where each starts); a gap may stand at either end of two or three."""
    x = _alphabet()[np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")].astype(np.int64)
    letter = x != _GAP
    two = x[:-1] | x[1:] << _BITS
    three = two[:-1] | x[2:] << 2 * _BITS
    at = (np.flatnonzero(letter), np.flatnonzero(letter[:-1] | letter[1:]), np.flatnonzero(letter[1:-1]))
    return [(keys[starts], starts) for keys, starts in zip((x, two, three), at, strict=True)]


def _sums(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    names, at = np.unique(keys, return_inverse=True)
    return names, np.bincount(at, counts, len(names)).astype(np.int64)


def counts(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its n-grams in order and how often each occurs."""
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in texts]
    for joined, owners, ends in _pieces(texts):
        # The gap before a text is its own; an n-gram that starts at the gap after it belongs to the next one.
        grams = [(keys, np.searchsorted(starts, [0, *ends])) for keys, starts in _grams(joined)]
        for k, owner in enumerate(owners):
            own = np.concatenate([keys[cuts[k] : cuts[k + 1]] for keys, cuts in grams])
            if len(own):
                found[owner].append(np.unique(own, return_counts=True))
    return [nothing if not f else f[0] if len(f) == 1 else _sums(f) for f in found]


def profiles(taught: DataFrame, size: int = PROFILE) -> DataFrame:
    """(lang, gram, place): the `size` most frequent n-grams of every language, place 0 first, of rows (lang, text).

    Equal counts go by the n-gram. Tasks add up their own counts before anything is shuffled,
    and only the first `size` of a partition go to a language's ranking.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merge() -> int:
            for lang, parts in held.items():
                held[lang] = [_sums(parts)]
            return sum(len(p[0][0]) for p in held.values())

        def told() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                names, n = parts[0]
                yield pa.record_batch([pa.array([lang] * len(names), pa.string()), pa.array(names), pa.array(n)], names=["lang", "gram", "n"])
            held.clear()

        for batch in sliced(batches):
            langs = batch.column(0).to_pylist()
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(langs, batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text or "")
            for lang, texts in by_lang.items():
                for joined, _, _ in _pieces(texts):
                    held.setdefault(lang, []).append(np.unique(np.concatenate([g for g, _ in _grams(joined)]), return_counts=True))
            if sum(len(p[0]) for parts in held.values() for p in parts) > GATHERED and merge() > GATHERED // 2:
                yield from told()
        merge()
        yield from told()

    sums = taught.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return sums.withColumn("place", place - 1).filter(F.col("place") < size).select("lang", "gram", "place")


class Profiles:
    """Places of n-grams in the profiles of several languages."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int) -> None:
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        number = {lang: k for k, lang in enumerate(self.langs)}
        rows = sorted((gram, number[lang], place) for lang, gram, place in rows)
        grams = np.array([r[0] for r in rows], np.int64)
        self.lang, self.place = (np.array([r[i] for r in rows], np.int64) for i in (1, 2))
        self.grams, self.start = np.unique(grams, return_index=True)
        self.end = np.append(self.start, len(grams))[1:]

    def nearest(self, grams: np.ndarray, n: np.ndarray) -> tuple[str, float]:
        """(language, score) of counted n-grams; score is 1 less the share of the greatest possible distance."""
        if not len(grams) or not self.langs:
            return UNKNOWN, 0.0
        first = np.argsort(-n, kind="stable")[: self.size]
        # N-grams that occur equally often share the middle of their places.
        _, group, many = np.unique(-n[first], return_inverse=True, return_counts=True)
        place = (np.cumsum(many) - (many + 1) / 2)[group]
        at = np.minimum(np.searchsorted(self.grams, grams[first]), len(self.grams) - 1)
        listed = np.flatnonzero(self.grams[at] == grams[first])
        start, many = self.start[at[listed]], (self.end - self.start)[at[listed]]
        entry = np.repeat(start - np.cumsum(many) + many, many) + np.arange(many.sum())
        near = np.bincount(self.lang[entry], self.size - np.abs(self.place[entry] - np.repeat(place[listed], many)), len(self.langs))
        best = int(np.argmax(near))
        return self.langs[best], float(near[best] / (self.size * len(first)))


def identify(docs: DataFrame, learn_from: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> DataFrame:
    """(id, lang_pred, score, ...) for every row of docs; the remaining columns of docs follow unchanged.

    Profiles are learned from the texts of all rows for which learn_from holds and whose
    language is not null; the language of a row is not looked at when it is judged. Letters are
    Unicode letters in lower case, everything else is a gap. A null text or one without a
    letter is `und` with score 0, as is every text when nothing was learned; equally near
    languages go by name; a text none of whose n-grams is listed gets score 0. Repeated rows
    get equal results, an empty table gives none. Columns of docs named like a result column
    are dropped. More than MAX_LANGUAGES languages raise an error: profiles go to all tasks.
    """
    small_batches(docs.sparkSession)
    taught = docs.filter(learn_from) if learn_from is not None else docs
    taught = taught.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = [tuple(r) for r in profiles(taught, size).limit(MAX_LANGUAGES * size + 1).toLocalIterator()]
    if len({r[0] for r in rows}) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    sent = docs.sparkSession.sparkContext.broadcast(Profiles(rows, size))
    text = fresh(docs, "text_")
    rest = [c for c in docs.columns if c.lower() not in ("id", "lang_pred", "score") and c != id_col]
    asked = docs.select(F.col(text_col).alias(text), F.col(id_col).alias("id"), *rest)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 512):
            known = [sent.value.nearest(*c) for c in counts([t or "" for t in batch.column(0).to_pylist()])]
            lang, score = pa.array([k[0] for k in known], pa.string()), pa.array([k[1] for k in known], pa.float64())
            yield pa.record_batch([batch.column(1), lang, score, *batch.columns[2:]], names=["id", "lang_pred", "score", *rest])

    out = asked.select("id", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), *rest).schema
    return asked.mapInArrow(judge, out)
