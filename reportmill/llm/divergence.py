"""Source divergence audit: how the sources of a language differ, and by which terms.

Every (lang, source) group and every language gives each kept term a smoothed integer share
p = 1 + floor(SCALE * (count + 1) / (N + V)). The divergence of p from q at a term is
floor((p - q)^2 / q). Two lists come out: `pair` ranks the other sources of a language by the
divergence summed over all kept terms, `term` ranks the terms that a group has more of than
its language.

The best terms are found by dominance: a term with a higher count in the group, a lower count
in the language and an earlier name ranks before another one whatever the group's sizes are.
Partitions keep their skyband (terms that fewer than k others dominate), the skybands of a
group are merged the same way, and only what is left is ranked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import sliced, small_batches

#: A term is kept in a language when so many of its documents hold it.
MIN_DOCS = 3
#: Terms that are ranked for a group.
TOP_TERMS = 200
SCALE = 1_000_000_000
#: Bytes of text that are cut into terms at once, and rows a task gathers before it passes its sums on.
STRETCH, GATHERED = 1 << 24, 1 << 20
#: Rows of counts in a block of terms, and cells of a block that are held as a matrix.
BLOCK_ROWS, CELLS = 1 << 16, 1 << 21
#: Rows that are compared with a skyband at once.
STEP = 256
_COUNTS = "lang string, source string, term string, n bigint, docs bigint"
#: Bytes of a term, A-Z lower-cased; all others are zero.
_LETTERS = np.array([b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, where each begins and the last ends)."""
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(terms as binary, the text each is from) of texts without nulls."""
    data, ends = _bytes(texts)
    low = _LETTERS[data]
    held = low != 0
    first = held.copy()
    first[1:] &= ~held[:-1]
    own = ends[:-1][ends[:-1] < len(data)]
    first[own] = held[own]
    last = held.copy()
    last[:-1] &= ~held[1:] | first[1:]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    offsets = np.concatenate(([0], np.cumsum(end - begin))).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(low[held])])
    return found, np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(begin, ends)))


def _stretches(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about STRETCH bytes together."""
    _, ends = _bytes(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + STRETCH, side="right")) - 1)
        yield at, to
        at = to


def _counted(lang: pa.Array, source: pa.Array, texts: pa.Array) -> pa.Table:
    """Per (lang, source, term): occurrences and documents."""
    found, owner = terms(texts)
    names = found.dictionary_encode()
    size = max(len(names.dictionary), 1)
    pair, n = np.unique(owner * size + names.indices.to_numpy(), return_counts=True)
    langs, sources = lang.dictionary_encode(), source.dictionary_encode()
    group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
    key = group[pair // size] * size + pair % size
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    at = np.flatnonzero(np.diff(key, prepend=-1))
    group, term = np.divmod(key[at], size)
    return pa.table({
        "lang": langs.dictionary.take(group // len(sources.dictionary)), "source": sources.dictionary.take(group % len(sources.dictionary)),
        "term": names.dictionary.take(term).cast(pa.string()),
        "n": np.add.reduceat(n, at) if len(at) else n, "docs": np.diff(np.append(at, len(key))),
    })


def _merged(parts: list[pa.Table]) -> pa.Table:
    sums = pa.concat_tables(parts).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return sums.rename_columns(["lang", "source", "term", "n", "docs"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a task; they go on whenever more than GATHERED rows are held."""
    parts: list[pa.Table] = []
    for batch in sliced(batches, 4096):
        lang, source, texts = batch.columns
        for a, b in _stretches(texts):
            parts.append(_counted(*(c.slice(a, b - a) for c in (lang, source, texts))))
        if sum(len(p) for p in parts) > GATHERED:
            parts = [_merged(parts)]
            if len(parts[0]) > GATHERED // 2:
                yield from parts.pop().to_batches(max_chunksize=1 << 16)
    if parts:
        yield from _merged(parts).to_batches(max_chunksize=1 << 16)


def share(n: Column, size: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (size + kept)), exact for counts of any size."""
    whole = lambda c: c.cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * whole(n + 1), whole(F.greatest(size + kept, F.lit(1))))


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


class _Band:
    """The skyband of one group whose rows come by count descending, language count and term ascending."""

    def __init__(self, k: int) -> None:
        self.k, self.total, self.names = k, np.zeros(0, np.int64), pa.array([], pa.string())

    def take(self, n: np.ndarray, total: np.ndarray, names: pa.Array) -> np.ndarray:
        """Which of the next rows fewer than k others dominate.

        Rows that come later never dominate earlier ones. Of rows with equal counts the first k
        can stay at most. It is enough to count dominators in the skyband so far: a row that
        k others dominate is dominated by k rows of the skyband.
        """
        run = np.flatnonzero((np.diff(n, prepend=-1) != 0) | (np.diff(total, prepend=-1) != 0))
        place = np.arange(len(n)) - np.repeat(run, np.diff(np.append(run, len(n))))
        fresh = np.flatnonzero(place < self.k)
        both = pa.concat_arrays([self.names, names.take(fresh)])
        rank = np.empty(len(both), np.int64)
        rank[pc.sort_indices(both).to_numpy()] = np.arange(len(both))
        held = np.arange(len(self.names))
        totals = np.concatenate((self.total, total[fresh]))
        for at in range(len(self.names), len(both), STEP):
            own = np.arange(at, min(at + STEP, len(both)))
            above = ((totals[held, None] <= totals[own]) & (rank[held, None] < rank[own])).sum(0)
            above += np.triu((totals[own, None] <= totals[own]) & (rank[own, None] < rank[own]), 1).sum(0)
            held = np.concatenate((held, own[above < self.k]))
        new = held[held >= len(self.names)] - len(self.names)
        self.total, self.names = totals[held], both.take(held)
        kept = np.zeros(len(n), bool)
        kept[fresh[new]] = True
        return kept


def skyband(rows: DataFrame, k: int) -> DataFrame:
    """Rows (lang, source, term, n, lang_n) of each partition that fewer than k others of their group dominate there.

    Partitions are sorted by Spark and walked group by group; a task holds the skyband of one
    group and some thousand rows.
    """
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, band = None, _Band(k)
        for batch in sliced(batches, 8192):
            lang, source = (batch.column(i).dictionary_encode() for i in (0, 1))
            key = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            cuts = np.append(np.flatnonzero(np.diff(key, prepend=-1)), len(key)).tolist()
            n, total = (batch.column(i).to_numpy() for i in (3, 4))
            kept = []
            for a, b in zip(cuts, cuts[1:]):
                name = (batch.column(0)[a].as_py(), batch.column(1)[a].as_py())
                if name != group:
                    group, band = name, _Band(k)
                kept.append(band.take(n[a:b], total[a:b], batch.column(2).slice(a, b - a)))
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    ordered = rows.sortWithinPartitions("lang", "source", F.desc("n"), "lang_n", "term")
    return ordered.mapInArrow(walk, rows.schema)


def _pairs(left: pa.Table, right: pa.Table) -> pa.Table:
    """Divergence of every source from every other one over a block of terms; absent terms have the share `least`."""
    lang, names, least = (right.column(c) for c in ("lang", "source", "least"))
    least = least.to_numpy()
    size = len(least)
    total = np.zeros((size, size), np.int64)
    if len(left):
        term = left.column("term").combine_chunks().dictionary_encode()
        row = pc.index_in(left.column("source"), value_set=names.combine_chunks()).to_numpy()
        p, column, width = left.column("p").to_numpy(), term.indices.to_numpy(), max(1, CELLS // size)
        for at in range(0, len(term.dictionary), width):
            n = min(width, len(term.dictionary) - at)
            shares = np.repeat(least[:, None], n, axis=1)
            here = (column >= at) & (column < at + n)
            shares[row[here], column[here] - at] = p[here]
            for a in range(size):
                gap = shares[a] - shares
                total[a] += (gap * gap // shares).sum(axis=1)
    a, b = np.nonzero(~np.eye(size, dtype=bool))
    return pa.table({"lang": lang.combine_chunks().take(pa.array(a)), "source": names.combine_chunks().take(pa.array(a)), "item": names.combine_chunks().take(pa.array(b)), "value": total[a, b]})


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, k: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): other sources and own terms of every source of a language.

    Null language, source or text is read as empty. Terms are runs of ASCII letters and
    non-ASCII characters, A-Z lower-cased; a language keeps those that at least min_docs of its
    documents hold. `pair` ranks all other sources, `term` the k best terms of a group; equal
    values go by the item in UTF-8 order. Repeated rows count as often as they occur. A group
    without kept terms has pairs (of value 0 where its language keeps none) and no terms; the
    only source of a language has no pairs; an empty table gives no rows. Other columns are
    not read, whatever their names are. Pairs cost sources x sources x terms of a language,
    dealt out in blocks of terms; a block holds CELLS shares at once.
    """
    small_batches(docs.sparkSession)
    empty = lambda name, alias: F.coalesce(F.col(name).cast("string"), F.lit("")).alias(alias)
    docs = docs.select(empty(lang_col, "lang"), empty(source_col, "source"), empty(text_col, "text"))
    of_term, group = Window.partitionBy("lang", "term"), ["lang", "source"]
    # One shuffle: rows of a term meet for their sums by source and by language.
    sums = docs.mapInArrow(_count, _COUNTS).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = sums.select(
        *group, "term", "n", F.sum("n").over(of_term).alias("lang_n"), F.sum("docs").over(of_term).alias("docs"),
        (F.min("source").over(of_term) == F.col("source")).cast("bigint").alias("first"),
    ).filter(F.col("docs") >= min_docs).drop("docs")
    counts = materialise(counts, "divergence-counts")

    by_lang = counts.groupBy("lang").agg(F.sum("first").alias("kept"), F.sum("n").alias("lang_size"), F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
    sizes = docs.select(*group).distinct().join(counts.groupBy(*group).agg(F.sum("n").alias("size")), group, "left").join(by_lang, "lang", "left")
    sizes = sizes.fillna({"size": 0, "kept": 0, "lang_size": 0, "blocks": 1}).withColumn("least", share(F.lit(0), F.col("size"), F.col("kept")))
    sizes = materialise(sizes, "divergence-sizes")

    shares = counts.join(sizes, group).withColumn("p", share(F.col("n"), F.col("size"), F.col("kept")))
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block")
    left = shares.select("lang", block, "source", "term", "p").groupBy("lang", "block")
    right = sizes.select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("block"), "source", "least").groupBy("lang", "block")
    pairs = left.cogroup(right).applyInArrow(_pairs, "lang string, source string, item string, value bigint")
    pairs = pairs.groupBy(*group, "item").agg(F.sum("value").alias("value"))

    # p grows with the group's count and q with the language's, so what a term that passes is dominated by passes too.
    q = share(F.col("lang_n"), F.col("lang_size"), F.col("kept"))
    more = shares.filter(F.col("p") > q).select(*group, "term", "n", "lang_n")
    band = skyband(skyband(more, k).repartition(*group), k)
    best = band.join(sizes, group).select(*group, F.col("term").alias("item"), apart(share(F.col("n"), F.col("size"), F.col("kept")), q).alias("value"))

    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("value"), "item"))
    listed = lambda rows, part: rows.select(*group, F.lit(part).alias("part"), "item", "value", rank.alias("rank"))
    return listed(pairs, "pair").unionByName(listed(best, "term").filter(F.col("rank") <= k))
