"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sliced, small_batches
from .hashing import LETTERS, LOWER, mix, word_hashes

#: A feature enters the model when this many texts of the sample hold it; counted in a table of 2 ** COUNT_BITS.
MIN_TEXTS, COUNT_BITS = 3, 26
#: A bit table of this many bits sorts out most features without a weight before the exact look-up.
SIEVE_BITS = 22
#: Bound on the labelled rows that a model is fitted on, by hash of their id.
MAX_TRAIN = 20_000
EPOCHS, ALPHA, BETA, L1, L2 = 6, 1.0, 1.0, 4.0, 0.1
#: Words apart in a pair: neighbours, and skip-grams over one word.
GAPS = (1, 2)
_SALT = (0x632BE59BD9B4E019, 0xD6E8FEB86659FD93)
_STRETCH = 1 << 22


def _stretches(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about _STRETCH bytes together."""
    start, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= _STRETCH:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features, owner): hashed words, pairs and skip-pairs of texts, and whose they are."""
    h, counts = word_hashes([t.translate(LOWER) for t in texts], LETTERS)
    owner = np.repeat(np.arange(len(texts)), counts)
    found, owners = [h], [owner]
    for gap, salt in zip(GAPS, _SALT, strict=True):
        if len(h) > gap:
            same = owner[gap:] == owner[:-gap]
            found.append(mix(h[:-gap] * np.uint64(salt) + h[gap:])[same])
            owners.append(owner[gap:][same])
    return (np.concatenate(found) >> np.uint64(32)).astype(np.uint32), np.concatenate(owners)


class Ftrl:
    """FTRL-proximal with per-coordinate rates; weights are built from (z, n) when needed."""

    def __init__(self, size: int) -> None:
        self.z = np.zeros(size)
        self.n = np.zeros(size)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = (np.sign(z) * L1 - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += gradient - (np.sqrt(n + gradient * gradient) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + gradient * gradient


def fit(labelled: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[np.ndarray, np.ndarray, float]:
    """(features in order, their weights, bias): only weights that L1 does not leave at zero.

    Texts become sets of 32-bit feature hashes in all tasks; one task then walks these sets,
    at most about MAX_TRAIN of them, in the order of a hash of the id, so a fit is
    repeatable. Features of fewer than MIN_TEXTS texts never enter the model.
    """
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [(t.as_py() or "").encode() for t in batch.column(2)]
            sets: list[np.ndarray] = []
            for a, b in _stretches(texts):
                f, owner = features(texts[a:b])
                ends = np.cumsum(np.bincount(owner, minlength=b - a))[:-1]
                sets += [np.unique(x) for x in np.split(f[np.argsort(owner, kind="stable")], ends)]
            packed = pa.array([x.astype("<u4").tobytes() for x in sets], pa.binary())
            yield pa.record_batch([batch.column(0), batch.column(1), packed], names=["place", "label", "found"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, parts, seen = [], [], np.zeros(1 << COUNT_BITS, np.uint8)
        for batch in sliced(batches):
            ends = np.cumsum(pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False) // 4)
            found = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u4")
            for part in np.split(found, ends[:-1]):
                slot = np.unique(part >> np.uint32(32 - COUNT_BITS))
                seen[slot] = np.minimum(seen[slot], 254) + 1
            heads += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            parts.append((found, ends))
        kept, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for found, ends in parts:  # few large arrays, which go back to the system once they are filtered
            held = seen[found >> np.uint32(32 - COUNT_BITS)] >= MIN_TEXTS
            kept.append(found[held])
            sizes.append(np.diff(np.append(0, np.append(0, np.cumsum(held))[ends])))
        del parts, seen
        kept, sizes = np.concatenate(kept), np.concatenate(sizes)
        names = np.unique(kept)
        sets = np.split(np.searchsorted(names, kept).astype(np.int32), np.cumsum(sizes)[:-1])
        rows = sorted((place, label, size, k) for k, ((place, label), size) in enumerate(zip(heads, sizes.tolist(), strict=True)))
        model, bias = Ftrl(len(names) + 1), np.int32(len(names))
        for _ in range(EPOCHS):
            for _, label, _, k in rows:
                model.learn(np.append(sets[k], bias), label)
        w = model.weights(np.arange(len(names) + 1))
        used = np.flatnonzero(w[:-1])
        found = [-1, *names[used].tolist()] if rows else []
        yield pa.record_batch([pa.array(found, pa.int64()), pa.array(np.append(w[-1], w[used])[: len(found)])], names=["feature", "weight"])

    rows = labelled.select(F.xxhash64(id_col).alias("place"), F.col(label_col).cast("int").alias("label"), F.col(text_col).alias("text"))
    sets = rows.mapInArrow(hashed, "place bigint, label int, found binary").repartition(1)
    model = sets.mapInArrow(walk, "feature bigint, weight double").toPandas().sort_values("feature")
    if model.empty:
        return np.zeros(0, np.uint32), np.zeros(0, np.float32), 0.0
    return model["feature"].to_numpy()[1:].astype(np.uint32), model["weight"].to_numpy()[1:].astype(np.float32), float(model["weight"].iloc[0])


def sample(labels: DataFrame, id_col: str, bound: int) -> DataFrame:
    """Labelled rows by hash of their id, about `bound` at most; all of them if they are fewer."""
    n = labels.count()
    share = min(1.0, bound / max(n, 1))
    return labels.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else labels


def score(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> DataFrame:
    """All columns of docs plus score (0 to 1, higher: toxic); a column of that name is replaced.

    The model sees words only. It is fitted on labelled rows for which learn_from holds,
    bounded by max_train; these ids and labels are sent to all tasks, which is why the bound
    exists. Its weights that are not zero are sent to all tasks for scoring; a row counts
    each of its features once. Null and empty texts get the model's bias; without any
    labelled row every score is 0; repeated rows get equal scores; an empty table gives none.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = sample(known.filter(learn_from) if learn_from is not None else known, id_col, max_train).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    docs = docs.drop("score")
    small_batches(docs.sparkSession)
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    names, weights, bias = fit(labelled, "id", "text", "label")
    empty = known.isEmpty()
    sent = docs.sparkSession.sparkContext.broadcast((names, weights))

    def told(found: np.ndarray, owner: np.ndarray, n: int, sieve: np.ndarray) -> np.ndarray:
        """Sum of weights of the features of each of n texts, each feature once."""
        names, weights = sent.value
        kept = np.flatnonzero(sieve[found >> np.uint32(32 - SIEVE_BITS)])
        place = np.searchsorted(names, found[kept])
        held = names[np.minimum(place, len(names) - 1)] == found[kept]
        pairs = np.unique(owner[kept[held]] * len(names) + place[held])
        return np.bincount(pairs // len(names), weights[pairs % len(names)], minlength=n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = np.zeros(1 << SIEVE_BITS, bool)
        sieve[sent.value[0] >> np.uint32(32 - SIEVE_BITS)] = True
        for batch in sliced(batches):
            texts = [(t.as_py() or "").encode() for t in batch.column(batch.schema.names.index(text_col))]
            total = np.full(len(texts), bias)
            if len(sent.value[0]):
                for a, b in _stretches(texts):
                    total[a:b] += told(*features(texts[a:b]), b - a, sieve)
            scores = np.zeros(len(texts)) if empty else 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.record_batch([*batch.columns, pa.array(scores)], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, docs.withColumn("score", F.lit(0.0)).schema)
