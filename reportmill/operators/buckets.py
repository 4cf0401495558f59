"""Random-projection buckets of vectors, with several probes per question.

A band projects vectors on a few random directions and notes on which side of a threshold each
projection falls; those bits are the bucket. A question also looks into the buckets it is
nearest to: those that differ in the bits whose projections lie closest to their thresholds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that the index is fitted on, the part of them that ask, and rows a bucket should hold on average.
SAMPLE, ASKING, BUCKET_ROWS = 4096, 512, 1024
BANDS, MAX_BITS = 4, 24
#: Bits nearest to their threshold that probes may differ in.
FLIPPED = 10
SEED = 11


def as_rows(x: np.ndarray, metric: str) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if metric == "cosine" else x


def _matrix(vectors, metric: str) -> np.ndarray:
    return as_rows(np.stack([np.asarray(v, np.float64) for v in vectors]), metric)


@dataclass(frozen=True)
class Buckets:
    """Directions (bands x bits x length), thresholds (bands x bits) and probes per band."""

    directions: np.ndarray
    thresholds: np.ndarray
    probes: int
    metric: str
    sample_recall: float

    def sides(self, x: np.ndarray) -> np.ndarray:
        """Signed distance from the thresholds: rows x bands x bits. Shorter vectors or directions end in zeros."""
        size = min(x.shape[1], self.directions.shape[2])
        return np.einsum("nd,tbd->ntb", x[:, :size], self.directions[:, :, :size]) - self.thresholds

    def buckets(self, sides: np.ndarray) -> np.ndarray:
        return (sides > 0) @ (1 << np.arange(sides.shape[2]))

    @property
    def bits(self) -> int:
        return self.thresholds.shape[1]

    def _costs(self, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sets of differing bits, the bits nearest to their threshold, and the sum of squared distances of each set."""
        flipped = min(sides.shape[2], FLIPPED)
        masks = (np.arange(1 << flipped)[:, None] >> np.arange(flipped)) & 1
        nearest = np.argsort(np.abs(sides), axis=2, kind="stable")[:, :, :flipped]
        return masks, nearest, np.take_along_axis(sides, nearest, 2) ** 2 @ masks.T

    def probe(self, sides: np.ndarray, probes: int) -> np.ndarray:
        """Buckets by rising sum of squared distances of the bits that differ: rows x bands x probes."""
        found = []
        for at in range(0, len(sides), 64):
            part = sides[at : at + 64]
            masks, nearest, cost = self._costs(part)
            chosen = np.argsort(cost, axis=2, kind="stable")[:, :, :probes]
            flips = (masks[chosen] << nearest[:, :, None, :]).sum(axis=3)
            found.append(self.buckets(part)[:, :, None] ^ flips)
        return np.concatenate(found)

    def reach(self, sides: np.ndarray) -> np.ndarray:
        """The cost of the last bucket that is probed: rows x bands."""
        found = []
        for at in range(0, len(sides), 64):
            cost = self._costs(sides[at : at + 64])[2]
            found.append(np.partition(cost, self.probes - 1, axis=2)[:, :, self.probes - 1])
        return np.concatenate(found)

    def within(self, sides: np.ndarray, reach: np.ndarray, buckets: np.ndarray, fixed: int | None = None) -> np.ndarray:
        """Whether a question probes a bucket of one band, or any that shares its first `fixed` bits: rows x buckets."""
        cost, bits = sides**2, sides.shape[1] if fixed is None else fixed
        if sides.shape[1] > FLIPPED:
            far = np.argsort(np.abs(sides), axis=1, kind="stable")[:, FLIPPED:]
            np.put_along_axis(cost, far, np.finfo(np.float64).max / MAX_BITS, 1)
        up, theirs = sides[:, :bits] > 0, (buckets[:, None] >> np.arange(bits)) & 1
        cost = np.hstack([np.where(up, cost[:, :bits], 0.0), np.where(up, 0.0, cost[:, :bits])])
        # A margin above the rounding error of sums in another order.
        return cost @ np.hstack([1 - theirs, theirs]).T.astype(np.float64) <= reach[:, None] * (1 + 1e-9)

    def own(self, vectors: Column) -> Column:
        """The bucket of a vector in every band, band and bucket as one number."""

        @F.pandas_udf("array<bigint>")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                out = []
                for at in range(0, len(part), 1024):
                    found = self.buckets(self.sides(_matrix(part.iloc[at : at + 1024], self.metric)))
                    out += list(np.arange(found.shape[1]) << MAX_BITS | found)
                yield pd.Series(out, index=part.index)

        return run(vectors)

    def probed(self, vectors: Column, fixed: Column) -> Column:
        """The cells (band and first `fixed` bits) in which a question probes any bucket, and its reach in every band."""

        @F.pandas_udf("cells array<bigint>, reach array<double>")
        def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            for part, bits in parts:
                cells, reaches = [None] * len(part), [None] * len(part)
                for n in bits.unique():
                    rows = np.flatnonzero(bits == n)
                    numbers = np.arange(1 << n)
                    for at in range(0, len(rows), 1024):
                        some = rows[at : at + 1024]
                        sides = self.sides(_matrix(part.iloc[some], self.metric))
                        reach = self.reach(sides)
                        met = [self.within(sides[:, b], reach[:, b], numbers, n) for b in range(sides.shape[1])]
                        for i, row in enumerate(some):
                            cells[row] = np.concatenate([b << MAX_BITS | np.flatnonzero(m[i]) for b, m in enumerate(met)])
                            reaches[row] = reach[i]
                yield pd.DataFrame({"cells": cells, "reach": reaches})

        return run(vectors, fixed)


def fit(chunks: DataFrame, k: int, metric: str = "l2", recall: float = 0.95, bands: int = BANDS, bucket_rows: int = BUCKET_ROWS, sample: int = SAMPLE) -> Buckets:
    """Directions, thresholds and probes for the vectors of `chunks` (chunk_id, embedding).

    Thresholds are the medians of a sample of at most `sample` rows, so buckets are even. Probes
    are as few as bring the sample's own nearest k neighbours back with the asked recall; the
    neighbours of a thin sample lie farther apart than those of all rows, so all rows do no
    worse as a rule. All rows are counted and all are indexed; only these few numbers are fitted.
    """
    rows = chunks.filter(F.col("embedding").isNotNull()).select("chunk_id", "embedding")
    n = rows.count()
    share = min(1.0, 2 * sample / max(n, 1))
    # Twice the share that is needed by hash, then a bounded cut: no sort of all rows.
    drawn = rows.filter(F.pmod(F.xxhash64("chunk_id", F.lit(SEED)), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else rows
    x = [r["embedding"] for r in drawn.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select("embedding").toLocalIterator()]
    bits = int(np.clip(np.ceil(np.log2(max(n, 1) / bucket_rows)), 3, MAX_BITS))
    rng = np.random.default_rng(SEED)
    if not x:
        return Buckets(rng.normal(size=(bands, bits, 1)), np.zeros((bands, bits)), 1, metric, 1.0)
    x = _matrix(x, metric)
    directions = rng.normal(size=(bands, bits, x.shape[1]))
    index = Buckets(directions, np.median(np.einsum("nd,tbd->ntb", x, directions), axis=0), 1, metric, 1.0)
    sides = index.sides(x)
    own, asking = index.buckets(sides), np.arange(min(ASKING, len(x)))
    far = (x**2).sum(1) - 2 * x[asking] @ x.T
    far[asking, asking] = np.inf
    nearest = np.argsort(far, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    # The place of the first probe that meets a neighbour in any band.
    probes = index.probe(sides[asking], 1 << bits)
    met = (own[nearest][:, :, :, None] == probes[:, None]).any(axis=2)
    first = np.where(met.any(axis=2), met.argmax(axis=2), probes.shape[2]).ravel()
    if not len(first):
        return index
    needed = int(np.quantile(first, recall, method="higher")) + 1
    needed = min(needed, probes.shape[2])
    return Buckets(directions, index.thresholds, needed, metric, float((first < needed).mean()))
