"""Hard-negative mining: exact inner products behind bounds from segment summaries.

Vectors are cut into segments of SEGMENT components, and the mean and the deviation (the norm
of what is left without the mean) of every segment are stored beside the vector. Two segments'
product lies within their means' product times the length, plus or minus the product of their
deviations. Summaries of twice the length follow from those of two neighbours, so a search
starts with one long segment, drops rows whose bounds say that they cannot be among the
wanted ones, halves the segments, and takes exact products of the rows that are left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import sliced, small_batches

#: Components of the shortest segments, and components that a block of vectors holds.
SEGMENT, BLOCK = 8, 1 << 20
POSITIVES, NEGATIVES = 5, 3
#: Per cent of a positive's score between which the score of its hard negatives lies.
LEAST, MOST = 50, 95
#: Components are multiplied by this and rounded down.
SCALE = 256
_STORED = "id bigint, row bigint, label string, v array<bigint>, whole int, asks boolean, mean array<double>, deviation array<double>"


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values one after another, where each row's begin and the last ends)."""
    ends = np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)))
    return column.flatten().to_numpy(zero_copy_only=False), ends


def summaries(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, deviations, where each row's segments begin) of rows of whole numbers; the last segment is filled with zeros."""
    width = np.diff(ends)
    many = -(-width // SEGMENT)
    first = np.append(0, np.cumsum(many))
    place = np.arange(len(values)) - np.repeat(ends[:-1], width)
    segment = np.repeat(first[:-1], width) + place // SEGMENT
    mean = np.bincount(segment, values, first[-1]) / SEGMENT
    rest = np.bincount(segment, (values - mean[segment]) ** 2, first[-1])
    filled = SEGMENT - np.bincount(segment, minlength=first[-1])
    return mean, np.sqrt(rest + filled * mean**2), first


def _summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        values, ends = _lists(batch.column(3))
        mean, deviation, first = summaries(values, ends)
        listed = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(x, pa.float64())) for x in (mean, deviation)]
        yield pa.record_batch([*batch.columns, *listed], names=[*batch.schema.names, "mean", "deviation"])


class Vectors:
    """A block of rows: vectors and the summaries of their segments, longest segments first."""

    def __init__(self, rows: pa.Table, width: int) -> None:
        column = lambda name: rows.column(name).combine_chunks()
        self.id, self.row = (rows.column(c).to_numpy() for c in ("id", "row"))
        self.label = column("label")
        many = 1
        while many * SEGMENT < width:
            many *= 2
        fill = lambda name, size: self._matrix(*_lists(column(name)), size)
        self.v = fill("v", many * SEGMENT)
        mean, rest, length = fill("mean", many), fill("deviation", many) ** 2, SEGMENT
        self.levels = [(mean * length**0.5, rest**0.5)]
        while mean.shape[1] > 1:
            a, b = mean[:, ::2], mean[:, 1::2]
            mean, rest = (a + b) / 2, rest[:, ::2] + rest[:, 1::2] + length * (a - b) ** 2 / 2
            length *= 2
            self.levels.insert(0, (mean * length**0.5, rest**0.5))
        self.norm = np.sqrt((self.v.astype(float) ** 2).sum(axis=1))

    @staticmethod
    def _matrix(values: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros((len(ends) - 1, size), values.dtype)
        many = np.diff(ends)
        out[np.repeat(np.arange(len(many)), many), np.arange(len(values)) - np.repeat(ends[:-1], many)] = values
        return out


def _greatest(x: np.ndarray, k: int) -> float:
    """The k-th greatest value; without limit where there are fewer."""
    return np.partition(x, len(x) - k)[len(x) - k] if len(x) >= k else -np.inf


def _refined(anchors: Vectors, i: int, rows: Vectors, left: np.ndarray, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rows that bounds on all levels leave, their scores) of the rows `left` for one anchor."""
    slack = 1e-9 * anchors.norm[i] * rows.norm.max(initial=0.0) + 1e-6
    for (mean, deviation), (own_mean, own_deviation) in zip(rows.levels, anchors.levels, strict=True):
        middle, reach = mean[left] @ own_mean[i], deviation[left] @ own_deviation[i] + slack
        left = left[keep(middle - reach, middle + reach)]
    return left, rows.v[left] @ anchors.v[i]


def _first(rows: Vectors, at: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((rows.row[at], rows.id[at], -score))[:k]


def _both(left: pa.Table, right: pa.Table) -> tuple[Vectors, Vectors]:
    width = max(int(t.column("v").combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max(initial=0)) for t in (left, right))
    return Vectors(left, width), Vectors(right, width)


def _positives(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        anchors, rows = _both(left, right)
        found = []
        for i in range(len(anchors.id)):
            others = np.flatnonzero((rows.id != anchors.id[i]) | (rows.row != anchors.row[i]))
            at, score = _refined(anchors, i, rows, others, lambda low, high: high >= _greatest(low, k))
            first = _first(rows, at, score, k)
            found.append((np.full(len(first), i), at[first], score[first]))
        i, at, score = (np.concatenate([f[c] for f in found] or [np.zeros(0, np.int64)]) for c in range(3))
        return pa.table({"id": anchors.id[i], "row": anchors.row[i], "positive_id": rows.id[at], "positive_row": rows.row[at], "positive_score": score})

    return run


def _negatives(k: int, least: int, most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        anchors, rows = _both(left, right)
        wanted = left.column("wanted").to_pylist()
        label = pa.concat_arrays([anchors.label, rows.label]).dictionary_encode().indices.to_numpy()
        label, own = label[len(anchors.id) :], label[: len(anchors.id)]
        found = []
        for i, scores in enumerate(wanted):
            # A window of scores for every different score of a positive.
            spans = [(p, -(-least * p // 100), most * p // 100) for p in sorted(set(scores)) if least * p <= most * p]

            def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
                out = np.zeros(len(low), bool)
                for _, a, b in spans:
                    inside = _greatest(low[(low >= a) & (high <= b)], k)
                    out |= (high >= max(a, inside)) & (low <= b)
                return out

            at, score = _refined(anchors, i, rows, np.flatnonzero(label != own[i]), keep)
            for p, a, b in spans:
                held = np.flatnonzero((score >= a) & (score <= b))
                held = held[_first(rows, at[held], score[held], k)]
                found.append((np.full(len(held), i), np.full(len(held), p), at[held], score[held]))
        i, p, at, score = (np.concatenate([f[c] for f in found] or [np.zeros(0, np.int64)]) for c in range(4))
        return pa.table({"id": anchors.id[i], "row": anchors.row[i], "positive_score": p, "negative_id": rows.id[at], "negative_row": rows.row[at], "negative_score": score})

    return run


def _meet(anchors: DataFrame, rows: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], out: str) -> DataFrame:
    """Every block of a part's anchors with every block of its rows."""
    rows = rows.select(*[F.col(c).alias(c) for c in rows.columns])  # columns of its own: both sides come from one table
    sized = lambda df, name: df.groupBy("part").agg(F.ceil(F.sum(F.size("v") + 1) / BLOCK).alias(name))
    parts = materialise(sized(anchors, "anchor_blocks").join(sized(rows, "row_blocks"), "part"), "negatives-parts")
    blocks = parts.agg(F.sum(F.col("anchor_blocks") * F.col("row_blocks"))).first()[0] or 1
    own = lambda n: F.pmod(F.xxhash64("id", "row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    keys = ["part", "anchor_block", "row_block"]
    # So many partitions at most; their work follows the pairs and not the bytes that Spark would merge them by.
    dealt = lambda df: df.drop("anchor_blocks", "row_blocks").repartition(int(min(blocks, 8192)), *keys).groupBy(*keys)
    left = anchors.join(parts, "part").withColumn("anchor_block", own("anchor_blocks")).withColumn("row_block", every("row_blocks"))
    right = rows.join(parts, "part").withColumn("row_block", own("row_blocks")).withColumn("anchor_block", every("anchor_blocks"))
    return dealt(left).cogroup(dealt(right)).applyInArrow(run, out)


def mine(vectors: DataFrame, anchors: Callable[[Column], Column], id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows whose id `anchors` holds for.

    Components are scaled and rounded down; a score is the inner product of the whole numbers
    (a shorter vector is filled with zeros), higher scores come first, equal ones go by the
    smaller id. An anchor's positives are its first other rows of the same label; its hard
    negatives for a positive are the first rows of other labels whose score is `least` to `most`
    per cent of the positive's. Rows with a null id, label or vector or with a component that
    is null or not finite take no part. Rows that repeat in id, label and vector count once;
    rows that share an id only are rows of their own. An anchor without another row of its label,
    a positive without a row in its range and an empty table give no rows. Scores are exact
    below 2^63. Other columns are not read. All rows of other labels are searched for every
    anchor, block by block: anchors x rows pairs of bounds.
    """
    small_batches(vectors.sparkSession)
    broken = F.exists(vector_col, lambda x: F.coalesce(F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")), F.lit(True)))
    usable = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & ~broken
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale))
    rows = vectors.filter(usable).select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(label_col, whole).alias("row"), F.col(label_col).cast("string").alias("label"), whole.alias("v"))
    # One part for all rows, written as data: a constant would make the search a join without a key.
    rows = rows.dropDuplicates().withColumn("whole", F.lit(0)).withColumn("asks", F.coalesce(anchors(F.col("id")), F.lit(False)))
    stored = materialise(rows.mapInArrow(_summarised, _STORED), "negatives-segments")
    asking, searched = stored.filter("asks").drop("asks"), stored.drop("asks")

    near = _meet(
        asking.withColumn("part", F.col("label")), searched.withColumn("part", F.col("label")), _positives(positives),
        "id bigint, row bigint, positive_id bigint, positive_row bigint, positive_score bigint",
    )
    best = Window.partitionBy("id", "row").orderBy(F.desc("positive_score"), "positive_id", "positive_row")
    near = materialise(near.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= positives).drop("place"), "negatives-positives")
    wanted = near.groupBy("id", "row").agg(F.collect_list("positive_score").alias("wanted"))
    hard = _meet(
        asking.join(wanted, ["id", "row"]).withColumn("part", F.col("whole")), searched.withColumn("part", F.col("whole")), _negatives(negatives, least, most),
        "id bigint, row bigint, positive_score bigint, negative_id bigint, negative_row bigint, negative_score bigint",
    )
    order = Window.partitionBy("id", "row", "positive_score").orderBy(F.desc("negative_score"), "negative_id", "negative_row")
    hard = hard.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return near.join(hard, ["id", "row", "positive_score"]).select(F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
