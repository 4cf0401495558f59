"""SimHash fingerprints linked by pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise, sized, within
from .common import fresh, sliced, small_batches
from .components import components

SEED = 42
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CHUNK = 1 << 15
#: Candidates of near_duplicates share a band of so many drawn shingles; so many bands are tried.
BANDS, BAND_ROWS = 24, 3
#: Draws differ from the fingerprints' hashes.
_DRAWS = np.array([[(0xD1B54A32D192ED03 * (i + 1)) & 0xFFFFFFFFFFFFFFFF] for i in range(BANDS * BAND_ROWS)], np.uint64)
#: Classes of a bucket that one comparison holds; a larger bucket is cut in tiles, and every two tiles meet.
TILE = 4096
#: Differing bits of 6 x 64 that stand for a similarity of 0.8: 58 on average, 7 the deviation, so about one deviation more.
MAX_BITS = 66
#: Larger buckets, or fingerprints of rows, that may be sent to every task; more are joined by shuffle.
MAX_SENT = 200_000


def _mixed(h: np.ndarray, salt: int | np.ndarray) -> np.ndarray:
    """Independent 64-bit hashes from hashes (a multiply-xorshift mix); salt 0 keeps them, an array is used as it is."""
    if isinstance(salt, int):
        if not salt:
            return h
        salt = np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    h = h ^ salt
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _shingles(text: str | None, shingle: int) -> np.ndarray | None:
    """XXH64 of every word shingle of a text, in order and with repeats; None without words."""
    flat = b" ".join((text or "").encode().translate(_LOWER).split())
    if not flat:
        return None
    gaps = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(flat)]))
    width = min(shingle, len(starts))
    spans = zip(starts[: len(starts) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(flat[a:b], SEED) for a, b in spans), np.uint64, len(starts) - width + 1)


def _prints(hashes: np.ndarray | None, tables: int) -> np.ndarray:
    """Signed 64-bit fingerprints of a text's shingles; bits are summed in bounded chunks."""
    if hashes is None:
        return np.zeros(tables, np.int64)
    sums = np.zeros((tables, 64), np.int64)
    for at in range(0, len(hashes), _CHUNK):
        h = hashes[at : at + _CHUNK]
        for t in range(tables):
            bits = np.unpackbits(_mixed(h, t).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums[t] += bits.sum(axis=0, dtype=np.uint32)
    packed = np.packbits((sums * 2 > len(hashes)).astype(np.uint8), axis=1, bitorder="little")
    return packed.view(np.int64).ravel()


def text_fingerprints(text: str | None, shingle: int, tables: int) -> list[int]:
    """Signed 64-bit fingerprints of one text."""
    return _prints(_shingles(text, shingle), tables).tolist()


def _bands(hashes: np.ndarray | None, bands: int = BANDS, rows: int = BAND_ROWS) -> np.ndarray:
    """Keys of `bands` bands of `rows` shingles each, drawn alike from texts that weigh shingles alike.

    Each draw takes the shingle of least E / count², E an exponential variable made of its
    hash: shingles are drawn with the weight they have in the cosine a fingerprint measures,
    at any length. Texts without repeats draw the same shingle as often as their sets are alike.
    """
    if hashes is None:
        return np.zeros(bands, np.int64)
    seen, counts = np.unique(hashes, return_counts=True)
    once = counts.max() == 1
    weights = counts.astype(np.float64) ** 2
    n = bands * rows
    least, drawn = np.full(n, np.inf), np.zeros(n, np.uint64)
    step = max(1, _CHUNK // n)
    for at in range(0, len(seen), step):
        mixed = _mixed(seen[at : at + step][None, :], _DRAWS[:n])
        order = mixed if once else -np.log1p(-mixed.astype(np.float64) * 2.0**-64 * (1 - 2.0**-53)) / weights[at : at + step]
        best = order.argmin(axis=1)
        value, mine = order[np.arange(n), best].astype(np.float64), mixed[np.arange(n), best]
        better = value < least
        least[better], drawn[better] = value[better], mine[better]
    keys = np.zeros(bands, np.uint64)
    for part in drawn.reshape(bands, rows).T:
        keys = _mixed(keys ^ part, 1)
    return keys.view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = 4, tables: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fps array<long>) per row: `tables` independent fingerprints over word shingles.

    Shingles are counted with repeats; table 0 uses XXH64 with seed 42. A null or wordless
    text has fingerprints of zero. Other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            fps = [text_fingerprints(t.as_py(), shingle, tables) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(fps, pa.list_(pa.int64()))], names=["id", "fps"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fps array<bigint>")


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _plan(blocks: int, whole: int) -> tuple[list[int], list[list[int]]]:
    """Masks of every choice of `whole` blocks, and for each the earlier blocks it leaves out."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    parts = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    masks, before = [], []
    for choice in combinations(range(blocks), whole):
        masks.append(_signed(sum(parts[i] for i in choice)))
        before.append([_signed(parts[i]) for i in range(choice[-1]) if i not in choice])
    return masks, before


def _keyed(rows: DataFrame, fp: Column, masks: list[int], carry: list[str]) -> DataFrame:
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), fp.bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(masks)])
    return rows.select(*carry, F.explode(keys).alias("k")).select(*carry, "k.choice", "k.part")


def close_pairs(fps: DataFrame, max_bits: int = 4, blocks: int = 7) -> DataFrame:
    """Pairs (a < b) of distinct fingerprints in column fp that differ in at most max_bits bits.

    With more blocks than differing bits, `blocks - max_bits` blocks are equal in every close
    pair, so an equi-join on each choice of that many blocks finds all of them (no sampling,
    no cap). The condition keeps a pair only under the first choice that holds it, so each
    link appears once. Both sides are shuffled: Spark takes a side for as small as the table
    was before it grew by the number of choices, and would send it to all tasks by way of the
    driver. Key partitions that grow hot are split by adaptive skew joins.
    """
    masks, before = _plan(blocks, blocks - max_bits)
    keyed = _keyed(fps.select("fp"), F.col("fp"), masks, ["fp"])
    left = keyed.select(F.col("fp").alias("a"), "choice", "part")
    right = keyed.select(F.col("fp").alias("b"), "choice", "part")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    left_out = F.element_at(F.array(*[F.array(*map(F.lit, b)) if b else F.array().cast("array<bigint>") for b in before]), left["choice"] + 1)
    first = F.forall(left_out, lambda m: differ.bitwiseAND(m) != 0)
    on = (left["choice"] == right["choice"]) & (left["part"] == right["part"])
    return left.join(right.hint("merge"), on & (F.col("a") < F.col("b")) & (F.bit_count(differ) <= max_bits) & first).select("a", "b")


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, blocks: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) per row of docs.

    component_id is the least id reachable over links of at most max_bits differing bits.
    Copies meet in one fingerprint before anything is paired, so a group of copies of any
    size is one row of the join. Null texts count as empty, empty texts share fingerprint
    zero and are linked like any other; a null id never names a component unless all are
    null; repeated rows give repeated results; an empty table gives no rows.
    """
    prints = materialise(fingerprints(docs, shingle, 1, id_col, text_col).select("id", F.col("fps")[0].alias("fp")), "simhash-prints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("id").alias("first_id")), "simhash-distinct")
    few = within(prints, MAX_SENT)
    roots = sized(components(close_pairs(distinct, max_bits, blocks), "simhash-links"), few)
    rooted = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(sized(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), few), "root").select("fp", "component_id")
    return prints.join(sized(named, few), "fp").select("id", "fp", "component_id")


def _forest(bits: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that join rows of bits (n x words) into the components of all pairs within max_bits.

    Every row is compared with all rows not reached before it, so no pair that could join
    two components is left out; n - 1 links at most come back.
    """
    links, left = [], np.arange(len(bits))
    while len(left) > 1:
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = np.bitwise_count(bits[left] ^ bits[at]).sum(axis=1, dtype=np.int64) <= max_bits
            if near.any():
                found = left[near].tolist()
                links += [(at, i) for i in found]
                todo += found
                left = left[~near]
    return links


def similar_links(classes: DataFrame, max_bits: int, tile: int = TILE) -> DataFrame:
    """Links (a, b) between keys k of classes (k, bits, bands) whose bits differ in max_bits places at most.

    Classes with a band in common meet in a bucket, where all are compared over all bits;
    the links join the same classes as all close pairs of the bucket. Unrelated texts share
    no band, so buckets hold related texts however many rows there are. A bucket of more
    than `tile` classes is dealt to tiles, and every two tiles are one comparison.
    """
    keyed = classes.select("k", "bits", F.posexplode("bands").alias("band", "part")).select("k", "bits", F.xxhash64("band", "part").alias("bucket"))
    hot = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tile)
    hot = materialise(hot.select("bucket", F.ceil(F.col("n") / tile).cast("int").alias("tiles")), "near-hot")
    dealt = keyed.join(F.broadcast(hot) if within(hot, MAX_SENT) else hot, "bucket", "left")
    own = F.pmod(F.xxhash64("k"), F.col("tiles")).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: F.xxhash64("bucket", F.least(own, j), F.greatest(own, j)))
    cells = dealt.select("k", "bits", F.explode(F.coalesce(met, F.array("bucket"))).alias("cell"))
    small_batches(classes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(keys: np.ndarray, bits: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
            links = [(keys[i], keys[j]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if b - a > 1
                     for i, j in ((x + a, y + a) for x, y in _forest(bits[a:b], max_bits))]
            ends = np.array(links, np.int64).reshape(-1, 2)
            return pa.record_batch([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            bits = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            new = batch.column(0).to_numpy(), bits, batch.column(2).to_numpy()
            held = new if held is None else tuple(map(np.concatenate, zip(held, new, strict=True)))
            if held[2][0] == held[2][-1]:
                continue
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(held[2])) + 1))
            yield compared(held[0], held[1], cuts)
            held = tuple(x[cuts[-1] :] for x in held)
        if held is not None:
            yield compared(held[0], held[1], np.array([0, len(held[0])]))

    return cells.repartition("cell").sortWithinPartitions("cell", "k").mapInArrow(run, "a bigint, b bigint")


def _near_prints(rows: DataFrame, shingle: int, tables: int) -> DataFrame:
    """(row, own, bits, bands) of rows (row, own, text): all fingerprints as binary, and the bands."""
    kind = rows.schema["own"].dataType.simpleString()
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            hashes = [_shingles(t.as_py(), shingle) for t in batch.column(2)]
            bits = pa.array([_prints(h, tables).tobytes() for h in hashes], pa.binary())
            bands = pa.array([_bands(h) for h in hashes], pa.list_(pa.int64()))
            yield pa.record_batch([batch.column(0), batch.column(1), bits, bands], names=["row", "own", "bits", "bands"])

    return rows.select("row", "own", "text").mapInArrow(run, f"row bigint, own {kind}, bits binary, bands array<bigint>")


def keep_first(docs: DataFrame, shingle: int = 5, tables: int = 6, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of docs, one of each group of copies and near copies: the one with the least id.

    Near copies are texts whose sets of 5-word shingles have a similarity of about 0.8 or
    more, seen as at most MAX_BITS differing bits of 6 x 64 and linked over chains;
    candidates are texts with a band of drawn shingles in common. Null texts count as empty and empty texts are copies of each other; a null
    id comes first; of rows repeated as a whole one stays; an empty table gives no rows.
    All columns are kept, and texts are shuffled once.
    """
    own = fresh(docs, "_row")
    rows = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"), F.col(id_col).alias("own"), F.col(text_col).alias("text"))
    prints = _near_prints(rows, shingle, tables).withColumn("k", F.xxhash64("bits"))
    classes = materialise(prints.groupBy("k").agg(F.min(F.struct("bits", "bands")).alias("p"), F.min(F.struct("own", "row")).alias("first")).select("k", "p.*", "first"), "near-classes")
    roots = components(similar_links(classes, max_bits), "near-links")
    rooted = classes.select("k", "first").join(roots, F.col("k") == F.col("node"), "left").select(F.coalesce("root", "k").alias("root"), "first")
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(own))
    keyed = docs.withColumn(own, F.xxhash64(F.col(id_col), F.col(text_col)))
    return keyed.join(kept, own).dropDuplicates([own]).select(*docs.columns)


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
