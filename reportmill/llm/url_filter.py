"""URL verdicts: prefix rules first, then a block list behind a blocked Bloom filter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: (verdict, host, path prefix).
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
#: Words of hosts that spread spam; their pages make up the block list of the registered query.
SPAM_HOST = r"(^|[.-])(casino|pills|bets|adult|spam|ads)[-.]"
#: A filter block is 8 words of 32 bits; one bit is set in each word.
LANES = 8
MAX_BLOCKS = 1 << 19  # 16 MiB: the filter never grows beyond this, so neither does its broadcast
KEYS_PER_BLOCK = 20
_ODD = np.array([0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], np.uint64)


def host_of(url: Column) -> Column:
    """Text between the first :// and the next /, ? or #, with A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_replace(_after_scheme(url), r"(?s)[/?#].*$", ""))


def path_of(url: Column) -> Column:
    """Text from the host's end up to ? or #; empty where a url is null or has no ://."""
    rest = _after_scheme(url)
    return F.regexp_replace(F.regexp_replace(rest, r"(?s)[?#].*$", ""), r"^[^/]*", "")


def _after_scheme(url: Column) -> Column:
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    return F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))


def canonical(url: Column) -> Column:
    """Address without scheme, query, fragment, www./m. label, .html ending and closing slashes."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/+$", ""), r"\.html?$", "")
    return F.concat(host, path)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule for the host or a domain above it; else null."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, prefix in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(prefix)
        chosen = F.when(fits, F.struct(F.lit(f"{name}{prefix}").alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def _blocks_for(n: int) -> int:
    blocks = 1
    while blocks < MAX_BLOCKS and blocks * KEYS_PER_BLOCK < n:
        blocks *= 2
    return blocks


def _lanes(h: Column) -> list[Column]:
    """Bit to set in each word of a block, from the low 31 bits of the key's hash."""
    low = h.bitwiseAND(F.lit(0x7FFFFFFF))
    return [F.shiftright((low * F.lit(int(odd))).bitwiseAND(F.lit(0xFFFFFFFF)), 27).cast("int") for odd in _ODD]


def build_filter(listed: DataFrame, key: str) -> np.ndarray:
    """Bit table (blocks x LANES) of a listed column; words are OR-ed by Spark, block by block.

    Its size follows the list up to MAX_BLOCKS; beyond that it lets more rows through, which
    the exact join removes.
    """
    blocks = _blocks_for(listed.count())
    h = F.xxhash64(key)
    lanes = [F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit)).alias(f"w{i}") for i, bit in enumerate(_lanes(F.col("h")))]
    rows = listed.select(h.alias("h")).groupBy(F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(blocks - 1)).alias("block")).agg(*lanes)
    bits = np.zeros((blocks, LANES), np.uint32)
    found = rows.toPandas()
    bits[found["block"].to_numpy()] = found[[f"w{i}" for i in range(LANES)]].to_numpy().astype(np.uint32)
    return bits


def may_hold(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """False where a hashed key is certainly not listed."""
    h = hashes.astype(np.int64).view(np.uint64)
    rows = bits[((h >> np.uint64(32)) & np.uint64(len(bits) - 1)).astype(np.int64)]
    lanes = (((h & np.uint64(0x7FFFFFFF))[:, None] * _ODD) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)
    return ((rows >> lanes.astype(np.uint32)) & 1).all(axis=1)


def judge(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", listed_col: str = "url", rules=RULES) -> DataFrame:
    """(id, host, path, rule, verdict) per row.

    A rule decides where one fits; for other rows the canonical address is tested against
    the Bloom filter of the listed addresses (broadcast, at most 16 MiB), and only possible
    hits go to the exact join, whose answer is final: block if listed, else allow. A null
    url or one without :// has an empty host and path and is allowed. Repeated rows repeat.
    Rows that cannot be listed never meet the join, and listed addresses are distinct.
    """
    addresses = listed.select(canonical(F.col(listed_col)).alias("address")).filter("address <> ''").distinct()
    table = pages.sparkSession.sparkContext.broadcast(build_filter(addresses, "address"))

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = may_hold(table.value, batch.column("h").to_numpy(zero_copy_only=False))
            yield pa.record_batch([*batch.columns, pa.array(hits)], names=[*batch.schema.names, "possible"])

    url = F.col(url_col)
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("address"))
    rows = rows.withColumn("h", F.xxhash64("address"))
    tested = rows.mapInArrow(possible, f"id {kind}, host string, path string, address string, h bigint, possible boolean")
    ruled = tested.withColumn("fit", rule_for(F.col("host"), F.col("path"), rules)).select(
        "id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("fixed"),
        F.when(F.col("possible") & F.col("fit").isNull() & (F.col("address") != ""), F.col("address")).alias("address"),
    )
    sure, asked = ruled.filter("address is null"), ruled.filter("address is not null")
    answered = asked.join(addresses.withColumn("listed", F.lit(True)), "address", "left")
    return sure.select("id", "host", "path", "rule", F.coalesce("fixed", F.lit("allow")).alias("verdict")).union(
        answered.select("id", "host", "path", "rule", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))
    )


def spam_pages(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Rows whose host holds a spam word: the block list of the registered query."""
    return pages.filter(host_of(F.col(url_col)).rlike(SPAM_HOST))
