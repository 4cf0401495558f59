"""Daily sketches of the event log that merge over any range of days.

Per day and event type: how many events, which addresses (HyperLogLog), the latencies (KLL
quantiles) and the frequent values of some meta fields. A range of days costs a merge of
small sketches instead of a scan of the log; the exact views stay where an error is not wanted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.runs import RunTable, folded
from .events import some

#: Meta fields whose frequent values are kept, and values that a sketch can hold.
FIELDS, VALUES = ("company", "year", "sector", "report"), 4096
#: Size of an address sketch (2 ** HLL_BITS registers) and of a latency sketch.
HLL_BITS, KLL_SIZE = 14, 400
#: Errors that hold with all but certainty: relative for addresses (four deviations), by rank for latencies.
VISITOR_ERROR, RANK_ERROR = 0.033, 0.015
_MERGE = {"n": "sum", "visitors": "hll_union_agg", "latency": "kll_merge_agg_double"} | {f"top_{f}": "approx_top_k_combine" for f in FIELDS}


def daily_sketches(events: DataFrame) -> DataFrame:
    """(day, event_type, n, visitors, latency, top_<field> ...) of enriched events; blank values and addresses are left out."""
    latency = F.when(F.col("meta.latency_ms") >= 0, F.col("meta.latency_ms"))
    rows = events.select(
        F.to_date("ts").alias("day"), "event_type", some("ip_hash").alias("ip_hash"), latency.cast("double").alias("latency"),
        *[some(F.col(f"meta.{f}").cast("string")).alias(f) for f in FIELDS],
    )
    return rows.groupBy("day", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("ip_hash", HLL_BITS).alias("visitors"), F.kll_sketch_agg_double("latency", F.lit(KLL_SIZE)).alias("latency"),
        *[F.expr(f"approx_top_k_accumulate({f}, {VALUES}) FILTER (WHERE {f} IS NOT NULL)").alias(f"top_{f}") for f in FIELDS],
    )


def sketch_table(spark: SparkSession, path: str, sketches: DataFrame) -> RunTable:
    """Where daily sketches are kept; a day that comes in pieces is merged like any two days."""
    return RunTable(spark, path, sketches.schema, folded(["day", "event_type"], **_MERGE), "event_type")


def merged(sketches: DataFrame, *keys: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Sketches of a range of days (`until` included), per event type or per any other of their columns."""
    rows = sketches
    if since is not None:
        rows = rows.filter(F.col("day") >= F.lit(since).cast("date"))
    if until is not None:
        rows = rows.filter(F.col("day") <= F.lit(until).cast("date"))
    return rows.groupBy(*keys).agg(*[F.call_function(how, F.col(c)).alias(c) for c, how in _MERGE.items()])


def visitor_estimates(sketches: DataFrame) -> DataFrame:
    """Every column but the sketches, with the events and about how many addresses they came from."""
    keys = [c for c in sketches.columns if c not in _MERGE]
    return sketches.select(*keys, "n", F.hll_sketch_estimate("visitors").alias("visitors"))


def latency_quantiles(sketches: DataFrame, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """(..., share, value): the latency below which about that share of the values lies."""
    keys = [c for c in sketches.columns if c not in _MERGE]
    listed = F.array(*[F.struct(F.lit(s).alias("share"), F.kll_sketch_get_quantile_double("latency", F.lit(s)).alias("value")) for s in shares])
    rows = sketches.filter(F.kll_sketch_get_n_double("latency") > 0)
    return rows.select(*keys, F.explode(listed).alias("q")).select(*keys, "q.share", "q.value")


def top_values(sketches: DataFrame, field: str, limit: int = 20) -> DataFrame:
    """(..., value, count) of the most frequent values; counts are exact while a sketch holds all values that occur."""
    keys = [c for c in sketches.columns if c not in _MERGE]
    items = F.expr(f"approx_top_k_estimate(top_{field}, {VALUES})")
    rows = sketches.select(*keys, F.explode(items).alias("x")).select(*keys, F.col("x.item").alias("value"), F.col("x.count").alias("count"))
    return rows.orderBy(F.desc("count"), "value").limit(limit)
