"""Registered queries: the streaming feeds, run over what the tables hold (T)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import scratch_path, stored_small
from ..streaming import feeds as T
from . import inputs as I
from .account_queries import RATE_SQL
from .catalog import query
from .corpus_queries import pages_of


def _stream(spark, d, name):
    """A driver table as a file stream."""
    schema = I.table(spark, d, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _raw_stream(spark, d):
    """Raw events as a stream of five batches or more; the newest day comes first, so most rows are late."""
    path = scratch_path(spark, "raw-events")
    raw = I.raw_events(spark, d).withColumn("age", F.ntile(5).over(W.partitionBy(F.pmod("seq", F.lit(64))).orderBy(F.desc("ts"), "seq")))
    for part in range(1, 6):
        raw.filter(F.col("age") == part).drop("age").write.mode("append").parquet(path)
    files = len(spark.read.parquet(path).inputFiles())
    return spark.readStream.schema(raw.drop("age").schema).option("maxFilesPerTrigger", max(1, files // 5)).parquet(path)


def _finish(q):
    q.awaitTermination()
    if q.exception():
        raise q.exception()


@query(
    "t01_watch_reports",
    "SELECT report || '::' || id AS chunk_id, report, page, id, text, CAST(max(page) OVER (PARTITION BY report) AS INTEGER) AS pages FROM doc_chunks",
    uses=("doc_chunks",),
)
def _(spark, d):
    folder, out, check = (scratch_path(spark, n) for n in ("pages-in", "index", "ck"))
    pages = pages_of(I.table(spark, d, "documents")).withColumn("mtime", F.lit("2024-01-01").cast("timestamp")).withColumn("stem", F.col("report"))
    # The folder gets a report's pages over several files and batches, then half of them again.
    pages.repartition(6, F.xxhash64("page")).write.partitionBy("stem").json(folder, compression="gzip")
    files = len(spark.read.schema(T.PAGE_SCHEMA).json(folder).inputFiles())
    watch = lambda: _finish(T.watch_reports(spark, folder, out, check, every=None, files_per_batch=max(1, files // 3)))
    watch()
    again = pages.filter(F.col("report").rlike("[02468]$"))
    again.hint("rebalance", "report").write.mode("append").partitionBy("stem").json(folder, compression="gzip")
    watch()
    pages = stored_small(T.indexed_reports(spark, out).select(F.col("stem").alias("report"), "pages"), "report-pages")
    chunks = T.indexed_chunks(spark, out).join(pages, "report")
    return chunks.select(F.concat_ws("::", "report", F.col("id").cast("string")).alias("chunk_id"), "report", "page", "id", "text", "pages")


@query("t02_ingest_events", "SELECT seq, event_type, ip_hash, device, city, company FROM ev", uses=("ev",))
def _(spark, d):
    out, check = scratch_path(spark, "events"), scratch_path(spark, "ck")
    _finish(T.ingest_events(_raw_stream(spark, d), I.geo_dim(spark, d), I.HASH_KEY, out, check))
    return spark.read.parquet(out).select("seq", "event_type", "ip_hash", "device", "city", F.col("meta.company").alias("company"))


@query("t03_daily_counts", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM ev GROUP BY 1, 2", uses=("ev",))
def _(spark, d):
    out, check = scratch_path(spark, "daily"), scratch_path(spark, "ck")
    _finish(T.windowed_counts(_raw_stream(spark, d), out, check, "1 day"))
    return T.window_totals(spark, out).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


@query("t03_hourly_counts", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM ev GROUP BY 1, 2", uses=("ev",))
def _(spark, d):
    out, check = scratch_path(spark, "hourly"), scratch_path(spark, "ck")
    _finish(T.windowed_counts(_raw_stream(spark, d), out, check, "1 hour"))
    return T.window_totals(spark, out).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


@query("t04_rate_limiter", RATE_SQL.format(limit=3, window=43200))
def _(spark, d):
    out, check = scratch_path(spark, "limits"), scratch_path(spark, "ck")
    hits = _stream(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("hit_id"), F.col("ts").cast("timestamp").alias("ts"))
    _finish(T.write_decisions(T.rate_limit_stream(hits, 3, 43200), out, check))
    return spark.read.parquet(out).select("key", "hit_id", "accepted")


@query("t05_daily_quota", "SELECT user_id, event_id AS attempt_id, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) <= 2 AS accepted FROM events")
def _(spark, d):
    out, check = scratch_path(spark, "quota"), scratch_path(spark, "ck")
    rows = _stream(spark, d, "events").select("user_id", F.col("event_id").alias("attempt_id"), F.col("ts").cast("timestamp").alias("ts"))
    _finish(T.write_decisions(T.quota_stream(rows, 2), out, check))
    return spark.read.parquet(out).select("user_id", "attempt_id", "accepted")


@query(
    "t06_failing_addresses",
    "SELECT ip_hash, count(*) AS failed, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_seen FROM ev WHERE event_type = 'login_attempt' AND NOT ok AND ip_hash IS NOT NULL GROUP BY 1",
    uses=("ev",),
)
def _(spark, d):
    from ..operators.events import enrich_events

    out, check = scratch_path(spark, "failing"), scratch_path(spark, "ck")
    events = enrich_events(_raw_stream(spark, d), I.geo_dim(spark, d), I.HASH_KEY)
    _finish(T.failing_address_counts(events, out, check))
    df = T.failing_address_totals(spark, out)
    return df.withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
