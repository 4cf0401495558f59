"""Structured Streaming forms of the live feeds.

Every feed takes a streaming DataFrame (or a folder to watch) and writes files. What a batch
adds to a growing result is one run of a `RunTable`: replayed batches overwrite their own
run, and runs are folded as they gather. Counts are partial sums that merge in any order, so a
row counts however late it comes; rows behind the watermark are listed besides.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from heapq import merge as merged

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.accounts import DAILY_QUOTA, RATE_LIMIT, RATE_WINDOW_SECONDS
from ..operators.corpus import chunk_pages, pending_sources, report_stats, split_failures
from ..operators.events import _blank, enrich_events
from ..session import stored_small
from ..sources.runs import RunTable, every_row, folded, newest

PAGE_SCHEMA = "report STRING, page INT, text STRING, source STRING, mtime TIMESTAMP"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start(writer, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Start with a processing-time trigger, or take what is there and stop."""
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    return writer.start()


def _index_tables(spark: SparkSession, out: str) -> dict[str, RunTable]:
    """Pages, chunks, registry rows and failures of the watched reports, all by the bucket of the report."""
    table = lambda name, schema, merge, key: RunTable(spark, f"{out}/{name}", schema, merge, key)
    return {
        "pages": table("pages", "report STRING, page INT, text STRING, source STRING", every_row, "report"),
        "chunks": table("chunks", "id BIGINT, page INT, report STRING, text STRING, source STRING, batch BIGINT", newest("report"), "report"),
        "registry": table("registry", "stem STRING, pages INT, chunks BIGINT, batch BIGINT", newest("stem"), "stem"),
        "failed": table("failed", "stem STRING, mtime TIMESTAMP, error STRING", every_row, "stem"),
    }


def watch_reports(spark: SparkSession, folder: str, out: str, checkpoint: str, every: str | None = "4 seconds", files_per_batch: int = 1000) -> StreamingQuery:
    """Index reports whose page files (JSON lines) arrive in a folder, in any number of batches.

    A page counts once, however often it arrives. A report that gets new pages is chunked
    anew from its stored and its new pages; that version replaces the older ones
    (`indexed_chunks`, `indexed_reports`). A batch reads the buckets of its own reports, not the
    history. A report with an unreadable page in a batch takes none of that batch's pages and
    is not tried again at the same modification time.
    """
    pages = spark.readStream.schema(PAGE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)

    def index(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        tables = _index_tables(own, out)
        batch = batch.persist()
        stored = tables["pages"].read(batch, "report", number)
        fresh = batch.withColumn("stem", F.col("report"))
        fresh = pending_sources(fresh, fresh.select("stem").filter(F.lit(False)), tables["failed"].read(batch, "report", number))
        good, bad = split_failures(fresh)
        new = good.select("report", "page", "text", "source").join(stored.select("report", "page"), ["report", "page"], "left_anti").distinct()
        times = fresh.groupBy("stem").agg(F.max("mtime").alias("mtime"))
        tables["failed"].add(bad.select(F.col("report").alias("stem"), "error").join(times, "stem"), number)
        tables["pages"].add(new, number)
        batch.unpersist()
        changed = stored_small(tables["pages"].batch(number).select("report").distinct(), "changed")
        both = tables["pages"].read(changed, "report", number + 1)
        tables["chunks"].add(chunk_pages(both.join(changed, "report", "left_semi")), number)
        chunks = tables["chunks"].batch(number)
        tables["registry"].add(report_stats(chunks, chunks.select("report").filter(F.lit(False))).drop("csv_rows"), number)

    return start(pages.writeStream.foreachBatch(index), checkpoint, every)


def indexed_reports(spark: SparkSession, out: str) -> DataFrame:
    """Newest registry row per report, with the batch that wrote it."""
    return _index_tables(spark, out)["registry"].read()


def indexed_chunks(spark: SparkSession, out: str) -> DataFrame:
    """Chunks of the newest version of every report."""
    return _index_tables(spark, out)["chunks"].read().drop("batch")


def ingest_events(raw: DataFrame, geo: DataFrame, key: str, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Enrich incoming events and append them by day."""
    events = enrich_events(raw, geo, key).withColumn("day", F.to_date("ts"))
    return start(events.writeStream.format("parquet").partitionBy("day").outputMode("append").option("path", out), checkpoint, every)


def _seen(spark: SparkSession, out: str) -> RunTable:
    return RunTable(spark, f"{out}/seen", "name STRING, newest TIMESTAMP", folded(["name"], newest="max"), "name", 1)


def _late(spark: SparkSession, out: str, keys: str) -> RunTable:
    return RunTable(spark, f"{out}/late", f"ts TIMESTAMP, start TIMESTAMP, {keys}, batch BIGINT", every_row, "start")


def _merge_counts(events: DataFrame, out: str, checkpoint: str, every: str | None, width: str, lateness: str, key: str, table: Callable[[SparkSession, str], RunTable], parts: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Add every batch's partial counts by window; list its rows that were behind the watermark.

    The watermark of a batch is the newest time of all batches before it, less the lateness.
    No state is kept between batches but the table, so a window never closes.
    """
    def save(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        seen = _seen(own, out)
        before = seen.read(before=number).first()
        batch = batch.withColumn("start", F.window("ts", width)["start"]).persist()
        late = F.lit(False) if before is None else F.col("ts") < F.lit(before["newest"]) - F.expr(f"INTERVAL {lateness}")
        _late(own, out, f"{key} STRING").add(batch.filter(late).select("ts", "start", key), number)
        table(own, out).add(parts(batch), number)
        seen.add(batch.agg(F.lit("ts").alias("name"), F.max("ts").alias("newest")).filter(F.col("newest").isNotNull()), number)
        batch.unpersist()

    return start(events.filter(F.col("ts").isNotNull()).writeStream.foreachBatch(save), checkpoint, every)


def late_rows(spark: SparkSession, out: str, key: str) -> DataFrame:
    """(ts, start, key, batch) of rows that came behind the watermark; the counts of their windows hold them."""
    return _late(spark, out, f"{key} STRING").read()


def _type_counts(spark: SparkSession, out: str) -> RunTable:
    return RunTable(spark, f"{out}/counts", "start TIMESTAMP, event_type STRING, n BIGINT", folded(["start", "event_type"], n="sum"), "start")


def windowed_counts(events: DataFrame, out: str, checkpoint: str, width: str = "1 day", lateness: str = "2 days", every: str | None = None) -> StreamingQuery:
    """Events per type and tumbling window; `window_totals` reads them, `late_rows` what was late."""
    parts = lambda batch: batch.groupBy("start", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return _merge_counts(events, out, checkpoint, every, width, lateness, "event_type", _type_counts, parts)


def window_totals(spark: SparkSession, out: str) -> DataFrame:
    """(start, event_type, n) so far."""
    return _type_counts(spark, out).read()


def _failure_counts(spark: SparkSession, out: str) -> RunTable:
    keys = ["start", "ip_hash"]
    return RunTable(spark, f"{out}/counts", "start TIMESTAMP, ip_hash STRING, failed BIGINT, last_seen TIMESTAMP", folded(keys, failed="sum", last_seen="max"), "ip_hash")


def failing_address_counts(events: DataFrame, out: str, checkpoint: str, lateness: str = "2 days", every: str | None = None) -> StreamingQuery:
    """Failed logins per address and day, with the last time. `failing_address_totals` adds the days up."""
    failed = events.filter(
        (F.col("event_type") == "login_attempt") & ~F.coalesce(F.col("meta.ok"), F.lit(False)) & (_blank("ip_hash") != "")
    )
    parts = lambda batch: batch.groupBy("start", "ip_hash").agg(F.count(F.lit(1)).alias("failed"), F.max("ts").alias("last_seen"))
    return _merge_counts(failed, out, checkpoint, every, "1 day", lateness, "ip_hash", _failure_counts, parts)


def failing_address_totals(spark: SparkSession, out: str) -> DataFrame:
    """Failed logins per address so far, with the last time."""
    return _failure_counts(spark, out).read().groupBy("ip_hash").agg(F.sum("failed").alias("failed"), F.max("last_seen").alias("last_seen"))


#: Hits of a key that are put in order in memory, hits of a stored piece, sorted runs that are merged at once.
HELD, PIECE, RUNS = 1 << 16, 1 << 12, 32
Hits = Iterator[tuple[int, int]]


class RateLimiter(StatefulProcessor):
    """Accepts a hit while fewer than `limit` accepted hits lie in the window before it.

    Hits are decided in the order of their time. The accepted times of a key are kept by slab
    of a window's length, with a timer for each slab that clears it once no hit can need it any
    more. A key with more hits in a batch than fit in memory is sorted in its state: sorted
    pieces are stored, merged some runs at a time, and streamed in order, so that memory is
    bounded by HELD hits and RUNS pieces whatever the key's share of the batch is.
    """

    def __init__(self, limit: int, window_us: int, lateness_us: int) -> None:
        self.limit, self.window_us, self.lateness_us = limit, window_us, lateness_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.taken = handle.getMapState("taken", "slab bigint", "times array<bigint>")
        self.sorted = handle.getMapState("sorted", "run int, piece int", "us array<bigint>, hits array<bigint>")

    def _store(self, run: int, hits: Hits) -> None:
        """Write a sorted run piece by piece; an empty piece ends it."""
        us, ids, piece = [], [], 0
        for now, hit in hits:
            us.append(now)
            ids.append(hit)
            if len(us) == PIECE:
                self.sorted.updateValue((run, piece), (us, ids))
                us, ids, piece = [], [], piece + 1
        self.sorted.updateValue((run, piece), (us, ids))

    def _stored(self, run: int) -> Hits:
        """Read a run in order and remove it on the way."""
        piece, more = 0, True
        while more:
            us, ids = self.sorted.getValue((run, piece))
            self.sorted.removeKey((run, piece))
            yield from zip(us, ids)
            more, piece = len(us) == PIECE, piece + 1

    def _ordered(self, rows: Iterator[pd.DataFrame]) -> Hits:
        us, ids, runs = [], [], 0
        held, first = 0, 0

        def hits() -> Hits:
            both = np.concatenate(us or [np.zeros(0, np.int64)]), np.concatenate(ids or [np.zeros(0, np.int64)])
            order = np.lexsort((both[1], both[0]))
            us.clear()
            ids.clear()
            return zip(both[0][order].tolist(), both[1][order].tolist())

        for part in rows:
            us.append(part["us"].to_numpy())
            ids.append(part["hit_id"].to_numpy())
            held += len(part)
            if held >= HELD:
                self._store(runs, hits())
                runs, held = runs + 1, 0
        while runs - first > RUNS:
            self._store(runs, merged(*[self._stored(r) for r in range(first, first + RUNS)]))
            first, runs = first + RUNS, runs + 1
        return merged(*[self._stored(r) for r in range(first, runs)], hits())

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        slabs = {k[0]: list(v[0]) for k, v in self.taken.iterator()}
        known, changed = set(slabs), set()
        done: list[tuple[int, int, bool]] = []
        frame = lambda: pd.DataFrame({"key": key[0], "hit_id": [d[0] for d in done], "us": [d[1] for d in done], "accepted": [d[2] for d in done]})
        slab = None
        for now, hit in self._ordered(rows):
            if slab != now // self.window_us:
                slab = now // self.window_us
                # Slabs that no hit from here on can need: hits are in order, later batches at most the lateness behind.
                for old in [s for s in slabs if (s + 2) * self.window_us <= now - self.lateness_us]:
                    del slabs[old]
            before, own = slabs.get(slab - 1, []), slabs.setdefault(slab, [])
            accepted = len(before) - bisect_left(before, now - self.window_us) + bisect_right(own, now) < self.limit
            if accepted:
                insort(own, now)
                changed.add(slab)
            done.append((hit, now, accepted))
            if len(done) == HELD:
                yield frame()
                done = []
        for old in known - set(slabs):
            self.taken.removeKey((old,))
        for s in changed & set(slabs):
            if s not in known:
                self.handle.registerTimer((s + 2) * self.window_us // 1000 + 1)
            self.taken.updateValue((s,), (slabs[s],))
        if done:
            yield frame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        past = expiredTimerInfo.getExpiryTimeInMs()
        for (s,) in list(self.taken.keys()):
            if (s + 2) * self.window_us // 1000 + 1 <= past:
                self.taken.removeKey((s,))
        return iter([])

    def close(self) -> None:
        pass


#: Groups that the users of a day are dealt to.
USER_BUCKETS = 256


class DailyQuota(StatefulProcessor):
    """Accepts the first `quota` attempts of a (user, day); the counts go a day after the day.

    A group is a bucket of the users of one day, so that a call, a state and a timer serve many
    users. Besides the counts it holds HELD rows and the attempts that may still be accepted.
    """

    def __init__(self, quota: int) -> None:
        self.quota = quota

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getValueState("used", "users array<bigint>, n array<int>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        day, bucket = key
        known = self.used.exists()
        used = dict(zip(*self.used.get())) if known else {}
        columns = ["user_id", "attempt_id", "us"]
        # The bucket -1 is that of the attempts without a user.
        decided = lambda frame, accepted: frame.assign(accepted=accepted, **({"user_id": None} if bucket < 0 else {}))
        # The first attempts so far of every user are held back; all others are rejected at once.
        first, parts, size, moment = None, [], 0, None

        def split() -> tuple[pd.DataFrame, pd.DataFrame]:
            both = pd.concat(parts if first is None else [first, *parts]).sort_values(["user_id", "us", "attempt_id"], ignore_index=True)
            left = self.quota - both["user_id"].map(used).fillna(0).to_numpy()
            early = both.groupby("user_id").cumcount().to_numpy() < left
            return both[early], both[~early]

        for part in rows:
            parts.append(part[columns])
            size, moment = size + len(part), part["us"].iloc[0]
            if size >= max(HELD, 0 if first is None else len(first)):
                first, late = split()
                parts, size = [], 0
                if len(late):
                    yield decided(late, False)
        if parts:
            first, late = split()
            if len(late):
                yield decided(late, False)
        if not known and day is not None:
            self.handle.registerTimer((int(moment) // 86_400_000_000 + 2) * 86_400_000)
        for user, n in first.groupby("user_id").size().items():
            used[user] = used.get(user, 0) + n
        self.used.update(([int(u) for u in used], [int(n) for n in used.values()]))
        if len(first):
            yield decided(first, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.used.clear()
        return iter([])

    def close(self) -> None:
        pass


def rate_limit_stream(hits: DataFrame, limit: int = RATE_LIMIT, window_seconds: int = RATE_WINDOW_SECONDS, lateness_seconds: int = 600) -> DataFrame:
    """Decisions for a stream of (key, hit_id, ts). Needs the RocksDB state store."""
    hits.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    limiter = RateLimiter(limit, window_seconds * 1_000_000, lateness_seconds * 1_000_000)
    return (
        hits.withWatermark("ts", f"{lateness_seconds} seconds")
        .select("key", "hit_id", F.unix_micros("ts").alias("us"), "ts")
        .groupBy("key")
        .transformWithStateInPandas(limiter, f"key {hits.schema['key'].dataType.simpleString()}, hit_id BIGINT, us BIGINT, accepted BOOLEAN", "append", "EventTime")
    )


def quota_stream(attempts: DataFrame, quota: int = DAILY_QUOTA, lateness: str = "1 hour") -> DataFrame:
    """Decisions for a stream of (user_id, attempt_id, ts). Needs the RocksDB state store."""
    attempts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    bucket = F.when(F.col("user_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("user_id"), F.lit(USER_BUCKETS)).cast("int"))
    return (
        attempts.withWatermark("ts", lateness)
        .select(
            F.coalesce("user_id", F.lit(0)).cast("bigint").alias("user_id"), "attempt_id", F.unix_micros("ts").alias("us"),
            F.to_date("ts").alias("day"), bucket.alias("bucket"), "ts",
        )
        .groupBy("day", "bucket")
        .transformWithStateInPandas(
            DailyQuota(quota), "user_id BIGINT, attempt_id BIGINT, us BIGINT, accepted BOOLEAN", "append", "EventTime"
        )
    )


def write_decisions(decisions: DataFrame, out: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    return start(decisions.writeStream.format("parquet").outputMode("append").option("path", out), checkpoint, every)
