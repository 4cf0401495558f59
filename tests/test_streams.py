"""Run tables, live feeds over batches out of order, and the rate limiter, against plain Python."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from reportmill.operators import events as A
from reportmill.operators import sketches as K
from reportmill.sources.runs import Run, RunTable, folded, newest
from reportmill.streaming import feeds as T


def finish(query):
    query.awaitTermination()
    assert query.exception() is None


def test_newest_version_over_folds(spark, tmp_path):
    table = RunTable(spark, str(tmp_path / "t"), "k string, v int, batch bigint", newest("k"), "k", buckets=4, fan=2)
    rnd, want = random.Random(1), {}
    frame = lambda rows: spark.createDataFrame([(k, v) for k, vs in rows.items() for v in vs], "k string, v int")
    for batch in range(9):
        if batch == 5:  # written, then written again
            table.add(frame({"a": [-1], "z": [-1]}), batch)
        rows = {rnd.choice("abcdefgh"): [rnd.randrange(100) for _ in range(rnd.randrange(1, 4))] for _ in range(3)}
        table.add(frame(rows), batch)
        want.update(rows)
        got = {}
        for r in table.read().collect():
            got.setdefault(r["k"], []).append(r["v"])
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    runs = table.runs()
    assert max(r.level for r in runs) >= 2 and len(runs) < 9
    assert sorted(x for r in runs for x in range(r.first, r.last + 1)) == list(range(9))
    assert table.read().filter("k = 'z'").count() == 0


def test_touched_buckets_only(spark, tmp_path):
    table = RunTable(spark, str(tmp_path / "t"), "k string, n bigint", folded(["k"], n="sum"), "k", buckets=8, fan=3)
    for batch in range(4):
        table.add(spark.createDataFrame([(f"k{i}", 1) for i in range(50)], "k string, n bigint"), batch)
    touched = spark.createDataFrame([("k7",)], "k string")
    rows = table.read(touched)
    assert rows.filter("k = 'k7'").first()["n"] == 4 and 0 < rows.count() < 50
    files = {f.split("bucket=")[1].split("/")[0] for f in rows.inputFiles()}
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan and files
    assert table.read().count() == 50 and {r["n"] for r in table.read().collect()} == {4}


def test_runs_inside_others():
    assert Run(0, 1, 1).inside(Run(1, 0, 3)) and not Run(1, 0, 3).inside(Run(1, 0, 3)) and not Run(0, 4, 4).inside(Run(1, 0, 3))


def test_nothing_yet(spark, tmp_path):
    assert T.window_totals(spark, str(tmp_path / "none")).count() == 0
    assert T.indexed_reports(spark, str(tmp_path / "none")).count() == 0


def test_late_rows_count_and_are_listed(spark, tmp_path):
    """Six batches, the newest days first: nearly everything is behind the watermark."""
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "ck"))
    rnd, t0, rows = random.Random(2), datetime(2024, 1, 1), []
    schema = "ts timestamp, event_type string"
    for batch in range(6):
        part = [(t0 + timedelta(days=30 - 5 * batch, hours=rnd.uniform(-70, 70)), rnd.choice(["visit", "error"])) for _ in range(40)]
        rows += part
        spark.createDataFrame([*part, (None, "visit")], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    finish(T.windowed_counts(stream, out, check, "1 day", "2 days"))
    want = Counter((ts.replace(hour=0, minute=0, second=0, microsecond=0), kind) for ts, kind in rows)
    assert {(r["start"], r["event_type"]): r["n"] for r in T.window_totals(spark, out).collect()} == want
    high, late = None, []
    for batch in range(6):
        part = rows[40 * batch : 40 * batch + 40]
        late += [(ts, kind) for ts, kind in part if high is not None and ts < high - timedelta(days=2)]
        high = max([ts for ts, _ in part] + ([high] if high else []))
    assert sorted((r["ts"], r["event_type"]) for r in T.late_rows(spark, out, "event_type").collect()) == sorted(late) and len(late) > 100


def test_failing_addresses_out_of_order(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "ck"))
    rnd, rows = random.Random(3), []
    schema = "ts timestamp, event_type string, ip_hash string, meta struct<ok:boolean>"
    for batch in range(5):
        part = [(datetime(2024, 1, 28 - 6 * batch, rnd.randrange(24)), rnd.choice(["login_attempt", "visit"]), rnd.choice(["a", "b", "", None]), (rnd.choice([True, False, None]),)) for _ in range(60)]
        rows += part
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    finish(T.failing_address_counts(stream, out, check))
    want = {}
    for ts, kind, ip, (ok,) in rows:
        if kind == "login_attempt" and not ok and ip:
            n, last = want.get(ip, (0, ts))
            want[ip] = (n + 1, max(last, ts))
    assert {r["ip_hash"]: (r["failed"], r["last_seen"]) for r in T.failing_address_totals(spark, out).collect()} == want


def test_a_batch_reads_its_own_reports(spark, tmp_path, monkeypatch):
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema, moment = "report string, page int, text string, source string, mtime timestamp", datetime(2024, 1, 1)
    for batch in range(5):
        rows = [(f"r{i}", batch + 1, f"text {batch}", "s", moment) for i in range(12) if batch < 4 or i == 5]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(folder)
    read, seen = RunTable.read, []

    def spy(self, touched=None, key=None, before=None):
        rows = read(self, touched, key, before)
        if touched is not None and self.path.endswith("pages"):
            seen.append((before, rows.count()))
        return rows

    monkeypatch.setattr(RunTable, "read", spy)
    finish(T.watch_reports(spark, folder, out, check, every=None, files_per_batch=1))
    monkeypatch.undo()
    assert seen[-1][1] < 48  # the last batch has one report; the others' pages stay unread
    got = T.indexed_chunks(spark, out)
    assert got.count() == 49 and got.filter("report = 'r5'").count() == 5


def limiter(hits, limit, window):
    taken, out = {}, {}
    for key, hit, ts in sorted(hits, key=lambda h: (h[2], h[1])):
        own = [t for t in taken.setdefault(key, []) if (ts - t).total_seconds() <= window]
        out[hit] = len(own) < limit
        taken[key] = own + [ts] * out[hit]
    return out


@pytest.mark.parametrize("held,piece,runs", [(1 << 16, 1 << 12, 32), (50, 7, 3)])
def test_rate_limit_stream_with_a_hot_key(spark, tmp_path, monkeypatch, held, piece, runs):
    monkeypatch.setattr(T, "HELD", held)
    monkeypatch.setattr(T, "PIECE", piece)
    monkeypatch.setattr(T, "RUNS", runs)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 40)
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "ck"))
    rnd, t0, hits = random.Random(held), datetime(2024, 1, 1), []
    schema = "key bigint, hit_id bigint, ts timestamp"
    for batch in range(3):  # batches follow one another; inside a batch hits come in any order
        part = [(1 if rnd.random() < 0.8 else rnd.randrange(2, 9), 1000 * batch + i, t0 + timedelta(seconds=1000 * batch + rnd.uniform(0, 999))) for i in range(700)]
        hits += part
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    try:
        finish(T.write_decisions(T.rate_limit_stream(stream, 5, 60, 100_000), out, check))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {r["hit_id"]: r["accepted"] for r in spark.read.parquet(out).collect()}
    assert got == limiter(hits, 5, 60)


def log(spark, rows):
    schema = "seq bigint, ts timestamp, event_type string, role string, ip string, ip_hash string, device string, browser string, os string, city string, country string, country_code string, isp string, meta struct<company:string,session:string,ok:boolean,latency_ms:double,year:string,sector:string,report:string>"
    return spark.createDataFrame(rows, schema)


def events(rnd, n):
    pick = lambda *x: rnd.choice(x)
    return [(
        i, datetime(2024, 1, 1) + timedelta(hours=rnd.randrange(24 * 9)), pick("visit", "login_attempt", "chat_message"), pick("demo", "admin", None, ""), pick("1.1.1.1", "", None), f"h{rnd.randrange(12)}",
        pick("mobile", None), pick("b1", "b2", None), None, pick("C", ""), "K", "k", "", (pick("c1", "c2", None, ""), pick("s1", "s2", None), pick(True, False, None), float(rnd.randrange(900)) if rnd.random() < 0.7 else None, "2020", None, None),
    ) for i in range(n)]


def test_visitors_from_days_in_any_order(spark, tmp_path):
    rows = events(random.Random(6), 900)
    whole = log(spark, rows).repartition(3)
    want = sorted(map(tuple, A.visitors(whole).collect()), key=str)
    table = A.visitor_table(spark, str(tmp_path / "v"), A.visitor_parts(whole))
    table.fan = 3
    random.Random(7).shuffle(rows)
    for k in range(7):
        table.add(A.visitor_parts(log(spark, rows[k::7])), k)
    assert sorted(map(tuple, A.visitors_of(table.read()).collect()), key=str) == want and len(want) == 12
    assert A.visitors(whole.limit(0)).count() == 0


def test_daily_sketches_merge(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(*r[:5], f"h{rnd.randrange(3000)}", *r[6:]) for r in events(rnd, 6000)]
    whole = log(spark, rows).repartition(4)
    table = K.sketch_table(spark, str(tmp_path / "s"), K.daily_sketches(whole))
    table.fan = 2
    for k in range(5):
        table.add(K.daily_sketches(log(spark, rows[k::5])), k)
    first, last = datetime(2024, 1, 3), datetime(2024, 1, 6)
    merged = K.merged(table.read(), "event_type", since="2024-01-03", until="2024-01-06")
    inside = [r for r in rows if first <= r[1] < last + timedelta(days=1)]
    for r in K.visitor_estimates(merged).collect():
        exact = [x for x in inside if x[2] == r["event_type"]]
        assert r["n"] == len(exact) and abs(r["visitors"] - len({x[5] for x in exact})) <= K.VISITOR_ERROR * len(exact)
    chats = merged.filter("event_type = 'chat_message'")
    values = sorted(x[13][3] for x in inside if x[2] == "chat_message" and x[13][3] is not None)
    for r in K.latency_quantiles(chats, (0.1, 0.5, 0.95)).collect():
        below, upto = (sum(v < r["value"] for v in values), sum(v <= r["value"] for v in values))
        slack = K.RANK_ERROR * len(values) + 1
        assert below - slack <= r["share"] * len(values) <= upto + slack
    counts = Counter(x[13][0] for x in inside if x[2] == "chat_message" and x[13][0])
    assert [(r["value"], r["count"]) for r in K.top_values(chats, "company", 5).collect()] == sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:5]


@pytest.mark.parametrize("held", [1 << 16, 20])
def test_daily_quota_of_many_users_in_few_groups(spark, tmp_path, monkeypatch, held):
    """A group of the state serves many users of a day, in any number of pieces and batches."""
    monkeypatch.setattr(T, "HELD", held)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 30)
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "ck"))
    rnd, attempts = random.Random(held), []
    schema = "user_id bigint, attempt_id bigint, ts timestamp"
    for batch in range(2):  # the second batch comes later on the same days' last one
        part = [(rnd.choice([None, 0, *range(1, 400)]), 5000 * batch + i, datetime(2024, 1, 1 + rnd.randrange(2) * (1 - batch) + batch, 12 * batch, 0, rnd.randrange(50))) for i in range(2500)]
        attempts += part
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    monkeypatch.setattr(T, "USER_BUCKETS", 8)
    try:
        finish(T.write_decisions(T.quota_stream(stream, 3, "2 days"), out, check))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    used, want = Counter(), {}
    for user, attempt, ts in sorted(attempts, key=lambda a: (a[1] // 5000, a[2], a[1])):
        used[user, ts.date()] += 1
        want[attempt] = (user, used[user, ts.date()] <= 3)
    assert {r["attempt_id"]: (r["user_id"], r["accepted"]) for r in spark.read.parquet(out).collect()} == want
    state = spark.read.format("statestore").option("stateVarName", "used").load(check)
    assert 2 <= state.count() <= 2 * (8 + 1)
