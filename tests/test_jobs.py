"""Jobs against brute force, with hot keys and real files."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from reportmill.functions.routing import route
from reportmill.operators import accounts as U
from reportmill.operators import corpus as C
from reportmill.operators import financials as Q
from reportmill.operators import harvest as H
from reportmill.operators import search as R
from reportmill.operators.events import ranked_picks
from reportmill.operators.search import routing_accuracy
from reportmill.operators.warehouse import upsert_facts
from reportmill.sources import files as S
from reportmill.streaming import feeds as T


def limiter(hits, limit, window):
    taken, out = {}, {}
    for key, hit, ts in sorted(hits, key=lambda h: (h[2], h[1])):
        q = taken.setdefault(key, [])
        while q and (ts - q[0]).total_seconds() > window:
            q.pop(0)
        out[hit] = len(q) < limit
        if out[hit]:
            q.append(ts)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_rate_limit_with_a_hot_key(spark, seed):
    rng, t0, hits = random.Random(seed), datetime(2024, 1, 1), []
    for _ in range(1500):  # one key holds most hits: quiet times, bursts and long saturation
        phase = rng.choice([0, 0, 1, 2])
        base = rng.uniform(0, 9000) if phase < 2 else rng.uniform(3000, 4300)
        for _ in range(1 if phase == 0 else 3):
            hits.append((1, len(hits), t0 + timedelta(seconds=base + rng.uniform(0, 20))))
    for key in range(2, 40):
        for _ in range(20):
            hits.append((key, len(hits), t0 + timedelta(seconds=rng.uniform(0, 9000))))
    df = spark.createDataFrame(hits, "key bigint, hit_id bigint, ts timestamp").repartition(5)
    for limit, window in ((20, 60), (3, 60), (5, 600)):
        got = {r["hit_id"]: r["accepted"] for r in U.rate_decisions(df, limit, window).collect()}
        assert got == limiter(hits, limit, window)


def test_quota_with_a_hot_user(spark):
    rows = [(1, i, datetime(2024, 1, 1, 0, 0, i % 50)) for i in range(500)] + [(2, 1000, datetime(2024, 1, 1))]
    got = U.quota_decisions(spark.createDataFrame(rows, "user_id int, attempt_id int, ts timestamp")).filter("accepted").collect()
    expected = {r[1] for r in sorted(rows[:500], key=lambda r: (r[2], r[1]))[:5]} | {1000}
    assert {r["attempt_id"] for r in got} == expected


def test_ranked_picks(spark):
    rng = random.Random(3)
    for n in (1, 2, 4, 999):
        values = [int(rng.expovariate(0.001)) for _ in range(n)]
        got = {r["name"]: r["value"] for r in ranked_picks(spark.createDataFrame([(v,) for v in values], "v int"), "v", {"a": 0.5, "b": 0.95, "c": 1.0}).collect()}
        s = sorted(values)
        assert got == {k: s[min(n - 1, int(n * p))] for k, p in (("a", 0.5), ("b", 0.95), ("c", 1.0))}


@pytest.mark.parametrize("n", [0, 1, 299, 300, 301, 550, 551, 800, 1234])
def test_chunk_windows(spark, n):
    words = [f"w{i}" for i in range(n)]
    expected, start = [], 0
    while start < n:
        expected.append(" ".join(words[start : start + 300]))
        if start + 300 >= n:
            break
        start += 250
    df = spark.createDataFrame([(" \n".join(words),)], "t string")
    row = df.select(C.chunk_words(F.col("t")).alias("c"), C.window_count(F.lit(n)).alias("n")).first()
    assert row["c"] == expected and row["n"] == len(expected)


def test_numbering_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(C, "PAGE_BUCKET", 4)
    pages = [("hot", p, " ".join(["x"] * (p * 37 % 900))) for p in range(1, 60)] + [("cold", 3, "a b c")]
    chunks = C.chunk_pages(spark.createDataFrame(pages, "report string, page int, text string")).collect()
    hot = sorted((r for r in chunks if r["report"] == "hot"), key=lambda r: r["id"])
    assert [r["id"] for r in hot] == list(range(len(hot)))
    assert [r["page"] for r in hot] == sorted(r["page"] for r in hot)
    assert [r["id"] for r in chunks if r["report"] == "cold"] == [0]


def test_upsert_twice_is_once(spark):
    schema = "report_id int, normalized_metric_name string, year int, statement_type string, raw_value string, value double, unit string, confidence double, validation_warning string, metric_name string"
    old = spark.createDataFrame([(1, "revenue", 2020, "i", "1", 1.0, "MAD", 0.5, None, "old")], schema)
    new = spark.createDataFrame([(1, "revenue", 2020, "i", "2", 2.0, "MAD", 0.9, None, "new"), (2, "cash", 2020, "b", "3", 3.0, "MAD", 0.4, None, "new")], schema)
    once = upsert_facts(old, new)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, upsert_facts(once, new).collect()))
    row = once.filter("report_id = 1").first()
    assert (row["value"], row["metric_name"]) == (2.0, "old")
    assert upsert_facts(old, new.withColumn("confidence", F.lit(0.5))).filter("report_id = 1").first()["value"] == 1.0


def test_blocks_equal_broadcast(spark, monkeypatch):
    rng = random.Random(5)
    vec = lambda: [round(rng.uniform(-1, 1), 1) for _ in range(4)]
    words = ["alpha", "bravo", "charlie", "delta", "echo1", "foxtrot"]
    rows = [(f"c{i}", i, vec(), " ".join(rng.choices(words, k=3)), "r", "s" + str(i % 2), "2020", "x") for i in range(300)]
    chunks = spark.createDataFrame(rows, "chunk_id string, ord bigint, embedding array<float>, text string, report string, company_normalized string, year string, sector string")
    asked = [(q, " ".join(rng.sample(words, 2)), f"s{q % 2}" if q % 3 else None, vec()) for q in range(20)]
    questions = R.prepare_questions(spark.createDataFrame([a[:3] for a in asked], "qid int, question string, company string"))
    vectors = questions.join(spark.createDataFrame([(a[0], a[3]) for a in asked], "qid bigint, embedding array<float>"), "qid").withColumn("variant", F.lit(0))
    whole, blocks = (sorted(map(tuple, R.vector_top_k(vectors, chunks, 5, question_block=m, chunk_block=m).select("qid", "chunk_id", "rank").collect())) for m in (100, 5))
    assert whole == blocks
    expected = set()
    for q, _, company, v in asked:
        import numpy as np

        near = sorted((float(((np.float32(r[2]).astype(float) - np.float32(v).astype(float)) ** 2).sum()), r[1], r[0]) for r in rows if company in (None, r[5]))
        expected |= {(q, c) for _, _, c in near[:5]}
    assert {(r["qid"], r["chunk_id"]) for r in R.vector_top_k(vectors, chunks, 5).collect()} == expected


def test_document_rules(spark):
    cases = {
        "Rapport annuel 2023": "Rapports annuels", "x-rfa-2022": "Rapports annuels", "Rapport financier semestriel": "Rapports 1er semestre",
        "Rapport ESG annual report": "Autre", "x-rfs-2021": "Rapports 1er semestre", "communiqué de presse": "Autre",
    }
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [r[0] for r in df.select(H.document_type(F.col("t"), F.lit("lien"))).collect()] == list(cases.values())
    years = spark.createDataFrame([("a-2009",), ("a-2010",), ("b 2029 2011",), ("20230",)], "t string")
    assert [r[0] for r in years.select(H.document_year(F.col("t"))).collect()] == [None, 2010, 2029, None]


def test_latest_five(spark):
    rows = [("1", y, "Rapports annuels", i) for i, y in enumerate(range(2019, 2026))] + [("1", 2025, "Rapports annuels", 99), ("2", 2020, "Rapports annuels", 0), ("2", 2018, "Autre", 1)]
    df = spark.createDataFrame(rows, "company_id string, year int, document_type string, pos int")
    got = H.latest_reports(df).collect()
    assert sorted(r["year"] for r in got if r["company_id"] == "1") == [2021, 2022, 2023, 2024, 2025]
    assert [r["pos"] for r in got if r["year"] == 2025] == [6]
    assert [r["year"] for r in got if r["company_id"] == "2"] == [2020]


def test_files_on_disk(spark, tmp_path):
    good, small, wrong = b"%PDF" + b"x" * 2000, b"%PDF", b"<html" + b"y" * 2000
    for sector, company, year, data in (("Banques", "BANK ONE", "2020", good), ("Banques", "BANK ONE", "2021", small), ("Mines", "M", "2020", wrong)):
        folder = tmp_path / sector / company / year
        folder.mkdir(parents=True)
        (folder / "annual_report.pdf").write_bytes(data)
    (tmp_path / "loose.pdf").write_bytes(good)
    checks = {r["path"].split("/")[-2] + r["path"].split("/")[-3]: r["problem"] for r in H.file_checks(S.read_report_files(spark, str(tmp_path))).collect()}
    assert checks["2020BANK%20ONE"] is None if "2020BANK%20ONE" in checks else checks["2020BANK ONE"] is None
    assert sum(p is not None and p.startswith("File too small") for p in checks.values()) == 1
    assert sum(p == "Invalid PDF magic bytes" for p in checks.values()) == 1
    meta = spark.createDataFrame([("m_2020", "Mines SA", "m", "2020", "Mines", "7", "u")], "stem string, company string, company_normalized string, year string, sector string, report_id string, source_url string")
    tree = {r["stem"]: r["company"] for r in S.report_tree(S.list_report_files(spark, str(tmp_path)), str(tmp_path), meta).collect()}
    assert len(tree) == 3 and tree["m_2020"] == "Mines SA"


def test_manifest_file_with_mark(spark, tmp_path):
    path = tmp_path / "m.csv"
    row = lambda i, status, local: ",".join([f"r{i}", "1", f"Name {i}", "name", "S", "2020", "t", '"a ""b"", c"', "u", "d", local, "f", "1", "h", status, "3", "x", "y", ""])
    path.write_text("﻿" + ",".join(S.MANIFEST_COLUMNS) + "\n" + "\n".join([row(1, "downloaded", "/r/s/Co A/2020/x.pdf"), row(2, "skipped", "/r/s/Co A/2020/x.pdf"), row(3, "failed", "")]) + "\n", encoding="utf-8")
    got = S.stem_metadata(S.read_manifest(spark, str(path))).collect()
    assert [(r["stem"], r["company"], r["report_id"]) for r in got] == [("co_a_2020", "Name 2", "r2")]


# Labelled questions with the accuracy every suite must reach.
SUITES = {
    ("sql", 0.80): [
        ("Quel est le résultat net de Attijariwafa en 2022 ?", ["sql"]), ("Quel est l'EBITDA de OCP en 2021 ?", ["sql"]),
        ("Quelle est la marge nette de CIH Bank en 2020 ?", ["sql"]), ("Capitaux propres de Lydec en 2022", ["sql"]),
        ("Valeur du free cash flow de OCP en 2023", ["sql"]), ("Quels sont les actionnaires principaux ?", ["sql"]),
    ],
    ("vector", 0.75): [
        ("Quelle est la stratégie de développement de l'entreprise ?", ["vector"]), ("Comment fonctionne la gouvernance de l'entreprise ?", ["vector"]),
        ("Quels sont les risques opérationnels mentionnés ?", ["vector"]), ("Quels engagements RSE l'entreprise a-t-elle pris ?", ["vector"]), ("Bonjour", ["vector"]),
    ],
    ("hybrid", 0.60): [
        ("Pourquoi le résultat net a-t-il augmenté en 2022 ?", ["hybrid"]), ("Quel est l'impact de la crise sur le chiffre d'affaires ?", ["hybrid"]),
        ("Quels facteurs expliquent la hausse du chiffre d'affaires ?", ["hybrid"]),
    ],
}


def test_routing_suites(spark):
    rows = [(suite, floor, q, e) for (suite, floor), cases in SUITES.items() for q, e in cases]
    df = spark.createDataFrame(rows, "suite string, floor double, q string, expected array<string>").withColumn("r", route(F.col("q")))
    acc = {r["suite"]: r["accuracy"] for r in routing_accuracy(df.select("suite", "expected", "r.query_type", "r.confidence")).collect()}
    for (suite, floor), _ in SUITES.items():
        assert acc[suite] >= floor
    hints = df.select("q", "r.year", "r.metric").filter("q like 'Quel est le résultat net%'").first()
    assert (hints["year"], hints["metric"]) == (2022, "net_income")


def test_signup_rules(spark):
    rows = [("a@b.ma", "Jean Dupont"), ("a@yopmail.com", "Jean Dupont"), ("nope", "Jean Dupont"), ("a@b.ma", "Jean"), ("x@sub.mailinator.io", "J D")]
    got = [r["violations"] for r in U.signup_violations(spark.createDataFrame(rows, "email string, full_name string")).collect()]
    assert got == [[], ["email disposable"], ["email invalid"], ["name incomplete"], ["name incomplete", "email disposable"]]


def test_repeated_pages_are_numbered_once(spark):
    rows = [("r", 1, "one two"), ("r", 1, "one three"), ("r", 1, "one two"), ("r", 2, "four")]
    got = C.chunk_pages(spark.createDataFrame(rows, "report string, page int, text string")).orderBy("id").collect()
    assert [(r["id"], r["page"], r["text"]) for r in got] == [(0, 1, "one three"), (1, 1, "one two"), (2, 1, "one two"), (3, 2, "four")]


def test_report_pages_over_many_batches(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("in", "out", "ck"))
    schema = "report string, page int, text string, source string, mtime timestamp"
    moment = datetime(2024, 1, 1)
    for page in (3, 1, 4, 2, 1):  # one page a file, a file a batch; page 1 comes twice
        spark.createDataFrame([("r", page, f"text {page}", "s", moment)], schema).coalesce(1).write.mode("append").json(folder)
        query = T.watch_reports(spark, folder, out, check, every=None, files_per_batch=1)
        query.awaitTermination()
        assert query.exception() is None
    got = T.indexed_chunks(spark, out).orderBy("id").collect()
    assert [(r["id"], r["page"], r["text"]) for r in got] == [(i, i + 1, f"text {i + 1}") for i in range(4)]
    assert [(r["stem"], r["pages"], r["chunks"]) for r in T.indexed_reports(spark, out).collect()] == [("r", 4, 4)]


def test_more_accounts_than_any_limit(spark):
    users = spark.range(2500).selectExpr("id as user_id", "'n' as full_name", "'e' as email", "timestamp'2024-01-01' as created_at", "0 as daily_msgs_used", "date'2024-01-01' as quota_date")
    history = spark.range(5000).selectExpr("id % 2500 as user_id", "id as history_id", "timestamp'2024-01-01' as created_at")
    events = spark.createDataFrame([("chat_message", "user"), ("chat_message", "admin"), ("page_view", None)], "event_type string, role string")
    assert tuple(U.account_overview(users, history, events).first()) == (2500, 5000, 1)
    assert U.users_with_usage(users, history, "2024-01-01", limit=2400).count() == 2400
    assert U.users_with_usage(users, history, "2024-01-01", limit=None).count() == 2500


def test_line_breaks_come_back(spark, tmp_path):
    rows = [("a\nb", 'x "y"\r\nz'), ("plain", None)]
    S.write_csv(spark.createDataFrame(rows, "title string, note string"), str(tmp_path / "t"))
    got = S._read_csv(spark, str(tmp_path / "t"), "title string, note string").collect()
    assert {r["title"] for r in got} == {"a\nb", "plain"} and len(got) == 2


def test_root_with_pattern_characters(spark):
    meta = spark.createDataFrame([], "stem string, company string, company_normalized string, year string, sector string, report_id string, source_url string")
    files = spark.createDataFrame([("file:/data/v1+x/(s)/Co/2020/a.pdf",), ("file:/data/v1x/s/Co/2021/a.pdf",)], "path string")
    assert [r["year"] for r in S.report_tree(files, "/data/v1+x", meta).collect()] == ["2020"]


def test_statements_of_one_year_in_order(spark):
    companies = spark.createDataFrame([(1, "n", "N")], "company_id int, normalized_name string, name string")
    columns = [c for c in Q.INCOME_COLUMNS if c not in ("currency", "unit", "confidence")]
    rows = spark.createDataFrame([(1, r, 2020, conf, "MAD", "KMAD") for r, conf in ((1, 0.5), (2, 0.9), (3, 0.9))], "company_id int, report_id int, year int, confidence double, currency string, unit string")
    rows = rows.select("*", *[(F.col("report_id") * 1.0).alias(c) for c in columns])
    for df in (rows, rows.orderBy(F.desc("report_id")), rows.repartition(3)):
        assert Q.income_statement(df, companies, "n", 2020).first()[columns[0]] == 3.0
