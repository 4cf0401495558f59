"""Bucketed upserts and counted writes."""

import os
import random

from pyspark.sql import functions as F

from reportmill.operators import corpus as C
from reportmill.operators import warehouse as W
from reportmill.session import write_counted
from reportmill.sources import bucketed as B

FACTS = "report_id int, normalized_metric_name string, year int, statement_type string, raw_value string, value double, unit string, confidence double, validation_warning string, metric_name string"


def files(path):
    return {(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def facts(rnd, n, name):
    return [(rnd.randrange(40), rnd.choice(["revenue", "cash", None]), rnd.choice([2020, 2021, None]), "i", str(i), float(i), rnd.choice(["MAD", None]), round(rnd.random(), 1), None, name) for i in range(n)]


def unique(rows):
    return list({r[:4]: r for r in rows}.values())


def test_merge_equals_the_whole_upsert(spark, tmp_path, monkeypatch):
    rnd = random.Random(1)
    for sent, n in ((100_000, 6), (0, 60)):
        monkeypatch.setattr(B, "MAX_SENT", sent)
        old = spark.createDataFrame(unique(facts(rnd, 200, "old")), FACTS)
        new = spark.createDataFrame(unique(facts(rnd, n, "new")), FACTS)
        table = W.fact_table(spark, str(tmp_path / f"facts{sent}"), old)
        table.create(old)
        W.upsert_stored_facts(table, new)
        want = sorted(map(tuple, W.upsert_facts(old, new).collect()), key=str)
        assert sorted(map(tuple, table.read().collect()), key=str) == want
        W.upsert_stored_facts(table, new)
        assert sorted(map(tuple, table.read().collect()), key=str) == want


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(2000).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    table = B.BucketTable(spark, path, rows.schema, ["k"], buckets=16)
    table.create(rows)
    before = files(path)
    new = spark.createDataFrame([(7, "new"), (7, "second"), (5000, "more")], "k bigint, v string")
    touched = {r["b"] for r in new.select(table.bucket().alias("b")).collect()}
    plan = table.replaced(new)._jdf.queryExecution().executedPlan().toString()
    # One exchange, that of the new rows; stored rows go straight to their join.
    assert plan.count("Exchange hashpartitioning(bucket") == 1 and "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    table.replace(new)
    after = files(path)
    kept = {f for f in before if int(f[0].split("bucket=")[1]) not in touched}
    assert kept and all(after.get(f) == before[f] for f in kept) and not (set(before) - kept) & set(after)
    got = sorted(map(tuple, table.read().collect()))
    assert got == sorted([(k, "old") for k in range(2000) if k != 7] + [(7, "new"), (7, "second"), (5000, "more")])
    assert got == sorted(map(tuple, C.upsert_by_key(rows, new, ["k"]).collect()))
    table.replace(new.limit(0))
    assert files(path) == after


def test_counts_come_with_the_write(spark, tmp_path):
    rows = spark.range(1000).repartition(7)
    scans = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            scans.add(batch.num_rows)
            yield batch

    told = write_counted(rows.mapInArrow(count, rows.schema), str(tmp_path / "o"), n=F.count(F.lit(1)), even=F.count_if(F.col("id") % 2 == 0))
    assert told == {"n": 1000, "even": 500} and scans.value == 1000
    assert write_counted(rows.limit(0), str(tmp_path / "e"), n=F.count(F.lit(1))) == {"n": 0}
