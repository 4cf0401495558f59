"""Run a registered query in Spark and its SQL in DuckDB and compare the row bags."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, con, runner, sql, sf_dir):
    """(rows, problem or None)"""
    df = runner(spark, sf_dir)
    spark_rows = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    duck_rows = cur.fetchall()
    if sorted(df.columns) != sorted(names):
        return len(spark_rows), f"columns {sorted(df.columns)} vs {sorted(names)}"
    a, b = bag(df.columns, spark_rows), bag(names, duck_rows)
    if a != b:
        left, right = list((a - b).items())[:3], list((b - a).items())[:3]
        return len(spark_rows), f"rows {len(spark_rows)} vs {len(duck_rows)}\n   spark {left}\n   sql   {right}"
    return len(spark_rows), None
