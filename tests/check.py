"""Command-line check of registered queries: python tests/check.py [prefix ...] [--sf DIR]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from harness import compare, connect  # noqa: E402
from reportmill.session import build_session  # noqa: E402

if __name__ == "__main__":
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        del args[i : i + 2]
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    con = connect(sf)
    bad = 0
    for name, run in queries.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        t = time.time()
        try:
            if name in oracles:
                n, problem = compare(spark, con, run, oracles[name], sf)
            else:
                n, problem = run(spark, sf).count(), None
        except Exception as exc:
            n, problem = -1, f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += problem is not None
        print(f"{'BAD ' if problem else 'ok  '} {name:36s} {n:7d} rows {time.time() - t:6.2f}s {'' if name in oracles else '(no sql)'} {problem or ''}", flush=True)
    print("failures:", bad)
