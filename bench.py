"""Time the headline jobs and print one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from reportmill.plans import all_queries, flagship  # noqa: E402
from reportmill.session import build_session  # noqa: E402

HEADLINES = (
    "x04_parse_numbers", "x06_label_to_metric", "x11_melt_tables", "w03_dedupe_facts", "w04_build_statements",
    "w10_balance_check", "q03_metric_over_companies", "q14_quality_report", "c06_chunk_words", "c07_number_chunks",
    "h04_page_links", "a07_visitor_rollup", "a12_login_funnel", "a13_chat_stats", "a16_conversations", "a19_timeline",
    "r01_route_questions", "r08_keyword_top_k", "r10_all_vectors_cosine", "r11_hybrid_rank", "u02_user_history",
    "u03_daily_quota", "u04_rate_limit", "u04_rate_limit_busy", "c16_needs_ocr", "q11_financials_bundle", "r12_structured_answers",
    "r13_full_context", "a21_dashboard_values", "t01_watch_reports", "t02_ingest_events", "t03_daily_counts", "t06_failing_addresses",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    partitions = cpus if cpus.isdigit() else "8"
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": partitions,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    # One job of each kind first, so that class loading and code generation are not billed to the first headline.
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").write.format("noop").mode("overwrite").save()
    flagship(spark, sf_dir).write.format("noop").mode("overwrite").save()
    jobs = {"flagship": lambda s, d: flagship(s, d)} | {name: queries[name] for name in HEADLINES}
    times = {}
    for name, run in jobs.items():
        begin = time.perf_counter()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    line = {
        "metric": "headline_jobs_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
