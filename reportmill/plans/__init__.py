"""Composed jobs and the registry of runnable queries."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import catalog

_MODULES = ("corpus_queries", "financial_queries", "event_queries", "search_queries", "account_queries", "stream_queries")


def _load() -> None:
    for name in _MODULES:
        import_module(f"{__name__}.{name}")


def all_queries():
    _load()
    return dict(catalog.RUNNERS)


def all_oracles():
    _load()
    return dict(catalog.ORACLES)


def flagship(spark: SparkSession, sf_dir: str, metric: str = "net_income", year: int = 1998) -> DataFrame:
    """Rank companies by a metric in a year, starting from raw report tables."""
    from ..operators.facts import extract_facts
    from ..operators.warehouse import build_statements, dedupe_facts, statement_table
    from . import inputs

    keys = ("company_id",)
    facts = dedupe_facts(extract_facts(inputs.report_pages(spark, sf_dir)), keys)
    income = statement_table(build_statements(facts, keys), "income_statement").filter(F.col("year") == year)
    names = inputs.companies(spark, sf_dir).select("company_id", F.col("name").alias("company"), "sector")
    return income.join(names, "company_id").select(
        "company", "sector", "year", F.col(metric).alias("value"), "unit", "confidence",
        F.array_join("warnings", "; ").alias("warnings"),
    ).orderBy(F.desc_nulls_last("value"), "company")
