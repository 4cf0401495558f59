"""Relational questions over the warehouse tables.

A parameter left at None adds no predicate at all, so what remains is pushed to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.checks import balance_check, income_check, revenue_or_banking

MIN_CONFIDENCE = 0.4
INCOME_COLUMNS = (
    "revenue", "net_banking_income", "gross_profit", "operating_income", "ebitda", "finance_result",
    "profit_before_tax", "income_tax", "net_income", "net_income_group_share", "currency", "unit", "confidence",
)
BALANCE_COLUMNS = (
    "total_assets", "current_assets", "non_current_assets", "cash", "receivables", "inventory",
    "total_liabilities", "current_liabilities", "non_current_liabilities", "debt", "equity",
    "balance_check_passed", "balance_discrepancy_pct", "currency", "unit",
)
CASH_COLUMNS = (
    "operating_cash_flow", "investing_cash_flow", "financing_cash_flow", "capex",
    "free_cash_flow", "net_change_in_cash", "currency", "unit",
)


def _where(df: DataFrame, **equal) -> DataFrame:
    for column, value in equal.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def _company(companies: DataFrame, normalized_name: str | None) -> DataFrame:
    return _where(companies, normalized_name=normalized_name).select(
        "company_id", F.col("name").alias("company")
    )


def get_metric(facts: DataFrame, companies: DataFrame, company: str, metric: str, year: int | None = None, limit: int = 10) -> DataFrame:
    """A company's values of one metric, newest year first."""
    rows = _where(facts, normalized_metric_name=metric, year=year)
    return (
        rows.join(_company(companies, company), "company_id")
        .select(
            "company", "year", F.col("normalized_metric_name").alias("metric"), "value", "unit",
            "currency", "confidence", "validation_warning",
        )
        .orderBy(F.desc("year"), F.desc("confidence"), F.desc_nulls_last("value"), "unit", "currency", "validation_warning")
        .limit(limit)
    )


def metric_over_years(facts: DataFrame, companies: DataFrame, company: str, metric: str, year_from: int | None = None, year_to: int | None = None) -> DataFrame:
    rows = _where(facts, normalized_metric_name=metric)
    if year_from is not None:
        rows = rows.filter(F.col("year") >= year_from)
    if year_to is not None:
        rows = rows.filter(F.col("year") <= year_to)
    return (
        rows.join(_company(companies, company), "company_id")
        .select("company", "year", F.col("normalized_metric_name").alias("metric"), "value", "unit", "currency", "confidence")
        .orderBy("year")
    )


def metric_over_companies(facts: DataFrame, companies: DataFrame, metric: str, year: int, sector: str | None = None) -> DataFrame:
    """All companies by a metric in a year, greatest first, unknown values last."""
    rows = _where(facts, normalized_metric_name=metric, year=year).filter(F.col("confidence") >= MIN_CONFIDENCE)
    who = _where(companies, sector=sector).select("company_id", F.col("name").alias("company"), "sector")
    return (
        rows.join(who, "company_id")
        .select("company", "sector", "year", F.col("normalized_metric_name").alias("metric"), "value", "unit", "currency")
        .orderBy(F.desc_nulls_last("value"), "company")
    )


def _best_first(df: DataFrame) -> list[Column]:
    """Order of statements that print the same year: most confident, then the newest report, then by value."""
    ranks = [F.desc_nulls_last(c) for c in ("confidence", "report_id") if c in df.columns]
    return [*ranks, *[F.desc_nulls_last(c) for c in sorted(df.columns) if c not in ("confidence", "report_id")]]


def _statement(statements: DataFrame, companies: DataFrame, company: str, year: int, columns) -> DataFrame:
    rows = _where(statements, year=year)
    joined = rows.join(_company(companies, company), "company_id")
    return joined.orderBy(*_best_first(rows)).limit(1).select("company", "year", *columns)


def income_statement(statements: DataFrame, companies: DataFrame, company: str, year: int) -> DataFrame:
    return _statement(statements, companies, company, year, INCOME_COLUMNS)


def balance_sheet(statements: DataFrame, companies: DataFrame, company: str, year: int) -> DataFrame:
    return _statement(statements, companies, company, year, BALANCE_COLUMNS)


def cash_flow(statements: DataFrame, companies: DataFrame, company: str, year: int) -> DataFrame:
    return _statement(statements, companies, company, year, CASH_COLUMNS)


def financial_ratios(ratios: DataFrame, companies: DataFrame, company: str, year: int) -> DataFrame:
    return (
        _where(ratios, year=year)
        .join(_company(companies, company), "company_id")
        .select("company", "year", "ratio_name", "value", "formula", "source_type")
        .orderBy("ratio_name")
    )


def shareholders(holders: DataFrame, companies: DataFrame, company: str, year: int | None = None, limit: int = 50) -> DataFrame:
    return (
        _where(holders, year=year)
        .join(_company(companies, company), "company_id")
        .select("company", "year", "shareholder_name", "ownership_percentage", "shares")
        .orderBy(F.desc("year"), F.desc_nulls_last("ownership_percentage"), "shareholder_name")
        .limit(limit)
    )


def list_companies(companies: DataFrame, reports: DataFrame, sector: str | None = None) -> DataFrame:
    """Companies with report count and year span; companies without reports stay.

    Reports are folded to one row per company before the join, so the join moves few rows.
    """
    spans = (
        reports.groupBy("company_id")
        .agg(
            F.count_distinct("year").alias("n_reports"),
            F.min("year").alias("year_first"),
            F.max("year").alias("year_last"),
        )
    )
    return (
        _where(companies, sector=sector)
        .join(spans, "company_id", "left")
        .select("normalized_name", "name", "ticker", "sector", F.coalesce("n_reports", F.lit(0)).alias("n_reports"), "year_first", "year_last")
        .orderBy("name")
    )


def available_years(companies: DataFrame, reports: DataFrame, company: str | None) -> DataFrame:
    return (
        reports.join(_company(companies, company), "company_id")
        .select(F.col("company").alias("name"), "year", "extraction_status", "extraction_quality")
        .orderBy("name", F.desc("year"))
    )


def financials_bundle(keys: DataFrame, income: DataFrame, balance: DataFrame, cash: DataFrame, ratios: DataFrame) -> DataFrame:
    """One nested record per (company_id, year): three statements and the ratio list.

    Of several statements of a year the first by `_best_first` is taken.
    """
    by = ["company_id", "year"]

    def nest(df: DataFrame, columns, name: str) -> DataFrame:
        first = Window.partitionBy(*by).orderBy(*_best_first(df))
        one = df.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") == 1)
        return one.select(*by, F.struct(*columns).alias(name))

    listed = ratios.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("ratio_name", "value", "formula", "source_type"))).alias("ratios")
    )
    return (
        keys.select(*by)
        .join(nest(income, INCOME_COLUMNS, "income_statement"), by, "left")
        .join(nest(balance, BALANCE_COLUMNS, "balance_sheet"), by, "left")
        .join(nest(cash, CASH_COLUMNS, "cash_flow"), by, "left")
        .join(listed, by, "left")
    )


def quality_report(companies: DataFrame, reports: DataFrame, facts: DataFrame, sector: str | None = None) -> DataFrame:
    """Fact count per (company, year, status, quality); a repeated name is blank."""
    counts = facts.groupBy("report_id").agg(F.count(F.lit(1)).alias("n"))
    per_report = reports.join(counts, "report_id", "left").select(
        "company_id", "year", "extraction_status", "extraction_quality", "n"
    )
    rows = (
        _where(companies, sector=sector)
        .join(per_report, "company_id", "left")
        .groupBy("name", "year", "extraction_status", "extraction_quality")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_metrics"))
    )
    # The first row of a name is its greatest (year, status, quality): an aggregate, no window.
    place = F.struct("year", "extraction_status", "extraction_quality")
    tops = rows.groupBy("name").agg(F.max(place).alias("_top"))
    return (
        rows.join(tops, "name")
        .withColumn("shown_name", F.when(place.eqNullSafe(F.col("_top")), F.col("name")).otherwise(F.lit("")))
        .drop("_top")
        .orderBy("name", F.desc("year"), F.desc("extraction_status"), F.desc("extraction_quality"))
    )


def totals(companies: DataFrame, reports: DataFrame, facts: DataFrame) -> DataFrame:
    """One row: companies, reports, completed reports, facts, mean quality of the completed."""
    done = F.col("extraction_status") == "completed"
    parts = [
        companies.select(F.lit("company").alias("kind"), F.lit(None).cast("double").alias("q"), F.lit(False).alias("done")),
        reports.select(F.lit("report").alias("kind"), F.col("extraction_quality").cast("double").alias("q"), done.alias("done")),
        facts.select(F.lit("fact").alias("kind"), F.lit(None).cast("double").alias("q"), F.lit(False).alias("done")),
    ]
    kind = F.col("kind")
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).agg(
        F.count_if(kind == "company").alias("companies"),
        F.count_if(kind == "report").alias("reports"),
        F.count_if(F.coalesce(F.col("done"), F.lit(False))).alias("completed"),
        F.count_if(kind == "fact").alias("metrics"),
        F.coalesce(F.avg(F.when(F.col("done"), F.col("q"))), F.lit(0.0)).alias("avg_quality"),
    )


def validation_sweep(income: DataFrame, balance: DataFrame, companies: DataFrame, company: str | None = None, year: int | None = None) -> DataFrame:
    """One row per warning over stored statements."""
    who = _company(companies, company)

    def warn(df: DataFrame, kind: str, check: Column) -> DataFrame:
        return (
            _where(df, year=year)
            .select("company_id", "year", check["warnings"].alias("w"))
            .filter(F.size("w") > 0)
            .join(who, "company_id")
            .select(F.lit(kind).alias("statement"), "company", "year", F.explode("w").alias("warning"))
        )

    bs = warn(balance, "BS", balance_check(F.col("total_assets"), F.col("total_liabilities"), F.col("equity")))
    rev = revenue_or_banking(F.col("revenue"), F.col("net_banking_income"))
    ist = warn(income, "IS", income_check(rev, F.col("net_income"), F.col("gross_profit")))
    return bs.unionByName(ist)


def low_confidence_count(facts: DataFrame) -> DataFrame:
    return facts.agg(F.count_if(F.col("confidence") < MIN_CONFIDENCE).alias("low_confidence"))


def indexed_companies(stems: DataFrame, registry: DataFrame) -> DataFrame:
    """Companies having an indexed report, with their years newest first.

    `stems` carries (stem, company, company_normalized, year, sector).
    """
    seen = stems.join(registry.select("stem"), "stem", "left_semi")
    return (
        seen.groupBy("company_normalized")
        .agg(
            F.min_by("company", "stem").alias("company"),
            F.min_by("sector", "stem").alias("sector"),
            F.sort_array(F.collect_set(F.nullif("year", F.lit(""))), asc=False).alias("years"),
        )
        .orderBy("company", "company_normalized")
    )


def document_list(stems: DataFrame, registry: DataFrame) -> DataFrame:
    return (
        stems.filter(F.coalesce("document_url", F.lit("")) != "")
        .join(registry.select("stem"), "stem", "left_semi")
        .select("stem", "company", "company_normalized", "year", "sector", F.col("document_url").alias("url"))
        .orderBy("company", F.coalesce(F.col("year").try_cast("int"), F.lit(0)), "stem")
    )


def sector_counts(companies: DataFrame, listed: DataFrame, default: str = "Autre") -> DataFrame:
    """Companies per sector with how many are listed on the exchange (dim of names)."""
    flag = listed.select("normalized_name", F.lit(True).alias("is_listed")).distinct()
    return (
        companies.join(flag, "normalized_name", "left")
        .groupBy(F.coalesce(F.nullif("sector", F.lit("")), F.lit(default)).alias("sector"))
        .agg(
            F.count(F.lit(1)).alias("companies"),
            F.count_if(F.coalesce("is_listed", F.lit(False))).alias("listed"),
            F.count_if(~F.coalesce("is_listed", F.lit(False))).alias("unlisted"),
        )
        .orderBy("sector")
    )


def companies_by_sector(companies: DataFrame, default: str = "Non classé") -> DataFrame:
    """(sector, company) pairs, the sectors with most companies first."""
    df = companies.select(
        F.coalesce(F.nullif("sector", F.lit("")), F.lit(default)).alias("sector"), "name", "normalized_name"
    )
    sizes = df.groupBy("sector").agg(F.count(F.lit(1)).alias("sector_size"))
    return df.join(sizes, "sector").orderBy(F.desc("sector_size"), "sector", "name")


def search_companies(companies: DataFrame, text: str = "", sector: str | None = None, listed: DataFrame | None = None, listing: str = "all") -> DataFrame:
    df = _where(companies.withColumn("sector", F.coalesce(F.nullif("sector", F.lit("")), F.lit("Autre"))), sector=sector)
    if text.strip():
        df = df.filter(F.contains(F.lower("name"), F.lit(text.strip().lower())))
    if listed is not None and listing != "all":
        how = "left_semi" if listing == "listed" else "left_anti"
        df = df.join(listed.select("normalized_name"), "normalized_name", how)
    return df


def search_tables(tables: DataFrame, text: str = "", report: str | None = None, page: int | None = None) -> DataFrame:
    """Tables with any row containing the text."""
    df = _where(tables, report=report, page=page)
    needle = text.strip().lower()
    if needle:
        df = df.filter(
            F.exists("rows", lambda r: F.contains(F.lower(F.array_join(r, " ")), F.lit(needle)))
        )
    return df
