"""Warehouse build: seeds, fact dedupe, statement pivot, upserts, run statistics.

Keep-first and keep-best are `min_by` / `max_by` aggregates, not windows: they combine on
the map side, so a key that holds a large share of the rows shrinks before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checks import balance_check, income_check, revenue_or_banking
from ..functions.text import slug, strip
from ..functions.vocab import METRICS, STATEMENT_METRICS
from ..session import write_counted
from ..sources.bucketed import BucketTable

FACT_POSITION = ("page", "table_no", "row_index", "col_index")
WORK_STATUSES = ("pending", "partial", "failed")


def best_row(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One whole row per key: the one with the greatest order value."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), order).alias("_best"))
        .select(*keys, *[F.col(f"_best.`{c}`").alias(c) for c in rest])
        .select(*df.columns)
    )


def seed_companies(manifest: DataFrame, dim: DataFrame, existing: DataFrame) -> DataFrame:
    """New companies of a manifest (row_no, company_name): one per slug, first name wins.

    Attributes come from `dim` (name, sector, external_id, url) by exact name. The key is a
    64-bit hash of the slug: stable over runs, and no global numbering is needed.
    """
    named = manifest.withColumn("name", strip(F.col("company_name"))).filter(F.col("name") != "")
    firsts = (
        named.withColumn("normalized_name", slug(F.col("name")))
        .groupBy("normalized_name")
        .agg(F.min_by("name", "row_no").alias("name"))
    )
    fresh = firsts.join(existing.select("normalized_name"), "normalized_name", "left_anti")
    return fresh.join(dim, "name", "left").select(
        F.xxhash64("normalized_name").alias("company_id"),
        "name",
        "normalized_name",
        "sector",
        "external_id",
        "url",
        F.lit("MA").alias("country"),
    )


def seed_reports(manifest: DataFrame, files: DataFrame, existing: DataFrame) -> DataFrame:
    """Merge manifest rows into reports keyed by (company slug, year).

    `files` (stem, path, file_hash, file_size) fills the path of a report once the file is
    there; an existing path is never changed. `is_new` and `n_skipped` carry the counts:
    a row is skipped when its year is no number or its report is known already.
    """
    year_text = strip(F.coalesce("year", F.lit("")))
    rows = (
        manifest.withColumn("name", strip(F.col("company_name")))
        .filter(F.col("name") != "")
        .select(
            slug(F.col("name")).alias("normalized_name"),
            F.when(F.regexp_like(year_text, F.lit(r"^[+-]?[0-9]+$")), year_text).try_cast("int").alias("year"),
            "row_no",
            F.struct(
                strip(F.coalesce("file_name", F.lit(""))).alias("file_name"),
                F.nullif(strip(F.coalesce("source_url", F.lit(""))), F.lit("")).alias("source_url"),
            ).alias("doc"),
        )
    )
    new = (
        rows.groupBy("normalized_name", "year")
        .agg(F.min_by("doc", "row_no").alias("doc"), F.count(F.lit(1)).alias("n_rows"))
        .withColumn("stem", F.concat_ws("_", "normalized_name", F.col("year").cast("string")))
    )
    old = existing.select(
        "normalized_name", "year", *[F.col(c).alias(f"old_{c}") for c in ("pdf_filename", "pdf_path", "source_url", "file_hash", "file_size", "extraction_status")],
        F.lit(True).alias("is_old"),
    )
    # An outer join on a null year keeps the rows whose year could not be read.
    merged = new.join(old, ["normalized_name", "year"], "full_outer").withColumn(
        "stem", F.coalesce("stem", F.concat_ws("_", "normalized_name", F.col("year").cast("string")))
    )
    merged = merged.join(
        files.select("stem", F.col("path").alias("f_path"), F.col("file_hash").alias("f_hash"), F.col("file_size").alias("f_size")),
        "stem",
        "left",
    )
    is_old = F.coalesce("is_old", F.lit(False))
    seen = F.col("n_rows").isNotNull()
    fill = F.col("f_path").isNotNull() & F.col("old_pdf_path").isNull() & seen
    pdf_name = F.concat(F.col("stem"), F.lit(".pdf"))
    return merged.select(
        "normalized_name",
        "year",
        F.when(fill, pdf_name).when(is_old, F.col("old_pdf_filename")).otherwise(F.col("doc.file_name")).alias("pdf_filename"),
        F.when(fill, F.col("f_path")).otherwise(F.col("old_pdf_path")).alias("pdf_path"),
        F.when(is_old, F.col("old_source_url")).otherwise(F.col("doc.source_url")).alias("source_url"),
        F.when(fill, F.col("f_hash")).otherwise(F.col("old_file_hash")).alias("file_hash"),
        F.when(fill, F.col("f_size")).otherwise(F.col("old_file_size")).alias("file_size"),
        F.coalesce("old_extraction_status", F.lit("pending")).alias("extraction_status"),
        F.col("stem").alias("chunk_stem"),
        (~is_old & F.col("year").isNotNull()).alias("is_new"),
        F.when(F.col("year").isNull() | is_old, F.coalesce("n_rows", F.lit(0)))
        .otherwise(F.col("n_rows") - 1)
        .alias("n_skipped"),
    )


def seed_counts(seeded: DataFrame) -> DataFrame:
    return seeded.agg(
        F.count_if("is_new").alias("new_reports"), F.coalesce(F.sum("n_skipped"), F.lit(0)).alias("skipped")
    )


def dedupe_facts(facts: DataFrame, report_keys: tuple[str, ...] = ("report",)) -> DataFrame:
    """Highest confidence per (report, metric, year, statement); the earliest wins a tie.

    `first_position` is the earliest place the fact was seen at, which orders the facts of
    a report.
    """
    keys = [*report_keys, "normalized_name", "year", "statement_type"]
    rest = [c for c in facts.columns if c not in keys]
    place = F.struct(*[F.col(c) for c in FACT_POSITION])
    order = F.struct(F.col("confidence"), *[-F.col(c) for c in FACT_POSITION])
    return (
        facts.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), order).alias("_best"), F.min(place).alias("first_position"))
        .select(*keys, *[F.col(f"_best.{c}").alias(c) for c in rest], "first_position")
    )


def build_statements(facts: DataFrame, report_keys: tuple[str, ...] = ("report",)) -> DataFrame:
    """One row per (report, statement, year) with a column per metric.

    The metric list is fixed, so no pass is needed to find pivot columns. The unit is the
    first one known in fact order; the page is the lowest.
    """
    value = lambda m: F.max(F.when(F.col("normalized_name") == m, F.col("value"))).alias(m)
    return facts.groupBy(*report_keys, "statement_type", "year").agg(
        F.min_by("unit", F.when(F.coalesce("unit", F.lit("")) != "", F.col("first_position"))).alias("unit"),
        F.first("currency").alias("currency"),
        F.avg("confidence").alias("confidence"),
        F.min(F.when(F.col("page") > 0, F.col("page"))).alias("source_page"),
        F.count(F.lit(1)).alias("n_facts"),
        *[value(m) for m in METRICS],
    )


def statement_table(statements: DataFrame, statement: str) -> DataFrame:
    """Statements of one type with their own columns and check results."""
    head = [c for c in statements.columns if c not in METRICS]
    df = statements.filter(F.col("statement_type") == statement).select(*head, *STATEMENT_METRICS[statement])
    if statement == "balance_sheet":
        df = df.withColumn("_check", balance_check(F.col("total_assets"), F.col("total_liabilities"), F.col("equity")))
        return df.select(
            "*",
            F.col("_check.passed").alias("balance_check_passed"),
            F.col("_check.discrepancy_pct").alias("balance_discrepancy_pct"),
            F.col("_check.warnings").alias("warnings"),
        ).drop("_check")
    if statement == "income_statement":
        check = income_check(
            revenue_or_banking(F.col("revenue"), F.col("net_banking_income")),
            F.col("net_income"),
            F.col("gross_profit"),
        )
        return df.withColumn("warnings", check["warnings"])
    return df


def extraction_jobs(
    reports: DataFrame, facts: DataFrame, errors: DataFrame, ocr: DataFrame, key: str = "report"
) -> DataFrame:
    """Per report: fact count, status and quality of its extraction."""
    stats = facts.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_metrics"),
        F.avg("confidence").alias("_avg"),
        F.count_distinct("normalized_name").alias("_distinct"),
    )
    failed = errors.groupBy(key).agg(F.count(F.lit(1)).alias("n_errors"))
    df = (
        reports.select(key)
        .join(stats, key, "left")
        .join(failed, key, "left")
        .join(ocr.select(key, "needs_ocr"), key, "left")
        .fillna(0, ["n_metrics", "n_errors"])
        .fillna(False, ["needs_ocr"])
    )
    none, wrong = F.col("n_metrics") == 0, F.col("n_errors") > 0
    status = (
        F.when(F.col("needs_ocr"), "ocr_required")
        .when(none & wrong, "failed")
        .when(none | wrong, "partial")
        .otherwise("completed")
    )
    quality = F.round(
        F.col("_avg") * 0.6 + F.least(F.lit(1.0), F.col("_distinct") / 10) * 0.4, 4
    )
    return df.select(
        key,
        F.when(F.col("needs_ocr"), 0).otherwise(F.col("n_metrics")).alias("n_metrics"),
        "n_errors",
        status.alias("extraction_status"),
        F.when(none | F.col("needs_ocr"), 0.0).otherwise(quality).alias("extraction_quality"),
    )


FACT_KEY = ["report_id", "normalized_metric_name", "year", "statement_type"]
FACT_UPDATES = ["raw_value", "value", "unit", "confidence", "validation_warning"]


def upsert_facts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merge facts: a known key takes new values only with a higher confidence."""
    both = old.withColumn("_old", F.lit(1)).unionByName(new.withColumn("_old", F.lit(0)))
    rest = [c for c in old.columns if c not in FACT_KEY and c not in FACT_UPDATES]
    return (
        both.groupBy(*FACT_KEY)
        .agg(
            F.max_by(F.struct(*FACT_UPDATES), F.struct("confidence", "_old")).alias("_u"),
            F.max_by(F.struct(*rest), F.struct("_old", "confidence")).alias("_r"),
        )
        .select(
            *FACT_KEY, *[F.col(f"_u.{c}").alias(c) for c in FACT_UPDATES], *[F.col(f"_r.{c}").alias(c) for c in rest]
        )
        .select(*old.columns)
    )


def fact_table(spark: SparkSession, path: str, facts: DataFrame) -> BucketTable:
    """Facts in buckets by their key, for upserts that leave untouched buckets alone."""
    return BucketTable(spark, path, facts.schema, FACT_KEY)


def upsert_stored_facts(table: BucketTable, new: DataFrame) -> None:
    """`upsert_facts` into a stored table: of new rows of one key the most confident counts."""
    table.merge(best_row(new, FACT_KEY, F.struct("confidence")), FACT_UPDATES, lambda old, fresh: fresh > old, "confidence")


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows as they are, plus new rows whose key is unknown."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def backfill_reports(reports: DataFrame, results: DataFrame) -> DataFrame:
    """Take status and quality of the last run; hash and page count only where empty."""
    r = results.select(
        "report_id",
        *[F.col(c).alias(f"r_{c}") for c in ("extraction_status", "extraction_quality", "file_hash", "page_count")],
    )
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    df = reports.join(r, "report_id", "left")
    return df.select(
        *[
            c
            for c in reports.columns
            if c not in ("extraction_status", "extraction_quality", "file_hash", "page_count")
        ],
        F.coalesce("r_extraction_status", "extraction_status").alias("extraction_status"),
        F.coalesce("r_extraction_quality", "extraction_quality").alias("extraction_quality"),
        F.coalesce(some("file_hash"), some("r_file_hash")).alias("file_hash"),
        F.coalesce(F.when(F.col("page_count") > 0, F.col("page_count")), F.col("r_page_count")).alias("page_count"),
    ).select(*reports.columns)


def ratios(income: DataFrame, balance: DataFrame, keys: tuple[str, ...] = ("report_id", "year")) -> DataFrame:
    """Return on equity and on assets in long form."""
    money = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")).cast("decimal(20,6)")
    joined = income.select(*keys, "net_income").join(balance.select(*keys, "equity", "total_assets"), list(keys))
    return (
        joined.select(*keys, money("net_income", "equity").alias("ROE"), money("net_income", "total_assets").alias("ROA"))
        .unpivot(list(keys), ["ROE", "ROA"], "ratio_name", "value")
        .filter(F.col("value").isNotNull())
        .withColumn(
            "formula",
            F.when(F.col("ratio_name") == "ROE", "net_income / equity").otherwise("net_income / total_assets"),
        )
        .withColumn("source_type", F.lit("calculated"))
    )


def work_list(
    reports: DataFrame, companies: DataFrame, force: bool = False, company: str | None = None, limit: int | None = None
) -> DataFrame:
    """Reports still to extract, in report order."""
    df = reports if force else reports.filter(F.col("extraction_status").isin(*WORK_STATUSES))
    if company is not None:
        chosen = companies.filter(F.col("normalized_name") == company).select("company_id")
        df = df.join(chosen, "company_id", "left_semi")
    df = df.orderBy("report_id")
    return df.limit(limit) if limit else df


def _stat_columns() -> dict[str, Column]:
    status = F.col("extraction_status")
    return {
        "n_ok": F.count_if(status.isin("completed", "partial")),
        "n_ocr": F.count_if(status == "ocr_required"),
        "n_failed": F.count_if(~status.isin("completed", "partial", "ocr_required")),
    }


def run_stats(jobs: DataFrame) -> DataFrame:
    return jobs.agg(*[c.alias(n) for n, c in _stat_columns().items()])


def write_jobs(path: str, jobs: DataFrame) -> DataFrame:
    """Write extraction jobs; their `run_stats` are observed in the same pass."""
    told = write_counted(jobs, path, **_stat_columns())
    return jobs.sparkSession.createDataFrame([tuple(told.values())], ", ".join(f"{n} bigint" for n in told))


def error_rows(reports: DataFrame, error_type: str = "FileNotFound") -> DataFrame:
    """Dead-letter rows of reports that have no file to read."""
    return reports.filter(F.coalesce("pdf_path", F.lit("")) == "").select(
        "report_id",
        "pdf_filename",
        F.lit(error_type).alias("error_type"),
        F.concat(F.lit("no file for report "), F.col("report_id").cast("string")).alias("error_message"),
    )
