"""Fact extraction: raw report tables to (metric, year, value, unit, confidence) facts.

A page row carries its tables as array<array<array<string>>>; everything up to the fact
rows is narrow (no shuffle), so a report of any size is spread as its pages are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import FACTOR_OF_UNIT, parse_value, unit_of
from ..functions.text import YEAR_PATTERN, const_map, fold, let, squeeze
from ..functions.vocab import (
    STATEMENT_WORDS, category_of, metric_of, statement_from_hits, statement_hits, statement_of,
)

HEADER_ROWS = 5
MIN_TABLE_ROWS = 3
UNIT_ROWS = 3
# Weights of the seven confidence signals.
CONFIDENCE_WEIGHTS = {
    "clear_label": 0.25,
    "has_year": 0.20,
    "has_unit": 0.15,
    "from_table": 0.15,
    "plausible_value": 0.15,
    "no_footnote_conflict": 0.05,
    "fits_context": 0.05,
}


def explode_tables(pages: DataFrame) -> DataFrame:
    """One row per (report, page, table_no) with cleaned cells and the page's context unit.

    The unit is looked for in the first 300 characters of the page text; the first 200 are
    kept as the source snippet of its facts.
    """
    clean = lambda row: F.transform(F.coalesce(row, F.array().cast("array<string>")), squeeze)
    head = F.substring(F.coalesce(F.col("text"), F.lit("")), 1, 300)
    df = pages.withColumn("context_unit", unit_of(head)["unit"]).withColumn(
        "source_text",
        F.nullif(F.replace(F.substring("text", 1, 200), F.lit("\n"), F.lit(" ")), F.lit("")),
    )
    keep = [c for c in pages.columns if c not in ("tables", "text")]
    return df.select(
        *keep, "context_unit", "source_text", F.posexplode("tables").alias("_pos", "_rows")
    ).select(
        *keep,
        (F.col("_pos") + 1).alias("table_no"),
        "context_unit",
        "source_text",
        F.transform("_rows", clean).alias("rows"),
    )


def year_columns(row: Column) -> Column:
    """array<struct(col, year)> of the cells of a row that show a year."""
    found = F.transform(
        row,
        lambda cell, i: F.struct(
            i.alias("col"),
            F.regexp_extract(cell, YEAR_PATTERN, 1).alias("text"),
        ),
    )
    return F.transform(
        F.filter(found, lambda c: c["text"] != ""),
        lambda c: F.struct(c["col"].alias("col"), c["text"].cast("int").alias("year")),
    )


def _table_unit(rows: Column, header_index: Column, context: Column) -> Column:
    """struct(unit, factor): header row, else context (factor 1), else the first rows."""
    row_text = lambda i: F.array_join(F.get(rows, i), " ")
    firsts = F.filter(
        F.transform(F.expr(f"array({', '.join(map(str, range(UNIT_ROWS)))})"), lambda i: unit_of(row_text(i))),
        lambda u: u["unit"].isNotNull(),
    )
    plain = F.struct(context.alias("unit"), F.lit(1.0).alias("factor"))
    return let(
        unit_of(row_text(header_index)),
        lambda head: F.when(head["unit"].isNotNull(), head)
        .when(context.isNotNull(), plain)
        .otherwise(F.coalesce(F.get(firsts, F.lit(0)), plain)),
    )


def describe_tables(tables: DataFrame) -> DataFrame:
    """Add header_index, year_cols, unit, factor and statement_type to cleaned tables."""
    heads = F.transform(
        F.slice("rows", 1, HEADER_ROWS),
        lambda row, i: F.struct(i.alias("idx"), year_columns(row).alias("cols")),
    )
    head = F.get(F.filter(heads, lambda h: F.size(h["cols"]) > 0), F.lit(0))
    df = tables.withColumn("_head", F.when(F.size("rows") >= MIN_TABLE_ROWS, head))
    df = df.withColumn("header_index", F.col("_head.idx")).withColumn("year_cols", F.col("_head.cols"))
    found = F.col("header_index").isNotNull()
    df = df.withColumn(
        "_unit", F.when(found, _table_unit(F.col("rows"), F.col("header_index"), F.col("context_unit")))
    )
    labels = F.filter(
        F.transform("rows", lambda r: fold(F.get(r, F.lit(0)))), lambda c: c != ""
    )
    statement = let(
        labels,
        lambda x: let(
            F.struct(*[statement_hits(x, name).alias(name) for name in STATEMENT_WORDS]),
            lambda h: statement_from_hits(h["income_statement"], h["balance_sheet"], h["cash_flow"]),
        ),
    )
    return (
        df.withColumn("unit", F.col("_unit.unit"))
        .withColumn("factor", F.coalesce("_unit.factor", F.lit(1.0)))
        .withColumn("statement_type", F.when(found, statement))
        .drop("_head", "_unit")
    )


def melt_tables(described: DataFrame, word_boundary: bool = False) -> DataFrame:
    """Data rows x year columns to fact rows; only known labels with a parsable cell stay.

    The facts of a row are built as one array and exploded, so nothing is parsed twice.
    """
    keys = [c for c in described.columns if c not in ("rows", "header_index", "year_cols", "unit", "factor", "statement_type")]
    rows = described.filter(F.col("header_index").isNotNull()).select(
        *keys,
        F.col("unit").alias("table_unit"),
        F.col("factor").alias("table_factor"),
        F.col("statement_type").alias("table_statement"),
        "header_index",
        "year_cols",
        F.posexplode("rows").alias("row_index", "_row"),
    )
    rows = rows.filter(F.col("row_index") > F.col("header_index"))

    def cells(named):
        parsed = F.transform(
            F.filter(F.col("year_cols"), lambda c: F.coalesce(F.get("_row", c["col"]), F.lit("")) != ""),
            lambda c: F.struct(
                named["label"].alias("metric_name"),
                named["metric"].alias("normalized_name"),
                c["col"].alias("col_index"),
                c["year"].alias("year"),
                F.get("_row", c["col"]).alias("raw_value"),
                parse_value(F.get("_row", c["col"]), F.col("table_unit")).alias("parsed"),
            ),
        )
        return F.filter(parsed, lambda f: f["parsed"]["value"].isNotNull())

    label = F.get("_row", F.lit(0))
    named = F.filter(
        F.transform(
            F.filter(F.array(label), lambda t: F.length(t) >= 2),
            lambda t: F.struct(t.alias("label"), metric_of(t, word_boundary).alias("metric")),
        ),
        lambda n: n["metric"].isNotNull(),
    )
    facts = rows.select(
        *keys, "table_unit", "table_factor", "table_statement", "row_index",
        F.explode(F.flatten(F.transform(named, cells))).alias("f"),
    )
    unit = F.col("f.parsed.unit")
    real = const_map(FACTOR_OF_UNIT)
    base = F.col("f.parsed.value") * F.coalesce(F.element_at(real, unit), F.lit(1.0))
    return facts.select(
        *keys,
        "row_index",
        "f.col_index",
        "f.metric_name",
        "f.normalized_name",
        category_of(F.col("f.normalized_name")).alias("metric_category"),
        statement_of(F.col("f.normalized_name")).alias("statement_type"),
        "f.year",
        "f.raw_value",
        F.col("f.parsed.value").alias("value"),
        unit.alias("unit"),
        F.when(unit == F.col("table_unit"), F.col("table_factor")).otherwise(F.col("f.parsed.factor")).alias("factor"),
        F.when(~F.col("f.parsed.is_percentage"), base).alias("value_base"),
        F.col("f.parsed.is_percentage").alias("is_percentage"),
        F.col("f.parsed.confidence").alias("value_confidence"),
        "table_unit",
        "table_statement",
    )


def plausible(value: Column) -> Column:
    return F.coalesce(F.abs(value) <= 1e15, F.lit(False))


def fact_confidence(metric: Column, year: Column, value: Column, unit: Column, from_table: Column) -> Column:
    """Weighted share of the signals that hold, in [0, 1], four decimals."""
    w = CONFIDENCE_WEIGHTS
    signal = lambda cond, weight: F.when(F.coalesce(cond, F.lit(False)), weight).otherwise(0.0)
    total = (
        signal(F.length(metric) >= 3, w["clear_label"])
        + signal(year.between(1990, 2030), w["has_year"])
        + signal(unit.isNotNull(), w["has_unit"])
        + signal(from_table, w["from_table"])
        + signal(plausible(value), w["plausible_value"])
        + F.lit(w["no_footnote_conflict"])
        + F.lit(w["fits_context"])
    )
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4)


def extract_facts(pages: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Pages (report, page, text, tables) to facts above the confidence threshold."""
    described = describe_tables(explode_tables(pages).filter(F.size("rows") >= 2))
    facts = melt_tables(described)
    return (
        facts.withColumn(
            "confidence",
            fact_confidence(F.col("normalized_name"), F.col("year"), F.col("value"), F.col("unit"), F.lit(True)),
        )
        .filter(F.col("confidence") >= threshold)
        .withColumn("unit", F.coalesce("unit", "table_unit"))
        .withColumn("currency", F.lit("MAD"))
        .withColumn("extraction_method", F.lit("table"))
    )


def table_confidence(facts: DataFrame, keys=("report", "page", "table_no")) -> DataFrame:
    """Per table: number of facts, years found (newest first) and the table confidence."""
    n = F.count(F.lit(1))
    unit_bonus = F.when(F.max("table_unit").isNotNull(), 0.1).otherwise(0.0)
    score = F.lit(0.4) + F.least(F.lit(0.6), n * 0.05) + unit_bonus
    return facts.groupBy(*keys).agg(
        n.alias("n_facts"),
        F.sort_array(F.collect_set("year"), asc=False).alias("years_found"),
        F.least(F.lit(1.0), score).alias("table_confidence"),
    )


def value_checks(df: DataFrame, percentage_field: str = "value") -> DataFrame:
    """Flags: plausible magnitude, year in [1980, 2030], percentage in [-150, 150]."""
    year_ok = F.coalesce(F.col("year").between(1980, 2030), F.lit(False))
    pct = F.col(percentage_field)
    pct_ok = ~F.col("is_percentage") | pct.isNull() | pct.between(-150, 150)
    return (
        df.withColumn("plausible", plausible(F.col("value")))
        .withColumn("year_ok", year_ok)
        .withColumn("percentage_ok", pct_ok)
        .withColumn(
            "warnings",
            F.array_compact(
                F.array(
                    F.when(F.col("year").isNull(), F.lit("year is None")).when(
                        ~year_ok, F.concat(F.lit("year="), F.col("year"), F.lit(" is implausible"))
                    ),
                    F.when(
                        ~pct_ok,
                        F.concat(
                            F.lit(f"{percentage_field}="),
                            F.replace(F.format_number(pct, 2), F.lit(","), F.lit("")),
                            F.lit(" out of expected percentage range [-150, 150]"),
                        ),
                    ),
                )
            ),
        )
    )
