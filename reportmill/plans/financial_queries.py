"""Registered queries: facts (X), warehouse (W), relational questions (Q)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import parse_number, parse_value, unit_of
from ..functions.text import fold, slug, squeeze, years_in
from ..functions.vocab import METRIC_OF_ALIAS, category_of, metric_of, statement_of
from ..operators import facts as X
from ..operators import financials as Q
from ..operators import warehouse as W
from ..session import scratch_path
from . import inputs as I
from .catalog import ORACLES, query

COMPANY, YEAR = "supplier_000000005", 1998
WORDS = " '[\\s\\x0b\\x1c-\\x1f\\x85\\xa0]+' "
FOLD_SQL = "trim(regexp_replace(lower(regexp_replace(strip_accents({0}), '[^\\x00-\\x7F]', '', 'g')), '[\\s\\x0b\\x1c-\\x1f]+', ' ', 'g'))"


def fold_sql(expr: str) -> str:
    return FOLD_SQL.format(expr)


def doubles(df, *names):
    return df.select(*[F.col(c).cast("double").alias(c) if c in names else F.col(c) for c in df.columns])


# ---- facts ---------------------------------------------------------------------------


def page_facts(spark, d):
    return X.extract_facts(I.report_pages(spark, d))


FACT_COLUMNS = (
    "report", "page", "table_no", "row_index", "col_index", "metric_name", "normalized_name",
    "year", "value", "unit", "factor",
)


@query("x01_fold_text", f"SELECT doc_id, {fold_sql('text')} AS folded FROM documents")
def _(spark, d):
    return I.spread_table(spark, d, "documents", "doc_id").select("doc_id", fold(F.col("text")).alias("folded"))


@query(
    "x02_name_slug",
    """SELECT doc_id, trim(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', '_', 'g'), '_') AS slug
       FROM documents""",
)
def _(spark, d):
    return I.table(spark, d, "documents").select("doc_id", slug(F.col("text")).alias("slug"))


def _unit_sql(expr: str) -> str:
    from ..functions.numbers import UNITS, UNITS_BY_LENGTH

    tests = " ".join(f"WHEN contains({expr}, '{u}') THEN '{UNITS[u][0]}'" for u in UNITS_BY_LENGTH)
    factors = " ".join(f"WHEN contains({expr}, '{u}') THEN {UNITS[u][1]}" for u in UNITS_BY_LENGTH)
    return f"CASE {tests} END AS unit, CAST(CASE {factors} ELSE 1.0 END AS DOUBLE) AS factor"


@query("x03_detect_unit", f"SELECT doc_id, {_unit_sql('lower(text)')} FROM documents")
def _(spark, d):
    df = I.table(spark, d, "documents").select("doc_id", unit_of(F.col("text")).alias("u"))
    return df.select("doc_id", "u.unit", "u.factor")


@query(
    "x04_parse_numbers",
    """SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(20,2)) AS DOUBLE) AS spaced,
        -CAST(CAST(l_extendedprice AS DECIMAL(20,2)) AS DOUBLE) AS negative,
        CAST(CAST(l_extendedprice AS DECIMAL(20,2)) AS DOUBLE) AS with_unit,
        CAST(NULL AS DOUBLE) AS nothing, l_partkey, l_suppkey
       FROM lineitem""",
)
def _(spark, d):
    text = I.french(F.col("l_extendedprice"))
    df = I.spread_table(spark, d, "lineitem", "l_orderkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        text.alias("t1"),
        F.concat(F.lit("("), text, F.lit(")")).alias("t2"),
        F.concat(text, F.lit(" MDH (estimé)")).alias("t3"),
        F.lit("néant").alias("t4"),
    )
    names = {"t1": "spaced", "t2": "negative", "t3": "with_unit", "t4": "nothing"}
    return df.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        *[parse_number(F.col(src)).alias(out) for src, out in names.items()],
    )


@query(
    "x05_value_with_unit",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 3 <> 1 THEN CAST(CAST(l_quantity AS DECIMAL(20,2)) AS DOUBLE) END AS value,
        CASE CAST(l_linenumber % 3 AS INTEGER) WHEN 0 THEN '%' WHEN 1 THEN 'MAD' ELSE 'MMAD' END AS unit,
        CASE CAST(l_linenumber % 3 AS INTEGER) WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 1000000.0::DOUBLE END AS factor,
        l_linenumber % 3 = 0 AS is_percentage, CASE WHEN l_linenumber % 3 <> 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS confidence
       FROM lineitem""",
)
def _(spark, d):
    suffix = F.get(F.array(F.lit(" %"), F.lit(" dirhams"), F.lit("")), (F.col("l_linenumber") % 3).cast("int"))
    df = I.spread_table(spark, d, "lineitem", "l_orderkey").withColumn("cell", F.concat(I.french(F.col("l_quantity")), suffix))
    df = df.withColumn("p", parse_value(F.col("cell"), F.lit("MMAD")))
    return df.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p.value", "p.unit", "p.factor", "p.is_percentage", "p.confidence"
    )


_ALIAS_VALUES = ", ".join(
    "('{}', '{}', {})".format(a.replace("'", "''"), m, i) for i, (a, m) in enumerate(METRIC_OF_ALIAS.items())
)


@query(
    "x06_label_to_metric",
    f"""WITH aliases(alias, metric, pos) AS (VALUES {_ALIAS_VALUES}),
       labels AS (SELECT p_partkey, {fold_sql("p_name || ' ' || p_type")} AS label FROM part
         UNION ALL SELECT doc_id, {fold_sql('text')} FROM documents),
       hits AS (SELECT DISTINCT label, first_value(metric) OVER (PARTITION BY label ORDER BY CASE WHEN alias = label THEN 0 ELSE 1 END, length(alias) DESC, pos) AS metric
         FROM (SELECT DISTINCT label FROM labels) JOIN aliases ON contains(label, alias))
       SELECT p_partkey AS label_id, length(labels.label) AS label_length, metric FROM labels LEFT JOIN hits ON labels.label = hits.label""",
)
def _(spark, d):
    parts = I.table(spark, d, "part").select(
        F.col("p_partkey").alias("label_id"), F.concat_ws(" ", "p_name", "p_type").alias("label")
    )
    docs = I.spread_table(spark, d, "documents", "doc_id").select(F.col("doc_id").alias("label_id"), F.col("text").alias("label"))
    label = F.col("label")
    return parts.unionByName(docs).select(
        "label_id", F.length(fold(label)).alias("label_length"), metric_of(label).alias("metric")
    )


@query(
    "x07_metric_groups",
    """SELECT normalized_metric_name AS metric,
        CASE WHEN normalized_metric_name = 'revenue' THEN 'revenue' WHEN normalized_metric_name IN ('gross_profit','income_tax','net_income') THEN 'profitability'
          WHEN normalized_metric_name = 'total_assets' THEN 'assets' WHEN normalized_metric_name = 'total_liabilities' THEN 'liabilities' ELSE 'equity' END AS category,
        CASE WHEN normalized_metric_name IN ('revenue','gross_profit','income_tax','net_income') THEN 'income_statement' ELSE 'balance_sheet' END AS statement,
        count(*) AS n_facts FROM facts GROUP BY 1, 2, 3""",
    uses=("facts",),
)
def _(spark, d):
    name = F.col("normalized_metric_name")
    return (
        I.metric_facts(spark, d)
        .groupBy(name.alias("metric"))
        .agg(F.count(F.lit(1)).alias("n_facts"))
        .select("metric", category_of(F.col("metric")).alias("category"), statement_of(F.col("metric")).alias("statement"), "n_facts")
    )


TABLE_SQL = """SELECT 'company_' || company_id || '_' || year AS report, p AS page, 1 AS table_no,
  CASE p WHEN 1 THEN 'income_statement' ELSE 'balance_sheet' END AS statement_type, 0 AS header_index,
  '1:' || year || ',2:' || (year - 1) AS year_cols,
  CASE p WHEN 1 THEN 'KMAD' ELSE 'MMAD' END AS unit, CASE p WHEN 1 THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END AS factor
  FROM wide, (VALUES (1), (2)) pages(p)"""


def described(spark, d):
    return X.describe_tables(X.explode_tables(I.report_pages(spark, d)))


@query("x08_statement_type", f"SELECT report, page, statement_type FROM ({TABLE_SQL})", uses=("wide",))
def _(spark, d):
    return described(spark, d).select("report", "page", "statement_type")


@query("x09_year_columns", f"SELECT report, page, table_no, header_index, year_cols FROM ({TABLE_SQL})", uses=("wide",))
def _(spark, d):
    pairs = F.transform("year_cols", lambda c: F.concat_ws(":", c["col"].cast("string"), c["year"].cast("string")))
    return described(spark, d).select("report", "page", "table_no", "header_index", F.array_join(pairs, ",").alias("year_cols"))


@query("x10_table_unit", f"SELECT report, page, unit, factor FROM ({TABLE_SQL})", uses=("wide",))
def _(spark, d):
    return described(spark, d).select("report", "page", "unit", "factor")


@query("x11_melt_tables", f"SELECT {', '.join(FACT_COLUMNS)} FROM cells", uses=("cells",))
def _(spark, d):
    return page_facts(spark, d).select(*FACT_COLUMNS)


@query(
    "x12_table_confidence",
    """SELECT report, page, table_no, count(*) AS n_facts, string_agg(DISTINCT CAST(year AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR) DESC) AS years_found,
        least(1.0, 0.4 + least(0.6, 0.05 * count(*)) + 0.1)::DOUBLE AS table_confidence FROM cells GROUP BY 1, 2, 3""",
    uses=("cells",),
)
def _(spark, d):
    df = X.table_confidence(page_facts(spark, d))
    return df.select(
        "report", "page", "table_no", "n_facts",
        F.array_join(F.transform("years_found", lambda y: y.cast("string")), ",").alias("years_found"),
        F.round("table_confidence", 4).alias("table_confidence"),
    )


@query(
    "x13_fact_confidence",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(0.25 + CASE WHEN year(l_shipdate) BETWEEN 1990 AND 2030 THEN 0.2 ELSE 0 END
        + CASE WHEN l_returnflag = 'N' THEN 0 ELSE 0.15 END + CASE WHEN l_linestatus = 'O' THEN 0.15 ELSE 0 END + 0.15 + 0.1 AS DOUBLE) AS confidence FROM lineitem""",
)
def _(spark, d):
    df = I.table(spark, d, "lineitem")
    unit = F.when(F.col("l_returnflag") != "N", F.lit("KMAD"))
    score = X.fact_confidence(
        F.lit("revenue"), F.year("l_shipdate"), F.col("l_extendedprice"), unit, F.col("l_linestatus") == "O"
    )
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", score.alias("confidence"))


@query(
    "x14_extract_pages",
    """SELECT report, page, normalized_name, year, value, unit,
        CASE page WHEN 1 THEN value * 1000.0 ELSE value * 1000000.0 END AS value_base, 1.0::DOUBLE AS confidence,
        CASE page WHEN 1 THEN 'Rapport annuel de ' ELSE 'Bilan, montants en millions de dirhams, ' END || regexp_replace(report, '_[0-9]+$', '') AS source_text
       FROM cells""",
    uses=("cells",),
)
def _(spark, d):
    return page_facts(spark, d).select(
        "report", "page", "normalized_name", "year", "value", "unit", "value_base", "confidence", "source_text"
    )


@query(
    "x15_value_checks",
    """SELECT company_id, year, ratio, abs(ratio) <= 1e15 AS plausible, year BETWEEN 1980 AND 2030 AS year_ok, ratio BETWEEN -150 AND 150 AS percentage_ok,
        CASE WHEN ratio BETWEEN -150 AND 150 THEN '' ELSE 'value=' || format('{:.2f}', ratio) || ' out of expected percentage range [-150, 150]' END AS warnings
       FROM (SELECT company_id, year, CAST(round(100 * CAST(equity AS DOUBLE) / CAST(net_income AS DOUBLE), 2) AS DOUBLE) AS ratio FROM wide)""",
    uses=("wide",),
)
def _(spark, d):
    ratio = F.round(F.col("equity").cast("double") * 100 / F.col("net_income").cast("double"), 2)
    df = I.wide_statements(spark, d).select("company_id", "year", ratio.alias("value"), F.lit(True).alias("is_percentage"))
    return X.value_checks(df).select(
        "company_id", "year", F.col("value").alias("ratio"), "plausible", "year_ok", "percentage_ok",
        F.array_join("warnings", "; ").alias("warnings"),
    )


@query(
    "x16_years_in_text",
    """SELECT page_id, array_to_string(list_transform(list_filter(list_zip(y, range(len(y))), lambda p: list_position(y, p[1]) = p[2] + 1), lambda p: p[1]), ',') AS years
       FROM (SELECT page_id, regexp_extract_all(url || ' ' || html, '\\b(20\\d{2}|19\\d{2})\\b', 1) AS y FROM pages)""",
)
def _(spark, d):
    text = F.concat_ws(" ", "url", "html")
    return I.table(spark, d, "pages").select("page_id", F.array_join(years_in(text), ",").alias("years"))


# ---- warehouse -----------------------------------------------------------------------


def manifest_rows(spark, d):
    """Manifest rows derived from order lines: names repeat with other spellings, some years are broken."""
    order = F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")
    spelled = F.when(F.col("l_linenumber") % 2 == 0, F.upper("s_name")).otherwise(F.col("s_name"))
    supplier = I.table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    year = F.when(F.col("l_linenumber") == 7, F.lit("n.d.")).otherwise(F.year("l_shipdate").cast("string"))
    return (
        I.table(spark, d, "lineitem")
        .join(supplier, "l_suppkey")
        .select(
            order.alias("row_no"), spelled.alias("company_name"), year.alias("year"),
            F.concat(F.lit("doc_"), F.col("l_orderkey").cast("string"), F.lit(".pdf")).alias("file_name"),
            F.concat(F.lit("https://files.example.com/"), F.col("l_orderkey").cast("string")).alias("source_url"),
        )
    )


MANIFEST_SQL = """SELECT l_orderkey * 100000000 + l_partkey * 10 + l_linenumber AS row_no,
   CASE WHEN l_linenumber % 2 = 0 THEN upper(s_name) ELSE s_name END AS company_name, lower(replace(s_name, '#', '_')) AS slug, s_suppkey, n_name,
   CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(year(l_shipdate) AS INTEGER) END AS year, 'doc_' || l_orderkey || '.pdf' AS file_name,
   'https://files.example.com/' || l_orderkey AS source_url
   FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey"""


@query(
    "w01_seed_companies",
    f"""SELECT slug AS normalized_name, arg_min(company_name, row_no) AS name,
         CASE WHEN arg_min(company_name, row_no) = any_value(s.s_name) THEN any_value(n_name) END AS sector, 'MA' AS country
        FROM ({MANIFEST_SQL}) m JOIN supplier s USING (s_suppkey) WHERE s.s_acctbal >= 0 GROUP BY slug""",
)
def _(spark, d):
    dim = I.companies(spark, d).select(
        "name", "sector", F.lit(None).cast("string").alias("external_id"), F.lit(None).cast("string").alias("url")
    )
    existing = I.table(spark, d, "supplier").filter(F.col("s_acctbal") < 0).select(slug(F.col("s_name")).alias("normalized_name"))
    return W.seed_companies(manifest_rows(spark, d), dim, existing).select("normalized_name", "name", "sector", "country")


_SEED_SQL = f"""
  files AS (SELECT lower(replace(s_name, '#', '_')) || '_' || y AS stem, '/files/' || s_suppkey || '/' || y AS path, 'h' || s_suppkey AS file_hash, 1000 + s_suppkey AS file_size
     FROM supplier, (VALUES (1996), (1998), (2000)) v(y)),
  old AS (SELECT normalized_name, year, 'old.pdf' AS pdf_filename, CASE WHEN company_id % 2 = 0 THEN '/old' END AS pdf_path, NULL AS source_url,
     NULL AS file_hash, NULL AS file_size, extraction_status FROM reports JOIN companies USING (company_id) WHERE extraction_status = 'completed'),
  new AS (SELECT slug, year, arg_min(file_name, row_no) AS file_name, arg_min(source_url, row_no) AS source_url, count(*) AS n FROM ({MANIFEST_SQL}) GROUP BY 1, 2),
  merged AS (SELECT coalesce(new.slug, old.normalized_name) AS normalized_name, coalesce(new.year, old.year) AS year, n, new.file_name, new.source_url AS new_url,
     old.*EXCLUDE (normalized_name, year), old.normalized_name IS NOT NULL AS is_old FROM new FULL JOIN old ON new.slug = old.normalized_name AND new.year = old.year),
  seeded AS (SELECT m.*, f.path, f.file_hash AS fh, f.file_size AS fs, f.path IS NOT NULL AND m.pdf_path IS NULL AND n IS NOT NULL AS fill
     FROM merged m LEFT JOIN files f ON f.stem = m.normalized_name || '_' || m.year)"""


def _seeded(spark, d):
    supplier = I.table(spark, d, "supplier")
    files = supplier.select(
        F.explode(F.array(F.lit(1996), F.lit(1998), F.lit(2000))).alias("y"), "s_suppkey", slug(F.col("s_name")).alias("n")
    ).select(
        F.concat_ws("_", "n", F.col("y").cast("string")).alias("stem"),
        F.concat(F.lit("/files/"), F.col("s_suppkey").cast("string"), F.lit("/"), F.col("y").cast("string")).alias("path"),
        F.concat(F.lit("h"), F.col("s_suppkey").cast("string")).alias("file_hash"),
        (F.col("s_suppkey") + 1000).alias("file_size"),
    )
    old = (
        I.reports(spark, d)
        .filter(F.col("extraction_status") == "completed")
        .join(I.companies(spark, d), "company_id")
        .select(
            "normalized_name", "year", F.lit("old.pdf").alias("pdf_filename"),
            F.when(F.col("company_id") % 2 == 0, "/old").alias("pdf_path"),
            F.lit(None).cast("string").alias("source_url"), F.lit(None).cast("string").alias("file_hash"),
            F.lit(None).cast("bigint").alias("file_size"), "extraction_status",
        )
    )
    return W.seed_reports(manifest_rows(spark, d), files, old)


@query(
    "w02_seed_reports",
    f"""WITH {_SEED_SQL} SELECT normalized_name, year, CASE WHEN fill THEN normalized_name || '_' || year || '.pdf' WHEN is_old THEN pdf_filename ELSE file_name END AS pdf_filename,
        CASE WHEN fill THEN path ELSE pdf_path END AS pdf_path, CASE WHEN NOT is_old THEN new_url END AS source_url, CASE WHEN fill THEN fh END AS file_hash,
        CASE WHEN fill THEN CAST(fs AS BIGINT) END AS file_size, coalesce(extraction_status, 'pending') AS extraction_status, NOT is_old AS is_new
        FROM seeded WHERE year IS NOT NULL""",
    uses=("reports", "companies"),
)
def _(spark, d):
    return _seeded(spark, d).filter(F.col("year").isNotNull()).drop("chunk_stem", "n_skipped")


@query(
    "w02_seed_counts",
    f"""WITH {_SEED_SQL} SELECT count(*) FILTER (WHERE NOT is_old AND year IS NOT NULL) AS new_reports,
        CAST(sum(CASE WHEN year IS NULL OR is_old THEN coalesce(n, 0) ELSE n - 1 END) AS BIGINT) AS skipped FROM seeded""",
    uses=("reports", "companies"),
)
def _(spark, d):
    return W.seed_counts(_seeded(spark, d))


def raw_facts(spark, d):
    """Several candidate facts per key: the extracted cells of every report, keyed by company.

    A value printed in two reports (its own year and the next) competes with itself.
    """
    df = page_facts(spark, d).withColumn("confidence", F.round(1 - (F.col("col_index") - 1) * 0.1 - F.col("page") * 0.01, 4))
    return df.withColumn("report", F.concat(F.lit("company_"), F.col("company_id").cast("string")))


RAW_SQL = """SELECT regexp_replace(report, '_[0-9]+$', '') AS report, normalized_name, year, value, unit, page, table_no, row_index, col_index,
   CASE page WHEN 1 THEN 'income_statement' ELSE 'balance_sheet' END AS statement_type, round(1 - (col_index - 1) * 0.1 - page * 0.01, 4)::DOUBLE AS confidence FROM cells"""


@query(
    "w03_dedupe_facts",
    f"""SELECT report, normalized_name, year, statement_type, value, unit, page, col_index, confidence FROM (SELECT *, row_number() OVER (PARTITION BY report, normalized_name, year, statement_type
        ORDER BY confidence DESC, page, table_no, row_index, col_index) AS rn FROM ({RAW_SQL})) WHERE rn = 1""",
    uses=("cells",),
)
def _(spark, d):
    return W.dedupe_facts(raw_facts(spark, d)).select(
        "report", "normalized_name", "year", "statement_type", "value", "unit", "page", "col_index", "confidence"
    )


@query(
    "w04_build_statements",
    """SELECT 'company_' || company_id AS report, 'income_statement' AS statement_type, year, 'KMAD' AS unit, 0.99::DOUBLE AS confidence, 1 AS source_page,
         CAST(CAST(revenue AS DECIMAL(20,2)) AS DOUBLE) AS revenue, CAST(CAST(gross_profit AS DECIMAL(20,2)) AS DOUBLE) AS gross_profit,
         -CAST(CAST(income_tax AS DECIMAL(20,2)) AS DOUBLE) AS income_tax, CAST(CAST(net_income AS DECIMAL(20,2)) AS DOUBLE) AS net_income,
         NULL::DOUBLE AS total_assets, NULL::DOUBLE AS total_liabilities, NULL::DOUBLE AS equity FROM wide
       UNION ALL SELECT 'company_' || company_id, 'balance_sheet', year, 'MMAD', 0.98::DOUBLE, 2, NULL, NULL, NULL, NULL,
         CAST(CAST(total_assets AS DECIMAL(20,2)) AS DOUBLE), CAST(CAST(total_liabilities AS DECIMAL(20,2)) AS DOUBLE), CAST(CAST(equity AS DECIMAL(20,2)) AS DOUBLE) FROM wide""",
    uses=("wide",),
)
def _(spark, d):
    st = W.build_statements(W.dedupe_facts(raw_facts(spark, d)))
    return st.select(
        "report", "statement_type", "year", "unit", F.round("confidence", 4).alias("confidence"), "source_page", *I.WIDE_METRICS
    )


def jobs(spark, d):
    reports = I.reports(spark, d)
    facts = I.stored_facts(spark, d).join(
        reports.filter(F.col("extraction_status") != "pending").select("report_id"), "report_id", "left_semi"
    )
    errors = reports.filter(F.col("extraction_status") == "failed").select("report_id")
    ocr = reports.select("report_id", (F.col("extraction_quality") < 0.05).alias("needs_ocr"))
    return W.extraction_jobs(reports, facts, errors, ocr, key="report_id")


JOBS_SQL = """SELECT r.report_id, CASE WHEN extraction_quality < 0.05 THEN 0 ELSE coalesce(n, 0) END AS n_metrics, CAST(extraction_status = 'failed' AS BIGINT) AS n_errors,
   CASE WHEN extraction_quality < 0.05 THEN 'ocr_required' WHEN n IS NULL AND extraction_status = 'failed' THEN 'failed' WHEN n IS NULL OR extraction_status = 'failed' THEN 'partial' ELSE 'completed' END AS extraction_status,
   CASE WHEN extraction_quality < 0.05 OR n IS NULL THEN 0.0 ELSE round(a * 0.6 + least(1.0, k / 10) * 0.4, 4) END AS extraction_quality
   FROM reports r LEFT JOIN (SELECT report_id, count(*) AS n, CAST(avg(CAST(round(confidence * 10) AS INTEGER)) / 10 AS DOUBLE) AS a, count(DISTINCT normalized_metric_name) AS k
     FROM facts JOIN reports USING (report_id) WHERE extraction_status <> 'pending' GROUP BY 1) f ON f.report_id = r.report_id"""


@query("w05_extraction_jobs", JOBS_SQL, uses=("facts", "reports"))
def _(spark, d):
    return jobs(spark, d)


def _fact_rows(spark, d):
    return I.stored_facts(spark, d).select(
        "report_id", F.col("normalized_name").alias("normalized_metric_name"), "year", "statement_type",
        F.col("value").cast("string").alias("raw_value"), F.col("value").cast("double").alias("value"), "unit", "confidence",
        F.lit(None).cast("string").alias("validation_warning"), F.lit("stored").alias("metric_name"),
    )


def _fact_merge(spark, d):
    old = _fact_rows(spark, d).filter(F.col("confidence") < 0.7)
    new = (
        _fact_rows(spark, d)
        .withColumn("confidence", F.round(1 - F.col("confidence"), 1))
        .withColumn("value", F.col("value") * 2)
        .withColumn("metric_name", F.lit("fresh"))
    )
    return old, new


@query(
    "w06_upsert_facts",
    """SELECT report_id, normalized_metric_name, year,
         CASE WHEN confidence < 0.7 AND round(1 - confidence, 1) <= confidence THEN CAST(value AS DOUBLE) ELSE 2 * CAST(value AS DOUBLE) END AS value,
         CASE WHEN confidence < 0.7 AND round(1 - confidence, 1) <= confidence THEN confidence ELSE round(1 - confidence, 1) END AS confidence,
         CASE WHEN confidence < 0.7 THEN 'stored' ELSE 'fresh' END AS metric_name FROM facts""",
    uses=("facts",),
)
def _(spark, d):
    old, new = _fact_merge(spark, d)
    return W.upsert_facts(old, new).select("report_id", "normalized_metric_name", "year", "value", "confidence", "metric_name")


@query("w06_upsert_stored_facts", ORACLES["w06_upsert_facts"])
def _(spark, d):
    """The same merge into a stored table; then once more, which changes nothing."""
    old, new = _fact_merge(spark, d)
    table = W.fact_table(spark, scratch_path(spark, "facts"), old)
    table.create(old)
    for _ in range(2):
        W.upsert_stored_facts(table, new)
    return table.read().select("report_id", "normalized_metric_name", "year", "value", "confidence", "metric_name")


@query(
    "w07_insert_absent_statements",
    """SELECT company_id, report_id, year, CASE WHEN extraction_status = 'completed' THEN 'old' ELSE 'new' END AS origin FROM reports""",
    uses=("reports",),
)
def _(spark, d):
    reports = I.reports(spark, d)
    old = reports.filter(F.col("extraction_status") == "completed").select("company_id", "report_id", "year", F.lit("old").alias("origin"))
    new = reports.select("company_id", "report_id", "year", F.lit("new").alias("origin"))
    return W.insert_absent(old, new, ["company_id", "report_id", "year"])


@query(
    "w08_backfill_reports",
    f"""SELECT r.report_id, coalesce(j.extraction_status, r.extraction_status) AS extraction_status, coalesce(j.extraction_quality, r.extraction_quality) AS extraction_quality,
         CASE WHEN r.company_id % 3 = 0 THEN 'h_old' WHEN r.company_id % 3 = 1 THEN 'h_new' END AS file_hash, CASE WHEN r.company_id % 2 = 0 THEN 10 ELSE 20 END AS page_count
        FROM reports r LEFT JOIN ({JOBS_SQL}) j ON j.report_id = r.report_id""",
    uses=("facts", "reports"),
)
def _(spark, d):
    c = F.col("company_id")
    reports = I.reports(spark, d).withColumn("file_hash", F.when(c % 3 == 0, "h_old")).withColumn("page_count", F.when(c % 2 == 0, 10))
    company = F.floor(F.col("report_id") / 10000)
    results = jobs(spark, d).withColumn("file_hash", F.when(company % 3 == 2, "").otherwise("h_new")).withColumn("page_count", F.lit(20))
    return W.backfill_reports(reports, results).drop("company_id", "year")


RATIO_SQL = """SELECT company_id, company_id * 10000 + year AS report_id, year, 'ROE' AS ratio_name, round(CAST(net_income AS DOUBLE) / CAST(equity AS DOUBLE), 6) AS value, 'net_income / equity' AS formula FROM wide
   UNION ALL SELECT company_id, company_id * 10000 + year, year, 'ROA', round(CAST(net_income AS DOUBLE) / CAST(total_assets AS DOUBLE), 6), 'net_income / total_assets' FROM wide"""


def ratio_rows(spark, d):
    keys = ("company_id", "report_id", "year")
    return W.ratios(I.stored_statements(spark, d, "income_statement"), I.stored_statements(spark, d, "balance_sheet"), keys)


@query("w09_ratios", RATIO_SQL, uses=("wide",))
def _(spark, d):
    return doubles(ratio_rows(spark, d), "value").drop("source_type")


_BAL = "CAST(total_assets AS DOUBLE) AS a, CAST(total_liabilities AS DOUBLE) + CAST(equity AS DOUBLE) AS le"
BALANCE_SQL = f"""SELECT company_id, year, round(p, 6) AS discrepancy_pct, p <= 5 AS passed,
   CASE WHEN p > 5 THEN 'Balance equation violated: assets=' || format('{{:,.0f}}', a) || ', liabilities+equity=' || format('{{:,.0f}}', le) || ', discrepancy=' || format('{{:.1f}}', p) || '%' ELSE '' END AS warnings
   FROM (SELECT *, abs(a - le) / abs(a) * 100 AS p FROM (SELECT company_id, year, {_BAL} FROM wide))"""


@query("w10_balance_check", BALANCE_SQL, uses=("wide",))
def _(spark, d):
    bs = I.stored_statements(spark, d, "balance_sheet")
    return bs.select(
        "company_id", "year", F.round("balance_discrepancy_pct", 6).alias("discrepancy_pct"),
        F.col("balance_check_passed").alias("passed"), F.array_join("warnings", "; ").alias("warnings"),
    )


# The margin is taken from equity over revenue, which has values on both sides of the limits.
_INC = "CAST(income_tax AS DOUBLE) AS r, CAST(net_income AS DOUBLE) AS n, CASE WHEN company_id % 2 = 0 THEN -CAST(equity AS DOUBLE) ELSE CAST(equity AS DOUBLE) END AS g"
INCOME_SQL = f"""SELECT company_id, year, warnings = '' AS passed, warnings FROM (SELECT company_id, year, array_to_string(list_filter([
    CASE WHEN abs(n) > abs(r) * 2 THEN 'net_income (' || format('{{:,.0f}}', n) || ') is unusually large vs revenue (' || format('{{:,.0f}}', r) || ')' END,
    CASE WHEN g / r > 1.05 THEN 'gross_margin=' || format('{{:.1f}}', g / r * 100) || '% > 100% — check unit consistency' END,
    CASE WHEN g / r < -0.5 THEN 'gross_margin=' || format('{{:.1f}}', g / r * 100) || '% very negative — check sign' END], lambda x: x IS NOT NULL), '; ') AS warnings
   FROM (SELECT company_id, year, {_INC} FROM wide))"""


@query("w11_income_check", INCOME_SQL, uses=("wide",))
def _(spark, d):
    from ..functions.checks import income_check

    gross = F.when(F.col("company_id") % 2 == 0, -F.col("equity")).otherwise(F.col("equity"))
    check = income_check(F.col("income_tax"), F.col("net_income"), gross)
    return I.wide_statements(spark, d).select(
        "company_id", "year", check["passed"].alias("passed"), F.array_join(check["warnings"], "; ").alias("warnings")
    )


@query(
    "w12_work_list",
    "SELECT report_id, year, extraction_status FROM reports WHERE extraction_status IN ('pending','partial','failed')",
    uses=("reports",),
)
def _(spark, d):
    return W.work_list(I.reports(spark, d), I.companies(spark, d)).select("report_id", "year", "extraction_status")


@query(
    "w13_run_stats",
    f"""SELECT count(*) FILTER (WHERE extraction_status IN ('completed','partial')) AS n_ok, count(*) FILTER (WHERE extraction_status = 'ocr_required') AS n_ocr,
        count(*) FILTER (WHERE extraction_status = 'failed') AS n_failed FROM ({JOBS_SQL})""",
    uses=("facts", "reports"),
)
def _(spark, d):
    return W.run_stats(jobs(spark, d))


@query("w13_written_stats", ORACLES["w13_run_stats"])
def _(spark, d):
    return W.write_jobs(scratch_path(spark, "jobs"), jobs(spark, d))


@query(
    "w14_error_rows",
    """SELECT report_id, 'r' || report_id || '.pdf' AS pdf_filename, 'FileNotFound' AS error_type, 'no file for report ' || report_id AS error_message
       FROM reports WHERE extraction_status IN ('failed', 'pending')""",
    uses=("reports",),
)
def _(spark, d):
    reports = I.reports(spark, d).select(
        "report_id", F.concat(F.lit("r"), F.col("report_id").cast("string"), F.lit(".pdf")).alias("pdf_filename"),
        F.when(F.col("extraction_status").isin("failed", "pending"), "").otherwise("/files").alias("pdf_path"),
    )
    return W.error_rows(reports)


# ---- relational questions ------------------------------------------------------------

_FACT_JOIN = "FROM facts f JOIN companies c ON c.company_id = f.company_id"
FC = ("facts", "companies")


@query(
    "q01_get_metric",
    f"""SELECT name AS company, year, normalized_metric_name AS metric, CAST(value AS DOUBLE) AS value, unit, currency, confidence, validation_warning {_FACT_JOIN}
        WHERE normalized_name = '{COMPANY}' AND normalized_metric_name = 'net_income' ORDER BY year DESC LIMIT 10""",
    uses=FC,
)
def _(spark, d):
    return doubles(Q.get_metric(I.metric_facts(spark, d), I.companies(spark, d), COMPANY, "net_income"), "value")


@query(
    "q02_metric_over_years",
    f"""SELECT name AS company, year, normalized_metric_name AS metric, CAST(value AS DOUBLE) AS value, unit, currency, confidence {_FACT_JOIN}
        WHERE normalized_name = '{COMPANY}' AND normalized_metric_name = 'revenue' AND year BETWEEN 1996 AND 1999""",
    uses=FC,
)
def _(spark, d):
    return doubles(Q.metric_over_years(I.metric_facts(spark, d), I.companies(spark, d), COMPANY, "revenue", 1996, 1999), "value")


@query(
    "q03_metric_over_companies",
    f"""SELECT name AS company, sector, year, normalized_metric_name AS metric, CAST(value AS DOUBLE) AS value, unit, currency {_FACT_JOIN}
        WHERE normalized_metric_name = 'net_income' AND year = {YEAR} AND confidence >= 0.4""",
    uses=FC,
)
def _(spark, d):
    return doubles(Q.metric_over_companies(I.metric_facts(spark, d), I.companies(spark, d), "net_income", YEAR), "value")


_CONF = "round((SELECT avg(confidence) FROM facts f WHERE f.company_id = w.company_id AND f.year = w.year AND normalized_metric_name IN ({0})), 4)"
_INCOME_NAMES = "'revenue','gross_profit','income_tax','net_income'"


@query(
    "q04_income_statement",
    f"""SELECT name AS company, year, CAST(revenue AS DOUBLE) AS revenue, CAST(gross_profit AS DOUBLE) AS gross_profit, CAST(income_tax AS DOUBLE) AS income_tax,
        CAST(net_income AS DOUBLE) AS net_income, 'MAD' AS currency, 'KMAD' AS unit, {_CONF.format(_INCOME_NAMES)} AS confidence,
        {', '.join(f'CAST(NULL AS DOUBLE) AS {c}' for c in ('net_banking_income', 'operating_income', 'ebitda', 'finance_result', 'profit_before_tax', 'net_income_group_share'))}
        FROM wide w JOIN companies c USING (company_id) WHERE normalized_name = '{COMPANY}' AND year = {YEAR}""",
    uses=("wide", "facts", "companies"),
)
def _(spark, d):
    df = Q.income_statement(I.stored_statements(spark, d, "income_statement"), I.companies(spark, d), COMPANY, YEAR)
    return doubles(df, *Q.INCOME_COLUMNS[:10]).withColumn("confidence", F.round("confidence", 4))


@query(
    "q05_balance_sheet",
    f"""SELECT name AS company, year, CAST(total_assets AS DOUBLE) AS total_assets, CAST(total_liabilities AS DOUBLE) AS total_liabilities, CAST(equity AS DOUBLE) AS equity,
        'MAD' AS currency, 'KMAD' AS unit, passed AS balance_check_passed, discrepancy_pct AS balance_discrepancy_pct,
        {', '.join(f'CAST(NULL AS DOUBLE) AS {c}' for c in ('current_assets', 'non_current_assets', 'cash', 'receivables', 'inventory', 'current_liabilities', 'non_current_liabilities', 'debt'))}
        FROM wide w JOIN companies c USING (company_id) JOIN ({BALANCE_SQL}) b USING (company_id, year) WHERE normalized_name = '{COMPANY}' AND year = {YEAR}""",
    uses=("wide", "companies"),
)
def _(spark, d):
    df = Q.balance_sheet(I.stored_statements(spark, d, "balance_sheet"), I.companies(spark, d), COMPANY, YEAR)
    return doubles(df, *Q.BALANCE_COLUMNS[:11]).withColumn("balance_discrepancy_pct", F.round("balance_discrepancy_pct", 6))


@query(
    "q06_cash_flow",
    f"""SELECT name AS company, year, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in I.CASH_FLOW_SQL)}, 'MAD' AS currency, 'KMAD' AS unit
        FROM cash_flows JOIN companies USING (company_id) WHERE normalized_name = '{COMPANY}' AND year = {YEAR}""",
    uses=("cash_flows", "companies"),
)
def _(spark, d):
    df = Q.cash_flow(I.cash_flows(spark, d), I.companies(spark, d), COMPANY, YEAR)
    return doubles(df, *I.CASH_FLOW_SQL)


@query(
    "q07_financial_ratios",
    f"""SELECT name AS company, year, ratio_name, value, formula, 'calculated' AS source_type FROM ({RATIO_SQL}) JOIN companies USING (company_id)
        WHERE normalized_name = '{COMPANY}' AND year = {YEAR}""",
    uses=("wide", "companies"),
)
def _(spark, d):
    return doubles(Q.financial_ratios(ratio_rows(spark, d), I.companies(spark, d), COMPANY, YEAR), "value")


@query(
    "q08_shareholders",
    f"""SELECT name AS company, year, shareholder_name, ownership_percentage, shares FROM holders JOIN companies USING (company_id) WHERE normalized_name = '{COMPANY}'
        ORDER BY year DESC, ownership_percentage DESC NULLS LAST, shareholder_name LIMIT 50""",
    uses=("holders", "companies"),
)
def _(spark, d):
    df = Q.shareholders(I.shareholders(spark, d), I.companies(spark, d), COMPANY)
    return df.withColumn("shares", F.col("shares").cast("bigint"))


@query(
    "q09_list_companies",
    """SELECT normalized_name, name, ticker, sector, count(DISTINCT year) AS n_reports, min(year) AS year_first, max(year) AS year_last
       FROM companies c LEFT JOIN reports r ON r.company_id = c.company_id GROUP BY 1, 2, 3, 4""",
    uses=("reports", "companies"),
)
def _(spark, d):
    return Q.list_companies(I.companies(spark, d), I.reports(spark, d))


@query(
    "q10_available_years",
    "SELECT name, year, extraction_status, extraction_quality FROM reports JOIN companies USING (company_id)",
    uses=("reports", "companies"),
)
def _(spark, d):
    return Q.available_years(I.companies(spark, d), I.reports(spark, d), None)


@query(
    "q11_financials_bundle",
    f"""SELECT company_id, year, CAST(revenue AS DOUBLE) AS revenue, CAST(equity AS DOUBLE) AS equity, CAST(c.capex AS DOUBLE) AS capex, 2 AS n_ratios,
        round(CAST(net_income AS DOUBLE) / CAST(total_assets AS DOUBLE), 6) AS first_ratio,
        {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in ('gross_profit', 'income_tax', 'net_income', 'total_assets', 'total_liabilities'))},
        {', '.join(f'CAST(c.{c} AS DOUBLE) AS cash_{c}' for c in I.CASH_FLOW_SQL if c != 'capex')}, 'KMAD/MAD/KMAD/KMAD' AS units FROM wide JOIN cash_flows c USING (company_id, year)""",
    uses=("wide", "cash_flows"),
)
def _(spark, d):
    b = Q.financials_bundle(
        I.reports(spark, d), I.stored_statements(spark, d, "income_statement"), I.stored_statements(spark, d, "balance_sheet"),
        I.cash_flows(spark, d), ratio_rows(spark, d),
    )
    return b.select(
        "company_id", "year", F.col("income_statement.revenue").cast("double").alias("revenue"),
        F.col("balance_sheet.equity").cast("double").alias("equity"), F.col("cash_flow.capex").cast("double").alias("capex"),
        F.size("ratios").alias("n_ratios"), F.get("ratios", F.lit(0))["value"].cast("double").alias("first_ratio"),
        *[F.col(f"income_statement.{c}").cast("double").alias(c) for c in ("gross_profit", "income_tax", "net_income")],
        *[F.col(f"balance_sheet.{c}").cast("double").alias(c) for c in ("total_assets", "total_liabilities")],
        *[F.col(f"cash_flow.{c}").cast("double").alias(f"cash_{c}") for c in I.CASH_FLOW_SQL if c != "capex"],
        F.concat_ws("/", "income_statement.unit", "income_statement.currency", "balance_sheet.unit", "cash_flow.unit").alias("units"),
    )


@query(
    "q14_quality_report",
    """SELECT *, CASE WHEN row_number() OVER (PARTITION BY name ORDER BY year DESC, extraction_status DESC, extraction_quality DESC) = 1 THEN name ELSE '' END AS shown_name
       FROM (SELECT name, r.year, extraction_status, extraction_quality, count(f.value) AS n_metrics FROM companies c LEFT JOIN reports r ON r.company_id = c.company_id
       LEFT JOIN facts f ON f.report_id = r.report_id GROUP BY 1, 2, 3, 4)""",
    uses=("facts", "reports", "companies"),
)
def _(spark, d):
    return Q.quality_report(I.companies(spark, d), I.reports(spark, d), I.metric_facts(spark, d))


@query(
    "q15_totals",
    """SELECT (SELECT count(*) FROM companies) AS companies, (SELECT count(*) FROM reports) AS reports,
       (SELECT count(*) FROM reports WHERE extraction_status = 'completed') AS completed, (SELECT count(*) FROM facts) AS metrics,
       (SELECT round(coalesce(avg(extraction_quality), 0), 6) FROM reports WHERE extraction_status = 'completed') AS avg_quality""",
    uses=("facts", "reports", "companies"),
)
def _(spark, d):
    df = Q.totals(I.companies(spark, d), I.reports(spark, d), I.metric_facts(spark, d))
    return df.withColumn("avg_quality", F.round("avg_quality", 6))


@query(
    "q16_validation_sweep",
    f"""SELECT 'BS' AS statement, name AS company, year, warnings AS warning FROM ({BALANCE_SQL}) JOIN companies USING (company_id) WHERE NOT passed
        UNION ALL SELECT 'IS', name, year, 'net_income (' || format('{{:,.0f}}', CAST(net_income AS DOUBLE)) || ') is unusually large vs revenue (' || format('{{:,.0f}}', CAST(revenue AS DOUBLE)) || ')'
        FROM wide JOIN companies USING (company_id) WHERE abs(net_income) > 2 * abs(revenue)""",
    uses=("wide", "companies"),
)
def _(spark, d):
    return Q.validation_sweep(
        I.stored_statements(spark, d, "income_statement"), I.stored_statements(spark, d, "balance_sheet"), I.companies(spark, d)
    )


@query("q17_low_confidence_count", "SELECT count(*) FILTER (WHERE confidence < 0.4) AS low_confidence FROM facts", uses=("facts",))
def _(spark, d):
    return Q.low_confidence_count(I.metric_facts(spark, d))


@query(
    "q18_indexed_companies",
    """SELECT company_normalized, any_value(company) AS company, any_value(sector) AS sector, string_agg(year, ',' ORDER BY year DESC) AS years
       FROM stems WHERE indexed GROUP BY 1""",
    uses=("stems",),
)
def _(spark, d):
    df = Q.indexed_companies(I.report_stems(spark, d), I.registry(spark, d))
    return df.withColumn("years", F.array_join("years", ","))


@query(
    "q19_document_list",
    "SELECT stem, company, company_normalized, year, sector, document_url AS url FROM stems WHERE indexed AND document_url <> ''",
    uses=("stems",),
)
def _(spark, d):
    return Q.document_list(I.report_stems(spark, d), I.registry(spark, d))


@query(
    "q20_sector_counts",
    """SELECT sector, count(*) AS companies, count(*) FILTER (WHERE s_acctbal >= 5000) AS listed, count(*) FILTER (WHERE s_acctbal < 5000) AS unlisted
       FROM companies JOIN supplier ON s_suppkey = company_id GROUP BY 1""",
    uses=("companies",),
)
def _(spark, d):
    return Q.sector_counts(I.companies(spark, d), I.listed_companies(spark, d))


@query(
    "q20_companies_by_sector",
    "SELECT sector, name, normalized_name, count(*) OVER (PARTITION BY sector) AS sector_size FROM companies",
    uses=("companies",),
)
def _(spark, d):
    return Q.companies_by_sector(I.companies(spark, d))


@query(
    "q21_search_companies",
    """SELECT name, sector FROM companies JOIN supplier ON s_suppkey = company_id WHERE contains(lower(name), '#00000000') AND s_acctbal >= 5000""",
    uses=("companies",),
)
def _(spark, d):
    df = Q.search_companies(I.companies(spark, d), " #00000000 ", listed=I.listed_companies(spark, d), listing="listed")
    return df.select("name", "sector")


@query(
    "q21_search_tables",
    "SELECT DISTINCT report, page, 1 AS table_no FROM flat_rows WHERE page = 2 AND contains(lower(concat_ws(' ', col1, col2, col3)), '7 1')",
    uses=("flat_rows",),
)
def _(spark, d):
    return Q.search_tables(X.explode_tables(I.report_pages(spark, d)), "7 1", page=2).select("report", "page", "table_no")
