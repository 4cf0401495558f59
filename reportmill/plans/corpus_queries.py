"""Registered queries: sources and sinks (S), harvest (H), chunks and index (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import company_key, safe_folder, sector_key, squeeze, stem_slug
from ..operators import corpus as C
from ..operators import harvest as H
from ..session import materialise, scratch_path
from ..sources import files as S
from ..sources.bucketed import BucketTable
from . import inputs as I
from .catalog import ORACLES, cte, query

BASE = "https://www.example.com"
WS_SQL = "[\\s\\x0b\\x1c-\\x1f\\x85\\xa0]+"


def document_pages(spark, d):
    """Documents as pages: the source is the report, the document number its page."""
    return pages_of(I.spread_table(spark, d, "documents", "doc_id"))


def pages_of(docs):
    return docs.select(
        F.col("source").alias("report"), (F.col("doc_id") + 1).cast("int").alias("page"), "text", F.col("source").alias("source")
    )


cte(
    "doc_words",
    f"SELECT source AS report, CAST(doc_id + 1 AS INTEGER) AS page, list_filter(string_split_regex(text, '{WS_SQL}'), lambda w: w <> '') AS w FROM documents",
)
cte(
    "doc_chunks",
    """SELECT report, page, pos, row_number() OVER (PARTITION BY report ORDER BY page, pos) - 1 AS id, array_to_string(w[pos * 250 + 1:pos * 250 + 300], ' ') AS text
       FROM (SELECT report, page, w, unnest(range(CAST((greatest(len(w) - 51, 0) // 250) + 1 AS BIGINT))) AS pos FROM doc_words WHERE len(w) > 0)""",
    uses=("doc_words",),
)

# ---- chunks --------------------------------------------------------------------------


@query("c01_stem_slug", "SELECT page_id, coalesce(nullif(trim(regexp_replace(lower(regexp_replace(regexp_replace(rtrim(url, '/'), '^.*/', ''), '(.)\\.[^.]+$', '\\1')), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'rapport') AS stem FROM pages")
def _(spark, d):
    return I.table(spark, d, "pages").select("page_id", stem_slug(F.col("url")).alias("stem"))


@query("c02_squeeze", f"SELECT doc_id, trim(regexp_replace(text, '{WS_SQL}', ' ', 'g')) AS text FROM documents")
def _(spark, d):
    return I.table(spark, d, "documents").select("doc_id", squeeze(F.col("text")).alias("text"))


@query(
    "c03_real_tables",
    "SELECT 'company_' || company_id || '_' || year AS report, p AS page, CASE WHEN p = 1 THEN 6 ELSE 4 END AS n_rows FROM wide, (VALUES (1), (2)) v(p)",
    uses=("wide",),
)
def _(spark, d):
    short = F.array(F.array(F.array(F.lit("only"), F.lit("two")), F.array(F.lit("rows"), F.lit(" "))))
    pages = I.report_pages(spark, d).withColumn("tables", F.concat("tables", short))
    kept = pages.select("report", "page", F.explode(C.real_tables(F.col("tables"))).alias("t"))
    return kept.select("report", "page", F.size("t").alias("n_rows"))


_MONEY = "replace(replace(format('{{:,.2f}}', CAST({0} AS DECIMAL(20,2))), ',', ' '), '.', ',')"
@query("c06_chunk_words", "SELECT page AS doc_page, pos, text FROM doc_chunks", uses=("doc_chunks",))
def _(spark, d):
    docs = document_pages(spark, d)
    return docs.select(F.col("page").alias("doc_page"), F.posexplode(C.chunk_words(F.col("text"))).alias("pos", "text"))


@query("c07_number_chunks", "SELECT report || '::' || id AS chunk_id, report, page, id, text FROM doc_chunks", uses=("doc_chunks",))
def _(spark, d):
    df = C.chunk_pages(document_pages(spark, d))
    return df.select(F.concat_ws("::", "report", F.col("id").cast("string")).alias("chunk_id"), "report", "page", "id", "text")


_FLAT_ROWS = [("1", m, label) for m, label in I.INCOME_LINES] + [("2", m, label) for m, label in I.BALANCE_LINES]


def _flat_sql() -> str:
    parts = [
        "SELECT 'company_' || company_id || '_' || year AS report, 1 AS page, 0 AS ligne, 'Compte de résultat (en milliers de dirhams)' AS col1, CAST(year AS VARCHAR) AS col2, 'Exercice ' || (year - 1) AS col3 FROM wide",
        "SELECT 'company_' || company_id || '_' || year, 1, 5, 'Notes annexes', 'voir page 3', '' FROM wide",
        "SELECT 'company_' || company_id || '_' || year, 2, 0, 'Bilan consolidé', CAST(year AS VARCHAR), 'Exercice ' || (year - 1) FROM wide",
    ]
    for page, lines in ((1, I.INCOME_LINES), (2, I.BALANCE_LINES)):
        for i, (m, label) in enumerate(lines):
            text = label.replace("'", "''").replace("  ", " ")
            wrap = (lambda x: f"'(' || {x} || ')'") if m == "income_tax" else (lambda x: x)
            parts.append(
                f"SELECT 'company_' || w.company_id || '_' || w.year, {page}, {i + 1}, '{text}', {wrap(_MONEY.format('w.' + m))}, coalesce({wrap(_MONEY.format('p.' + m))}, '-')"
                f" FROM wide w LEFT JOIN wide p ON p.company_id = w.company_id AND p.year = w.year - 1"
            )
    return " UNION ALL ".join(parts)


cte("flat_rows", _flat_sql(), uses=("wide",))


BODY_SQL = """SELECT report, CAST(page AS INTEGER) AS page, CASE page WHEN 1 THEN 'Rapport annuel de ' ELSE 'Bilan, montants en millions de dirhams, ' END || regexp_replace(report, '_[0-9]+$', '') || chr(10) || chr(10)
   || 'Tableau p.' || page || ' n°1 :' || chr(10) || string_agg(col1 || ' | ' || col2 || CASE WHEN col3 = '' THEN '' ELSE ' | ' || col3 END, chr(10) ORDER BY ligne) AS body
   FROM flat_rows GROUP BY report, page"""


def _bodies(spark, d):
    pages = I.report_pages(spark, d)
    return pages.select("report", "page", C.page_body(F.col("text"), C.real_tables(F.col("tables")), F.col("page")).alias("body"))


@query("c04_table_text", f"SELECT report, page, substr(body, strpos(body, 'Tableau')) AS table_text FROM ({BODY_SQL})", uses=("flat_rows",))
def _(spark, d):
    pages = I.report_pages(spark, d)
    tables = pages.select("report", "page", F.posexplode(C.real_tables(F.col("tables"))).alias("i", "t"))
    return tables.select("report", "page", C.table_text(F.col("t"), F.col("page"), F.col("i") + 1).alias("table_text"))


@query("c05_page_body", BODY_SQL, uses=("flat_rows",))
def _(spark, d):
    return _bodies(spark, d)


@query("c08_flat_table_rows", f"SELECT report, page, 1 AS tableau, ligne, col1, col2, col3, {', '.join(f"'' AS col{i}" for i in range(4, 13))} FROM flat_rows", uses=("flat_rows",))
def _(spark, d):
    return C.flat_table_rows(I.report_pages(spark, d)).select("report", "page", "tableau", "ligne", *[f"col{i}" for i in range(1, 13)])


def _doc_meta(spark, d):
    """Metadata of half of the sources."""
    docs = I.table(spark, d, "documents").filter(F.col("source").cast("string").rlike("[02468]$"))
    langs = docs.groupBy("source").agg(F.min("lang").alias("sector"))
    return langs.select(
        F.col("source").alias("stem"), F.upper("source").alias("company"), F.col("source").alias("company_normalized"),
        F.lit("2020").alias("year"), "sector", F.concat(F.lit("https://files.example.com/"), "source").alias("document_url"),
    )


cte("doc_meta", "SELECT source AS stem, upper(source) AS company, '2020' AS year, min(lang) AS sector FROM documents WHERE regexp_matches(source, '[02468]$') GROUP BY source")


@query(
    "c09_attach_metadata",
    """SELECT c.report || '::' || id AS chunk_id, page, coalesce(company, report) AS company, report AS company_normalized, coalesce(year, '') AS year, coalesce(sector, '') AS sector, length(text) AS n
       FROM doc_chunks c LEFT JOIN doc_meta m ON m.stem = c.report""",
    uses=("doc_chunks", "doc_meta"),
)
def _(spark, d):
    df = C.attach_metadata(C.chunk_pages(document_pages(spark, d)), _doc_meta(spark, d))
    return df.select("chunk_id", "page", "company", "company_normalized", "year", "sector", F.length("text").alias("n"))


def _tree_and_loose(spark, d):
    stems = I.report_stems(spark, d)
    tree = stems.filter(F.col("extraction_status") != "failed").select("stem", F.concat(F.lit("/tree/"), "stem", F.lit(".pdf")).alias("path"))
    loose = stems.select(F.concat(F.lit("/loose/"), F.upper("stem"), F.lit(".PDF")).alias("path"))
    return tree, loose


@query(
    "c10_report_sources",
    "SELECT normalized_name || '_' || year AS stem, CASE WHEN extraction_status <> 'failed' THEN '/tree/' || normalized_name || '_' || year || '.pdf' ELSE '/loose/' || upper(normalized_name || '_' || year) || '.PDF' END AS path FROM reports JOIN companies USING (company_id)",
    uses=("reports", "companies"),
)
def _(spark, d):
    return C.report_sources(*_tree_and_loose(spark, d)).select("stem", "path")


@query(
    "c11_pending_sources",
    "SELECT normalized_name || '_' || year AS stem FROM reports JOIN companies USING (company_id) WHERE extraction_status NOT IN ('completed', 'partial') AND NOT (extraction_status = 'failed' AND year % 2 = 0)",
    uses=("reports", "companies"),
)
def _(spark, d):
    stems = I.report_stems(spark, d).withColumn("mtime", F.col("year").cast("bigint"))
    failed = stems.filter(F.col("extraction_status") == "failed").select("stem", (F.col("mtime") - F.col("mtime") % 2).alias("mtime"))
    return C.pending_sources(stems, I.registry(spark, d), failed).select("stem")


@query(
    "c12_upsert_chunks",
    "SELECT report || '::' || id AS chunk_id, CASE WHEN page % 3 = 0 THEN 'new: ' || text ELSE text END AS text FROM doc_chunks WHERE page % 2 = 0 OR page % 3 = 0",
    uses=("doc_chunks",),
)
def _(spark, d):
    chunks = C.chunk_pages(document_pages(spark, d)).select(
        F.concat_ws("::", "report", F.col("id").cast("string")).alias("chunk_id"), "page", "text"
    )
    return C.upsert_by_key(*_chunk_versions(chunks), ["chunk_id"])


def _chunk_versions(chunks):
    old = chunks.filter(F.col("page") % 2 == 0).drop("page")
    new = chunks.filter(F.col("page") % 3 == 0).select("chunk_id", F.concat(F.lit("new: "), "text").alias("text"))
    return old, new


@query("c12_upsert_stored_chunks", ORACLES["c12_upsert_chunks"])
def _(spark, d):
    chunks = C.chunk_pages(document_pages(spark, d)).select(
        F.concat_ws("::", "report", F.col("id").cast("string")).alias("chunk_id"), "page", "text"
    )
    # The upsert reads the new rows several times.
    old, new = _chunk_versions(materialise(chunks, "numbered-chunks"))
    table = BucketTable(spark, scratch_path(spark, "chunks"), old.schema, ["chunk_id"])
    table.create(old)
    table.replace(new)
    return table.read()


STATS_SQL = """SELECT report AS stem, CAST(max(page) AS INTEGER) AS pages, 0 AS csv_rows, count(*) AS chunks FROM doc_chunks GROUP BY 1
   UNION ALL SELECT report, 0, count(*), 0 FROM flat_rows GROUP BY 1"""


def _stats(spark, d):
    return C.report_stats(C.chunk_pages(document_pages(spark, d)), C.flat_table_rows(I.report_pages(spark, d)))


@query("c13_report_stats", STATS_SQL, uses=("doc_chunks", "flat_rows"))
def _(spark, d):
    return _stats(spark, d)


@query(
    "c13_registry_upsert",
    f"SELECT stem, CASE WHEN chunks > 0 THEN chunks ELSE -1 END AS chunks FROM ({STATS_SQL})",
    uses=("doc_chunks", "flat_rows"),
)
def _(spark, d):
    stats = _stats(spark, d).select("stem", "chunks")
    return C.upsert_by_key(stats.withColumn("chunks", F.lit(-1).cast("bigint")), stats.filter("chunks > 0"), ["stem"])


@query(
    "c14_registry_totals",
    f"SELECT count(*) AS reports, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(chunks) AS BIGINT) AS chunks, CAST(sum(csv_rows) AS BIGINT) AS csv_rows FROM ({STATS_SQL})",
    uses=("doc_chunks", "flat_rows"),
)
def _(spark, d):
    return C.registry_totals(_stats(spark, d))


def _broken_pages(spark, d):
    pages = document_pages(spark, d)
    key = F.concat("report", F.lit("_"), (F.col("page") % 10).cast("string"))
    text = F.when((F.col("page") % 97 == 0), None).otherwise(F.col("text"))
    number = F.when(F.col("page") % 89 == 0, "x").otherwise(F.col("page").cast("string"))
    return pages.select(key.alias("report"), number.alias("page"), text.alias("text"))


@query(
    "c15_dead_letters",
    """SELECT source || '_' || (doc_id + 1) % 10 AS report, min(CASE WHEN (doc_id + 1) % 97 = 0 THEN 'no text' ELSE 'bad page number' END) AS error, count(*) AS bad_pages
       FROM documents WHERE (doc_id + 1) % 97 = 0 OR (doc_id + 1) % 89 = 0 GROUP BY 1""",
)
def _(spark, d):
    return C.split_failures(_broken_pages(spark, d))[1]


@query(
    "c15_readable_pages",
    """SELECT source || '_' || (doc_id + 1) % 10 AS report, CAST(doc_id + 1 AS VARCHAR) AS page FROM documents WHERE source || '_' || (doc_id + 1) % 10 NOT IN
       (SELECT source || '_' || (doc_id + 1) % 10 FROM documents WHERE (doc_id + 1) % 97 = 0 OR (doc_id + 1) % 89 = 0)""",
)
def _(spark, d):
    return C.split_failures(_broken_pages(spark, d))[0].select("report", "page")


@query(
    "c16_needs_ocr",
    """WITH sizes AS (SELECT conv_id, turn + 1 AS page, length(regexp_replace(text, '[ \\n]', '', 'g')) AS chars FROM conversations),
       steps AS (SELECT conv_id, greatest(1, count(*) // 5) AS step FROM sizes GROUP BY 1)
       SELECT 'c' || conv_id AS report, coalesce(avg(chars) < 150, true) AS needs_ocr FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN
        (SELECT * FROM sizes JOIN steps USING (conv_id) WHERE (page - 1) % step = 0 AND (page - 1) // step < 5) USING (conv_id) GROUP BY 1""",
)
def _(spark, d):
    talk = I.table(spark, d, "conversations")
    name = F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("report")
    # Turns are short pages, so the limit is set where both answers occur.
    pages = talk.select(name, (F.col("turn") + 1).alias("page"), "text")
    return C.needs_ocr(talk.select(name).distinct(), pages, min_chars=150).select("report", "needs_ocr")


# ---- harvest -------------------------------------------------------------------------


def listing_pages(spark, d):
    """Listing pages of twenty suppliers each, built from the supplier table."""
    rows = I.companies(spark, d).select(
        F.floor(F.col("company_id") / 20).alias("page"),
        F.struct(
            "company_id",
            F.format_string(
                '<tr class="row"><td></td><td class="n"><a href="/fr/espace-emetteurs/liste-des-emetteurs/%s"> <b>%s</b></a></td><td>%s</td><td>01/02/2020</td></tr>',
                F.col("company_id").cast("string"), F.col("name"), F.col("sector"),
            ).alias("html"),
        ).alias("row"),
    )
    # At most twenty rows meet in one page by construction.
    pages = rows.groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list("row")), lambda r: r["html"]), "\n").alias("rows"))
    links = F.format_string('<a href="?page=%s">suivant</a><a title="Aller à la dernière page" href="/fr/liste?a=1&amp;page=%s">»</a>', (F.col("page") + 1).cast("string"), (F.col("page") + 7).cast("string"))
    explicit = F.when(F.col("page") % 2 == 0, links).otherwise(F.format_string('<a href="/l?page=%s">x</a><a href="/l?page=3">y</a>', (F.col("page") + 4).cast("string")))
    again = F.lit('<p><a href="/fr/espace-emetteurs/liste-des-emetteurs/1">again</a></p>')
    return pages.select(
        F.concat(F.lit(BASE + "/liste?page="), F.col("page").cast("string")).alias("url"),
        F.concat(F.lit("<html><table>"), "rows", F.lit("</table>"), F.when(F.col("page") == 0, again).otherwise(F.lit("")), explicit, F.lit("</html>")).alias("html"),
    )


@query(
    "h01_emitters",
    f"""SELECT '{BASE}/liste?page=' || company_id // 20 AS page_url, CAST(company_id AS VARCHAR) AS company_id, name AS company_name, lower(name) AS company_name_normalized, sector, lower(sector) AS sector_normalized,
        '{BASE}/fr/espace-emetteurs/liste-des-emetteurs/' || company_id AS url FROM companies""",
    uses=("companies",),
)
def _(spark, d):
    return H.emitters(listing_pages(spark, d), BASE)


@query(
    "h02_last_page",
    f"SELECT DISTINCT '{BASE}/liste?page=' || p AS url, CAST(CASE WHEN p % 2 = 0 THEN p + 7 ELSE greatest(p + 4, 3) END AS INTEGER) AS last_page FROM (SELECT company_id // 20 AS p FROM companies)",
    uses=("companies",),
)
def _(spark, d):
    return H.last_page(listing_pages(spark, d))


@query(
    "h03_filter_emitters",
    "SELECT CAST(company_id AS VARCHAR) AS company_id, name AS company_name, sector FROM companies WHERE contains(lower(sector), 'ion_1') AND contains(lower(name), 'plier#')",
    uses=("companies",),
)
def _(spark, d):
    df = H.filter_emitters(H.emitters(listing_pages(spark, d), BASE), "ION_1", "Plier#")
    return df.select("company_id", "company_name", "sector")


def company_pages(spark, d):
    """One page per supplier listing its yearly documents in four ways (by year)."""
    r = I.reports(spark, d)
    y = (F.col("year") + 20).cast("string")
    c = F.col("company_id").cast("string")
    path = "/fr/espace-emetteurs/etats-financiers/"
    item = (
        F.when(F.col("year") % 4 == 0, F.format_string(f'<li><a href="{path}s%s-rfa-%s">Document</a></li>', c, y))
        .when(F.col("year") % 4 == 1, F.format_string(f'<li><a class="x" href="{BASE}{path}s%s-d-%s">Rapport financier annuel %s</a></li>', c, F.col("year").cast("string"), y))
        .when(F.col("year") % 4 == 2, F.format_string(f'<li>Exercice %s : <a href="{path}s%s-a%s">Rapport  annuel</a></li>', y, c, F.col("year").cast("string")))
        .otherwise(F.format_string(f'<li><a href="{path}s%s-rfs-%s">1er semestre</a></li>', c, y))
    )
    # A supplier has one item per year, so a page stays small.
    pages = r.groupBy("company_id").agg(F.sort_array(F.collect_list(F.struct("year", item.alias("html")))).alias("items"))
    html = F.concat(F.lit("<ul>"), F.array_join(F.transform("items", lambda i: i["html"]), ""), F.lit(f'<li><a href="{path}sans-date">Rapport annuel</a></li></ul>'))
    names = I.companies(spark, d).select("company_id", F.col("name").alias("company_name"), "sector")
    return pages.join(names, "company_id").select(F.col("company_id").cast("string").alias("company_id"), "company_name", "sector", html.alias("html"))


_P = "/fr/espace-emetteurs/etats-financiers/"
DOCS_SQL = f"""SELECT company_id || '_' || (year + 20) AS report_id, CAST(company_id AS VARCHAR) AS company_id, CAST(year + 20 AS INTEGER) AS year,
   CASE WHEN year % 4 = 3 THEN 'Rapports 1er semestre' ELSE 'Rapports annuels' END AS document_type,
   CASE year % 4 WHEN 0 THEN 'Document' WHEN 1 THEN 'Rapport financier annuel ' || (year + 20) WHEN 2 THEN 'Rapport  annuel' ELSE '1er semestre' END AS title,
   '{BASE}{_P}s' || company_id || CASE year % 4 WHEN 0 THEN '-rfa-' || (year + 20) WHEN 1 THEN '-d-' || year WHEN 2 THEN '-a' || year ELSE '-rfs-' || (year + 20) END AS source_url FROM reports WHERE year + 20 BETWEEN 2010 AND 2029"""


@query("h04_document_links", DOCS_SQL, uses=("reports",))
def _(spark, d):
    return H.document_links(company_pages(spark, d), BASE).select("report_id", "company_id", "year", "document_type", "title", "source_url")


@query(
    "h04_page_links",
    """WITH l AS (SELECT url, unnest(h) AS href, unnest(range(len(h))) AS i FROM (SELECT url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS h FROM pages)),
       f AS (SELECT url, CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^(https?://[^/]+)', 1) || href ELSE href END AS target, min(i) AS i FROM l WHERE href <> '' GROUP BY 1, 2)
       SELECT url, target, CAST(row_number() OVER (PARTITION BY url ORDER BY i) - 1 AS INTEGER) AS pos FROM f""",
)
def _(spark, d):
    host = F.regexp_extract("url", "^(https?://[^/]+)", 1)
    return H.page_links(I.table(spark, d, "pages"), host).select("url", "target", "pos")


@query(
    "h05_document_type",
    """SELECT doc_id, CASE WHEN NOT regexp_matches(t, 'semestriel|semestre|-rfs-|\\brfs\\b|communiqu|rapport\\s+esg|rapport\\s+de\\s+gestion') AND regexp_matches(t, 'rapports?\\s+annuels?|rapport\\s+financier\\s+annuel|annual\\s+report|-rfa-|\\brfa\\b') THEN 'Rapports annuels'
         WHEN contains(t, '-rfs-') OR contains(t, 'semestr') THEN 'Rapports 1er semestre' ELSE 'Autre' END AS document_type
       FROM (SELECT doc_id, lower(CASE doc_id % 4 WHEN 0 THEN 'x-rfa-2020 ' WHEN 1 THEN 'x-rfs-2020 ' WHEN 2 THEN 'rapport annuel semestriel ' ELSE 'doc ' END || text) AS t FROM documents)""",
)
def _(spark, d):
    href = F.get(F.array(*[F.lit(x) for x in ("x-rfa-2020", "x-rfs-2020", "rapport annuel semestriel", "doc")]), (F.col("doc_id") % 4).cast("int"))
    return I.table(spark, d, "documents").select("doc_id", H.document_type(href, F.col("text")).alias("document_type"))


@query("h06_document_year", "SELECT page_id, CAST(nullif(regexp_extract(html, '\\b(20[12]\\d)\\b', 1), '') AS INTEGER) AS year FROM pages")
def _(spark, d):
    return I.table(spark, d, "pages").select("page_id", H.document_year(F.col("html")).alias("year"))


@query(
    "h07_company_key",
    """SELECT c_custkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower('Été ' || c_name || '-Groupe S.A. ' || c_mktsegment || ' sa'), '[-_.]', ' ', 'g'), 'é', 'e', 'g'), '\\b(sa|groupe)\\b', '', 'g'), '\\s+', ' ', 'g')) AS k FROM customer""",
)
def _(spark, d):
    text = F.concat(F.lit("Été "), "c_name", F.lit("-Groupe S.A. "), "c_mktsegment", F.lit(" sa"))
    return I.table(spark, d, "customer").select("c_custkey", company_key(text).alias("k"))


@query(
    "h08_safe_names",
    """SELECT c_custkey, 'ETE_' || upper(replace(c_name, '#', '')) || '_' || c_mktsegment AS folder, c_custkey || '_2020' AS report_id,
        CASE WHEN c_custkey % 3 = 0 THEN 'c' || c_custkey END AS slug, lower(c_mktsegment) AS sector_key FROM customer""",
)
def _(spark, d):
    c = F.col("c_custkey").cast("string")
    folder = F.concat(F.lit(" Été! "), "c_name", F.lit("  "), "c_mktsegment")
    tail = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("c"), c)).when(F.col("c_custkey") % 3 == 1, F.lit("etats-financiers")).otherwise(c)
    return I.table(spark, d, "customer").select(
        "c_custkey", safe_folder(folder).alias("folder"), H.report_key(F.col("c_custkey"), F.lit(2020)).alias("report_id"),
        H.company_slug(F.concat(F.lit("/fr/espace-emetteurs/"), tail)).alias("slug"), sector_key(F.col("c_mktsegment")).alias("sector_key"),
    )


LATEST_SQL = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY year DESC) AS rn FROM ({DOCS_SQL}) WHERE document_type = 'Rapports annuels') WHERE rn <= 3"


def _documents(spark, d):
    return H.document_links(company_pages(spark, d), BASE)


@query("h09_latest_reports", f"SELECT company_id, year, source_url FROM ({LATEST_SQL})", uses=("reports",))
def _(spark, d):
    return H.latest_reports(_documents(spark, d), keep=3).select("company_id", "year", "source_url")


def manifest(spark, d):
    """A full manifest: one row per report and sometimes an older one before it."""
    stems = I.report_stems(spark, d).join(
        I.reports(spark, d).join(I.companies(spark, d), "company_id").select(
            F.concat_ws("_", "normalized_name", F.col("year").cast("string")).alias("stem"), "report_id", "company_id"
        ),
        "stem",
    )
    status = F.get(F.array(*[F.lit(s) for s in ("downloaded", "skipped", "failed", "invalid_pdf", "pending")]), (F.col("report_id") % 5).cast("int"))
    path = F.when(F.col("company_id") % 2 == 0, F.concat(F.lit("C:\\data\\"), "sector", F.lit("\\"), F.upper("company"), F.lit("\\"), "year", F.lit("\\annual_report.pdf"))).otherwise(F.lit(""))
    known = {
        "report_id": F.col("report_id").cast("string"), "company_id": F.col("company_id").cast("string"), "company_name": F.concat(F.lit(" "), "company", F.lit(" ")),
        "company_name_normalized": F.col("company_normalized"), "sector": F.col("sector"), "year": F.col("year"), "document_type": F.lit("Rapports annuels"),
        "source_url": F.concat(F.lit(BASE + "/"), "stem"), "document_url": F.col("document_url"), "local_path": path, "download_status": status,
        "file_size": (F.col("company_id") + 2000).cast("string"), "title": F.concat(F.lit('Titre "'), "company", F.lit('", annuel')),
    }
    return stems.select(*[known.get(c, F.lit("")).alias(c) for c in S.MANIFEST_COLUMNS])


cte(
    "manifest",
    f"""SELECT company_id * 10000 + year AS report_id, company_id, name AS company_name, normalized_name, sector, CAST(year AS VARCHAR) AS year,
        list_extract(['downloaded','skipped','failed','invalid_pdf','pending'], CAST((company_id * 10000 + year) % 5 AS INTEGER) + 1) AS download_status,
        normalized_name || '_' || year AS stem, CASE WHEN (company_id + year) % 7 = 0 THEN '' ELSE 'https://files.example.com/' || normalized_name || '_' || year || '.pdf' END AS document_url
       FROM reports JOIN companies USING (company_id)""",
    uses=("reports", "companies"),
)


@query(
    "h10_upsert_manifest",
    "SELECT CAST(report_id AS VARCHAR) AS report_id, CASE WHEN company_id % 3 = 0 THEN 'downloaded' ELSE download_status END AS download_status FROM manifest WHERE company_id % 2 = 0 OR company_id % 3 = 0",
    uses=("manifest",),
)
def _(spark, d):
    return H.upsert_manifest(*_manifest_versions(manifest(spark, d))).select("report_id", "download_status")


def _manifest_versions(full):
    number = F.col("company_id").cast("int")
    return full.filter(number % 2 == 0), full.filter(number % 3 == 0).withColumn("download_status", F.lit("downloaded"))


@query("h10_upsert_stored_manifest", ORACLES["h10_upsert_manifest"])
def _(spark, d):
    old, new = _manifest_versions(manifest(spark, d))
    table = BucketTable(spark, scratch_path(spark, "manifest"), old.schema, ["report_id"])
    table.create(old)
    table.replace(new)
    return table.read().select("report_id", "download_status")


@query(
    "h11_still_to_do",
    "SELECT CAST(report_id AS VARCHAR) AS report_id FROM manifest WHERE NOT (download_status IN ('downloaded', 'skipped') AND company_id % 2 = 0 AND company_id % 4 <> 0)",
    uses=("manifest",),
)
def _(spark, d):
    full = manifest(spark, d)
    files = full.filter(F.col("local_path") != "").select(
        F.col("local_path").alias("path"), F.when(F.col("company_id").cast("int") % 4 == 0, "File too small: 3 bytes").alias("problem")
    )
    return H.still_to_do(full.select("report_id"), full, files)


@query(
    "h12_manifest_counts",
    "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE download_status = '{s}') AS {s}" for s in H.STATUSES) + " FROM manifest",
    uses=("manifest",),
)
def _(spark, d):
    return H.manifest_counts(manifest(spark, d))


@query(
    "h13_file_checks",
    """SELECT 'f' || doc_id AS path, CAST(octet_length(encode(t)) AS BIGINT) AS file_size, sha256(t) AS sha256,
        CASE WHEN octet_length(encode(t)) < 1024 THEN 'File too small: ' || octet_length(encode(t)) || ' bytes' WHEN NOT starts_with(t, '%PDF') THEN 'Invalid PDF magic bytes' END AS problem
       FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '%PDF-1.7' ELSE '<html>' END || text AS t FROM documents)""",
)
def _(spark, d):
    head = F.when(F.col("doc_id") % 2 == 0, "%PDF-1.7").otherwise("<html>")
    files = I.table(spark, d, "documents").select(
        F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.encode(F.concat(head, "text"), "UTF-8").alias("content")
    )
    return H.file_checks(files)


@query(
    "h14_first_document",
    f"""SELECT url, CASE page_id % 4 WHEN 0 THEN '{BASE}/d/' || page_id || '.PDF' WHEN 1 THEN '{BASE}/sites/default/files/r' || page_id WHEN 2 THEN '{BASE}/get?id=' || page_id END AS document_url FROM pages""",
)
def _(spark, d):
    i, p = F.col("page_id").cast("string"), F.col("page_id") % 4
    extra = (
        F.when(p == 0, F.concat(F.lit('<a href="/d/'), i, F.lit('.PDF">pdf</a><a href="/d/other.pdf">b</a>')))
        .when(p == 1, F.concat(F.lit(f'<a href="{BASE}/sites/default/files/r'), i, F.lit('">file</a>')))
        .when(p == 2, F.concat(F.lit('<span>Pièce jointe :</span><a href="/get?id='), i, F.lit('">ici</a>')))
        .otherwise("")
    )
    return H.first_document(I.table(spark, d, "pages").withColumn("html", F.concat("html", extra)), BASE)


@query(
    "h15_run_summary",
    f"""SELECT (SELECT count(*) FROM companies) AS companies_found, (SELECT count(*) FROM ({DOCS_SQL}) WHERE document_type = 'Rapports annuels') AS reports_found, (SELECT count(*) FROM ({LATEST_SQL})) AS reports_selected,
        count(*) FILTER (WHERE download_status = 'downloaded') AS downloaded, count(*) FILTER (WHERE download_status = 'skipped') AS already_existing, count(*) FILTER (WHERE download_status IN ('failed', 'invalid_pdf')) AS failed FROM manifest""",
    uses=("reports", "companies", "manifest"),
)
def _(spark, d):
    docs = _documents(spark, d)
    return H.run_summary(H.emitters(listing_pages(spark, d), BASE), docs, H.latest_reports(docs, keep=3), manifest(spark, d))


@query("h15_written_run", ORACLES["h15_run_summary"])
def _(spark, d):
    docs = _documents(spark, d)
    return H.write_run(scratch_path(spark, "run"), H.emitters(listing_pages(spark, d), BASE), docs, H.latest_reports(docs, keep=3), manifest(spark, d))


# ---- sources and sinks ---------------------------------------------------------------


@query(
    "s01_stem_metadata",
    f"""SELECT stem, company_name AS company, normalized_name AS company_normalized, year, sector, CAST(report_id AS VARCHAR) AS report_id, '{BASE}/' || stem AS source_url, document_url
        FROM manifest WHERE download_status IN ('downloaded', 'skipped')""",
    uses=("manifest",),
)
def _(spark, d):
    path = scratch_path(spark, "manifest")
    S.write_csv(manifest(spark, d), path)
    return S.stem_metadata(S.read_manifest(spark, path))


@query(
    "s02_report_tree",
    """SELECT stem, CASE WHEN indexed THEN company ELSE upper(company) END AS company, company_normalized, year, CASE WHEN indexed THEN sector ELSE 'S ' || sector END AS sector
       FROM stems""",
    uses=("stems",),
)
def _(spark, d):
    stems = I.report_stems(spark, d)
    files = stems.select(F.concat_ws("/", F.lit("file:/root/re(ports)+[1]"), F.concat(F.lit("S "), "sector"), F.upper("company"), "year", F.lit("annual_report.pdf")).alias("path"))
    odd = stems.select(F.concat_ws("/", F.lit("file:/root/re(ports)+[1]"), "year", F.lit("x.pdf")).alias("path"))
    meta = stems.join(I.registry(spark, d), "stem", "left_semi").withColumns({"report_id": F.lit("r"), "source_url": F.lit("u")})
    return S.report_tree(files.unionByName(odd), "/root/re(ports)+[1]", meta).select("stem", "company", "company_normalized", "year", "sector")


@query("s03_read_companies", "SELECT name, CASE WHEN company_id % 4 <> 0 THEN sector END AS sector, CAST(company_id AS VARCHAR) AS external_id FROM companies", uses=("companies",))
def _(spark, d):
    known = {"company_name": F.concat(F.lit(" "), "name"), "sector": F.when(F.col("company_id") % 4 == 0, " ").otherwise(F.col("sector")), "company_id": F.col("company_id").cast("string")}
    path = scratch_path(spark, "companies")
    S.write_csv(I.companies(spark, d).select(*[known.get(c, F.lit("")).alias(c) for c in S.COMPANY_COLUMNS]), path)
    return S.read_companies(spark, path).select("name", "sector", "external_id")


@query(
    "s04_read_chunks",
    """SELECT report, id, text, coalesce(company, '') AS company, report AS company_normalized, coalesce(year, '') AS year, coalesce(sector, '') AS sector,
        CASE WHEN company IS NULL THEN '' ELSE 'https://files.example.com/' || report END AS url FROM doc_chunks LEFT JOIN doc_meta ON stem = report""",
    uses=("doc_chunks", "doc_meta"),
)
def _(spark, d):
    path = scratch_path(spark, "chunks")
    S.write_chunks(C.chunk_pages(document_pages(spark, d)), path)
    df = C.with_defaults(S.read_chunks(spark, path), _doc_meta(spark, d))
    return df.select("report", "id", "text", "company", "company_normalized", "year", "sector", "url")


@query(
    "s05_regroup_tables",
    """SELECT report, page, 1 AS "table", string_agg(col1 || '|' || col2 || CASE WHEN col3 = '' THEN '' ELSE '|' || col3 END, chr(10) ORDER BY ligne) FILTER (WHERE rn <= 4) AS rows
       FROM (SELECT *, row_number() OVER (PARTITION BY report, page ORDER BY ligne) AS rn FROM flat_rows) GROUP BY 1, 2""",
    uses=("flat_rows",),
)
def _(spark, d):
    path = scratch_path(spark, "flat")
    S.write_flat_tables(C.flat_table_rows(I.report_pages(spark, d)), path)
    tables = C.regroup_tables(S.read_flat_tables(spark, path), max_rows=4)
    return tables.withColumn("rows", F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n"))


@query("s06_browse_chunks", "SELECT report, page, id, text FROM doc_chunks WHERE report = 'src7' ORDER BY report, id LIMIT 500", uses=("doc_chunks",))
def _(spark, d):
    return C.browse_chunks(C.chunk_pages(document_pages(spark, d)), "src7")


@query("s07_read_event_log", "SELECT event_type, count(*) AS n, count(ip_hash) AS hashed, count(company) AS companies FROM ev GROUP BY 1", uses=("ev",))
def _(spark, d):
    path = scratch_path(spark, "events-json")
    log = I.event_log(spark, d)
    line = F.to_json(F.struct(*log.columns))
    # Every record is followed by lines that are no record.
    lines = log.select(F.explode(F.array(line, F.lit('{"seq": "broken'), F.lit("[1, 2]"), F.lit("{}"))).alias("value"))
    lines.write.text(path)
    return S.read_event_log(spark, path).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("ip_hash").alias("hashed"), F.count("meta.company").alias("companies")
    )


@query("s08_append_events", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, 2 * count(*) AS n FROM ev WHERE event_type <> 'logout' GROUP BY 1, 2", uses=("ev",))
def _(spark, d):
    path = scratch_path(spark, "events")
    log = I.event_log(spark, d).withColumn("event_type", F.when(F.col("event_type") == "logout", "unheard_of").otherwise(F.col("event_type")))
    S.append_events(log, path)
    S.append_events(log, path)
    return spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("s09_flat_table_csv", "SELECT report, page, 1 AS tableau, ligne, col1, col2, nullif(col3, '') AS col3 FROM flat_rows", uses=("flat_rows",))
def _(spark, d):
    path = scratch_path(spark, "flat")
    S.write_flat_tables(C.flat_table_rows(I.report_pages(spark, d)), path)
    return S.read_flat_tables(spark, path).select("report", "page", "tableau", "ligne", "col1", "col2", "col3")


@query("s10_chunk_json", "SELECT report, page, id, text FROM doc_chunks", uses=("doc_chunks",))
def _(spark, d):
    path = scratch_path(spark, "chunks")
    chunks = C.chunk_pages(document_pages(spark, d))
    S.write_chunks(chunks, path)
    S.write_chunks(chunks.filter(F.col("report") == "src3"), path)
    return S.read_chunks(spark, path).select("report", "page", "id", "text")


@query(
    "s11_manifest_csv",
    """SELECT CAST(report_id AS VARCHAR) AS report_id, 'Titre "' || company_name || '", annuel' AS title, CAST(year AS INTEGER) AS year, CAST(company_id + 2000 AS BIGINT) AS file_size FROM manifest""",
    uses=("manifest",),
)
def _(spark, d):
    path = scratch_path(spark, "manifest")
    S.write_csv(manifest(spark, d), path)
    return S.typed_manifest(S.read_manifest(spark, path)).select("report_id", "title", "year", "file_size")


@query(
    "s12_registry_and_errors",
    """SELECT 'registry' AS kind, report AS stem, CAST(max(page) AS BIGINT) AS n FROM doc_chunks GROUP BY report UNION ALL
       SELECT 'errors', source || '_' || (doc_id + 1) % 10, count(*) FROM documents WHERE (doc_id + 1) % 97 = 0 OR (doc_id + 1) % 89 = 0 GROUP BY 2""",
    uses=("doc_chunks",),
)
def _(spark, d):
    path = scratch_path(spark, "registry")
    chunks = C.chunk_pages(document_pages(spark, d))
    registry = chunks.groupBy("report").agg(F.max("page").alias("pages")).withColumnRenamed("report", "stem")
    S.write_registry(registry, C.split_failures(_broken_pages(spark, d))[1], path)
    ok = spark.read.schema("stem STRING, pages BIGINT").json(f"{path}/registry").select(F.lit("registry").alias("kind"), "stem", F.col("pages").alias("n"))
    bad = spark.read.schema("report STRING, error STRING, bad_pages BIGINT").json(f"{path}/errors")
    return ok.unionByName(bad.select(F.lit("errors").alias("kind"), F.col("report").alias("stem"), F.col("bad_pages").alias("n")))
