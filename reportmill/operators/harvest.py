"""Report links from stored HTML, and the download manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.html import absolute, anchors, attribute, blocks, cells, links, table_rows, text_of
from ..functions.text import company_key, let, sector_key
from ..session import beside, write_counted
from ..sources.files import DONE_STATUSES, MANIFEST_COLUMNS
from .warehouse import best_row

# Link and document patterns.
EMITTER_LINK = r"/liste-des-emetteurs/(\d+)"
DOCUMENT_LINK = r"(?i)/etats-financiers/"
ANNUAL_PATTERNS = (
    r"rapport\s+annuel", r"rapports\s+annuels", r"rapport\s+financier\s+annuel", r"annual\s+report", r"-rfa-", r"\brfa\b",
)
EXCLUDED_PATTERNS = (
    r"semestriel", r"semestre", r"1er\s+semestre", r"premier\s+semestre", r"-rfs-", r"\brfs\b", r"communiqu",
    r"rapport\s+esg", r"rapport\s+de\s+gestion", r"états\s+financiers\s+semestriels",
)
SEMESTER_MARK = "-rfs-"
DOCUMENT_TYPES = ("Rapports annuels", "Rapports 1er semestre", "Autre")
YEAR = r"\b(20[12]\d)\b"
NOT_COMPANIES = ("liste-des-emetteurs", "etats-financiers", "communiques-presse-emetteurs", "documents-information")
MIN_FILE_SIZE = 1024
PDF_MAGIC = "25504446"
STATUSES = ("downloaded", "skipped", "failed", "invalid_pdf", "pending")
MAX_YEARS = 5


def document_year(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, YEAR, 1), F.lit("")).cast("int")


def document_type(href: Column, text: Column) -> Column:
    """Excluded words win over annual words; a semester mark comes next."""
    def kind(t):
        any_of = lambda patterns: F.regexp_like(t, F.lit("(?U)" + "|".join(patterns)))
        half = F.contains(F.lower(href), F.lit(SEMESTER_MARK)) | F.contains(t, F.lit("semestr"))
        annual, semester, other = DOCUMENT_TYPES
        return (
            F.when(~any_of(EXCLUDED_PATTERNS) & any_of(ANNUAL_PATTERNS), annual).when(half, semester).otherwise(other)
        )

    return let(F.lower(F.concat(href, F.lit(" "), text)), kind)


def report_key(company: Column, year: Column) -> Column:
    return F.concat_ws("_", company.cast("string"), year.cast("string"))


def company_slug(url: Column) -> Column:
    part = F.regexp_extract(url, r"(?s)^.*/espace-emetteurs/([^/]+)$", 1)
    return F.when((part != "") & ~part.isin(*NOT_COMPANIES) & ~F.regexp_like(part, F.lit(r"^\d+$")), part)


def _first_of_key(items: Column, key: str) -> Column:
    """Items whose key did not occur earlier in the array."""
    keys = F.transform(items, lambda x: x[key])
    return let(
        F.struct(items.alias("items"), keys.alias("keys")),
        lambda s: F.filter(s["items"], lambda x, i: F.array_position(s["keys"], x[key]) == i + 1),
    )


def emitters(pages: DataFrame, base_url: str, once: bool = False) -> DataFrame:
    """Listing pages (url, html) to emitters: id, name, sector; first per id within a page.

    `once=True` also keeps one row per id over all pages.
    """

    def sector(row_cells, name, row):
        usable = lambda i: F.when(
            (F.size(row_cells) > i) & (F.get(row_cells, F.lit(i)) != "") & (F.get(row_cells, F.lit(i)) != name), F.get(row_cells, F.lit(i))
        )
        em = text_of(F.regexp_extract(row, r"(?is)<em\b[^>]*>.*?</em>", 0))
        return F.coalesce(usable(2), usable(1), em)

    def in_row(row):
        return let(
            cells(row),
            lambda row_cells: F.transform(
                links(row),
                lambda a: F.struct(
                    F.regexp_extract(a["href"], EMITTER_LINK, 1).alias("company_id"),
                    a["text"].alias("company_name"), sector(row_cells, a["text"], row).alias("sector"), a["href"].alias("href"),
                ),
            ),
        )

    outside = F.transform(
        links(F.regexp_replace("html", r"(?is)<tr\b[^>]*>.*?</tr>", " ")),
        lambda a: F.struct(
            F.regexp_extract(a["href"], EMITTER_LINK, 1).alias("company_id"),
            a["text"].alias("company_name"), F.lit("").alias("sector"), a["href"].alias("href"),
        ),
    )
    items = F.filter(
        F.concat(F.flatten(F.transform(table_rows(F.col("html")), in_row)), outside), lambda x: x["company_id"] != ""
    )
    df = pages.select("url", F.explode(_first_of_key(items, "company_id")).alias("e")).filter(F.col("e.company_name") != "")
    df = df.select(
        F.col("url").alias("page_url"), "e.company_id", "e.company_name",
        company_key(F.col("e.company_name")).alias("company_name_normalized"),
        "e.sector", sector_key(F.col("e.sector")).alias("sector_normalized"),
        F.concat(F.lit(base_url), F.col("e.href")).alias("url"),
    )
    return best_row(df, ["company_id"], F.col("page_url")) if once else df


def last_page(pages: DataFrame) -> DataFrame:
    """(url, last_page): the page of the "last" link, else the highest page number, else 0."""
    number = lambda href: F.nullif(F.regexp_extract(href, r"[?&]page=(\d+)", 1), F.lit("")).cast("int")
    found = links(F.col("html"))
    explicit = F.get(F.filter(found, lambda a: F.regexp_like(a["title"], F.lit("(?i)derni.re|last"))), F.lit(0))
    highest = F.array_max(F.transform(found, lambda a: number(a["href"])))
    return pages.select("url", F.coalesce(number(explicit["href"]), highest, F.lit(0)).alias("last_page"))


def filter_emitters(df: DataFrame, sector: str | None = None, company: str | None = None) -> DataFrame:
    if sector:
        df = df.filter(F.contains(F.lower("sector"), F.lit(sector.lower())))
    if company:
        df = df.filter(F.contains(F.lower("company_name"), F.lit(company.lower())))
    return df


def page_links(pages: DataFrame, base: Column) -> DataFrame:
    """Every link of every page once per target, with its place in the page."""
    items = F.transform(
        links(F.col("html")),
        lambda a: F.struct(absolute(a["href"], base).alias("target"), a["text"].alias("text")),
    )
    found = _first_of_key(F.filter(items, lambda x: x["target"] != ""), "target")
    return pages.select("url", F.posexplode(found).alias("pos", "l")).select("url", "pos", "l.target", "l.text")


def document_links(pages: DataFrame, base_url: str) -> DataFrame:
    """Company pages (company_id, company_name, sector, html) to dated document links.

    One link per absolute URL; the year comes from the address, the link text or the text
    around the link; links without a year are left out.
    """
    base = F.lit(base_url)

    def in_block(block):
        return F.transform(
            F.filter(links(block), lambda a: F.regexp_like(a["href"], F.lit(DOCUMENT_LINK))),
            lambda a: F.struct(
                absolute(a["href"], base).alias("source_url"), a["href"].alias("href"), a["text"].alias("text"),
                F.coalesce(document_year(a["href"]), document_year(a["text"]), document_year(text_of(block))).alias("year"),
            ),
        )

    with_link = F.filter(blocks(F.col("html")), lambda b: F.regexp_like(b, F.lit("(?i)<a\\b")))
    dated = F.filter(
        _first_of_key(F.flatten(F.transform(with_link, in_block)), "source_url"), lambda d: d["year"].isNotNull()
    )
    # Pages without any such link may still name annual documents in other addresses.
    loose = F.filter(
        F.transform(
            F.filter(links(F.col("html")), lambda a: F.contains(F.lower(a["href"]), F.lit("etats-financiers"))),
            lambda a: F.struct(
                absolute(a["href"], base).alias("source_url"), a["href"].alias("href"), a["text"].alias("text"),
                F.coalesce(document_year(a["href"]), document_year(a["text"])).alias("year"),
            ),
        ),
        lambda d: d["year"].isNotNull() & (document_type(d["href"], d["text"]) == DOCUMENT_TYPES[0]),
    )
    items = let(dated, lambda found: F.when(F.size(found) > 0, found).otherwise(loose))
    df = pages.select("company_id", "company_name", "sector", F.posexplode(items).alias("pos", "d"))
    title = F.concat(F.col("company_name"), F.lit(" - "), F.col("d.year").cast("string"))
    return df.select(
        report_key(F.col("company_id"), F.col("d.year")).alias("report_id"),
        "company_id", "company_name", "sector", "pos", F.col("d.year").alias("year"),
        document_type(F.col("d.href"), F.col("d.text")).alias("document_type"),
        F.coalesce(F.nullif("d.text", F.lit("")), title).alias("title"),
        "d.source_url",
    )


def latest_reports(documents: DataFrame, year: int | None = None, keep: int = MAX_YEARS) -> DataFrame:
    """Annual reports: the first per (company, year), then the newest years of a company.

    The first step folds by aggregation; the second is a ranked filter that Spark cuts in
    every partition before the shuffle.
    """
    annual = documents.filter(F.col("document_type") == DOCUMENT_TYPES[0])
    if year is not None:
        annual = annual.filter(F.col("year") == year)
    one = best_row(annual, ["company_id", "year"], -F.col("pos"))
    newest = Window.partitionBy("company_id").orderBy(F.desc("year"))
    return one.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= keep).drop("_rn")


def first_document(pages: DataFrame, base_url: str) -> DataFrame:
    """(url, document_url): a .pdf link, else one in the files folder, else the link after an attachment caption."""
    found = links(F.col("html"))
    first = lambda pattern: F.get(F.filter(found, lambda a: F.regexp_like(a["href"], F.lit(pattern))), F.lit(0))["href"]
    after = F.regexp_extract("html", r"(?is)(?:pi.ce\s+jointe|attachment|fichier)[^<>]*<.*", 0)
    captioned = attribute(F.get(anchors(after), F.lit(0)), "href")
    href = F.coalesce(first(r"(?i)\.pdf$"), first(r"(?i)/sites/default/files/"), F.nullif(captioned, F.lit("")))
    return pages.select("url", absolute(href, F.lit(base_url)).alias("document_url"))


def upsert_manifest(old: DataFrame, new: DataFrame, strict: bool = False) -> DataFrame:
    """Batch upsert by report_id: known ids are replaced. `strict` keeps one new row per id (the last)."""
    if strict:
        new = best_row(new, ["report_id"], F.col("row_no"))
    return old.join(new.select("report_id").distinct(), "report_id", "left_anti").unionByName(new).select(*old.columns)


def file_checks(files: DataFrame) -> DataFrame:
    """(path, length, content) to size, hash and problem; content is read once per file."""
    size = F.length("content")
    magic = F.hex(F.substring("content", 1, 4))
    return files.select(
        "path",
        size.cast("bigint").alias("file_size"),
        F.sha2("content", 256).alias("sha256"),
        F.when(size < MIN_FILE_SIZE, F.concat(F.lit("File too small: "), size.cast("string"), F.lit(" bytes")))
        .when(magic != PDF_MAGIC, F.lit("Invalid PDF magic bytes"))
        .alias("problem"),
    )


def still_to_do(reports: DataFrame, manifest: DataFrame, checked: DataFrame) -> DataFrame:
    """Reports without a finished manifest row whose file is there and valid."""
    valid = checked.filter(F.col("problem").isNull()).select(F.col("path").alias("local_path"))
    done = manifest.filter(F.col("download_status").isin(*DONE_STATUSES)).join(valid, "local_path", "left_semi")
    return reports.join(done.select("report_id"), "report_id", "left_anti")


def manifest_counts(manifest: DataFrame) -> DataFrame:
    return manifest.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("download_status") == s).alias(s) for s in STATUSES],
    )


def _run_counts() -> dict[str, dict[str, Column]]:
    """Per output of a run what its summary counts."""
    status = F.col("download_status")
    return {
        "companies": {"companies_found": F.count(F.lit(1))},
        "documents": {"reports_found": F.count_if(F.col("document_type") == DOCUMENT_TYPES[0])},
        "selected": {"reports_selected": F.count(F.lit(1))},
        "manifest": {
            "downloaded": F.count_if(status == "downloaded"), "already_existing": F.count_if(status == "skipped"),
            "failed": F.count_if(status.isin("failed", "invalid_pdf")),
        },
    }


def run_summary(emitter_rows: DataFrame, documents: DataFrame, selected: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: companies found, reports found / selected, downloads by outcome."""
    outputs = (emitter_rows, documents, selected, manifest)
    return beside(*[df.agg(*[c.alias(n) for n, c in counts.items()]) for df, counts in zip(outputs, _run_counts().values(), strict=True)])


def write_run(folder: str, emitter_rows: DataFrame, documents: DataFrame, selected: DataFrame, manifest: DataFrame) -> DataFrame:
    """Write the four outputs of a run; its summary is observed while they are written, so nothing is read again."""
    told: dict[str, int] = {}
    for df, (name, counts) in zip((emitter_rows, documents, selected, manifest), _run_counts().items(), strict=True):
        told |= write_counted(df, f"{folder}/{name}", **counts)
    return manifest.sparkSession.createDataFrame([tuple(told.values())], ", ".join(f"{n} bigint" for n in told))
