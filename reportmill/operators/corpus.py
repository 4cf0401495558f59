"""Page text and tables to numbered chunks, and the incremental index bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS_CHARS, let, squeeze, stem_slug
from ..session import materialise, stored_small

CHUNK_WORDS, CHUNK_OVERLAP = 300, 50
TABLE_COLUMNS = 12
OCR_SAMPLE, OCR_MIN_CHARS = 5, 50
# Pages per numbering bucket: bounds the rows any one window group can hold.
PAGE_BUCKET = 4096


def clean_rows(rows: Column) -> Column:
    empty = F.array().cast("array<string>")
    return F.transform(F.coalesce(rows, F.array().cast("array<array<string>>")), lambda r: F.transform(F.coalesce(r, empty), squeeze))


def is_real_table(rows: Column) -> Column:
    """At least three rows with a non-empty cell (cells already squeezed)."""
    return F.size(F.filter(rows, lambda r: F.exists(r, lambda c: c != ""))) >= 3


def real_tables(tables: Column) -> Column:
    cleaned = F.transform(F.coalesce(tables, F.array().cast("array<array<array<string>>>")), clean_rows)
    return F.filter(cleaned, is_real_table)


def table_text(rows: Column, page: Column, number: Column) -> Column:
    lines = F.transform(rows, lambda r: F.array_join(F.filter(r, lambda c: c != ""), " | "))
    caption = F.concat(F.lit("Tableau p."), page.cast("string"), F.lit(" n°"), number.cast("string"), F.lit(" :\n"))
    return F.concat(caption, F.array_join(lines, "\n"))


def page_body(text: Column, tables: Column, page: Column) -> Column:
    """Page text followed by its (real) tables in order."""
    parts = F.transform(tables, lambda t, i: F.concat(F.lit("\n\n"), table_text(t, page, i + 1)))
    return F.concat(F.coalesce(text, F.lit("")), F.array_join(parts, ""))


def words_of(text: Column) -> Column:
    """The runs without white space: every white space becomes a blank first, as a split by one fixed character is fast."""
    return F.array_remove(F.split(F.translate(text, WS_CHARS, " " * len(WS_CHARS)), " "), "")


def window_count(n_words: Column, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> Column:
    step = max(size - overlap, 1)
    return F.when(n_words > 0, F.floor(F.greatest(n_words - overlap - 1, F.lit(0)) / step) + 1).otherwise(0).cast("int")


def chunk_words(text: Column, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Windows of `size` words that share `overlap` words; ends with the window reaching the end."""
    step = max(size - overlap, 1)

    def windows(words):
        last = F.greatest(F.size(words) - overlap - 1, F.lit(0))
        pieces = F.transform(
            F.sequence(F.lit(0), last, F.lit(step)), lambda i: F.array_join(F.slice(words, i + 1, size), " ")
        )
        return F.when(F.size(words) > 0, pieces).otherwise(F.array().cast("array<string>"))

    return let(words_of(text), windows)


def page_offsets(counts: DataFrame) -> DataFrame:
    """(report, page, n) to the number of chunks on earlier pages of the report; other columns stay.

    A two-level running sum: pages are summed per bucket of pages, buckets are summed per
    report, so a report with a large share of all pages is still many small groups.
    """
    bucketed = counts.withColumn("_b", F.floor(F.col("page") / PAGE_BUCKET))
    earlier = Window.partitionBy("report", "_b").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    inside = bucketed.withColumn("_in", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    # `counts` is read for the sums of the pages and for those of the buckets.
    before = Window.partitionBy("report").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        inside.groupBy("report", "_b")
        .agg(F.max(F.col("_in") + F.col("n")).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    rest = [c for c in counts.columns if c not in ("report", "page", "n")]
    return inside.join(starts, ["report", "_b"]).select("report", "page", *rest, (F.col("_start") + F.col("_in")).alias("offset"))


def chunk_pages(pages: DataFrame, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Pages (report, page, text[, tables, source]) to chunks (id, report, page, text, source).

    `id` counts over the pages of a report from 0. Rows that repeat a (report, page) are parts
    of that page in the order of their text. Text is shuffled once, by (report, page), and cut
    into words twice: for the counts, which are stored, and for the chunks.
    """
    df = pages
    if "tables" in pages.columns:
        df = df.withColumn("text", page_body(F.col("text"), real_tables(F.col("tables")), F.col("page")))
    source = F.col("source") if "source" in pages.columns else F.col("report")
    df = df.select("report", F.col("page").cast("int").alias("page"), source.alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    n = let(F.size(words_of(F.col("text"))), lambda words: window_count(words, size, overlap))
    counts = materialise(df.groupBy("report", "page").agg(F.sum(n).alias("n"), F.count(F.lit(1)).alias("rows")), "page-chunks")
    # The texts are not sorted for the join; only the parts of a page are counted once more.
    placed = df.join(page_offsets(counts).hint("shuffle_hash"), ["report", "page"])
    part = Window.partitionBy("report", "page").orderBy("text", "source").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("part", F.coalesce(F.sum(F.when(F.col("rows") > 1, n)).over(part), F.lit(0)))
    return numbered.select(
        "report", "page", "source", (F.col("offset") + F.col("part")).alias("offset"), F.posexplode(chunk_words(F.col("text"), size, overlap)).alias("pos", "text")
    ).select((F.col("offset") + F.col("pos")).alias("id"), "page", "report", "text", "source")


def flat_table_rows(pages: DataFrame, width: int = TABLE_COLUMNS) -> DataFrame:
    """Rows of the real tables: page, tableau, ligne and the first non-empty cells, padded."""
    tables = pages.select("report", "page", F.posexplode(real_tables(F.col("tables"))).alias("t", "rows"))
    rows = tables.select("report", "page", (F.col("t") + 1).alias("tableau"), F.posexplode("rows").alias("ligne", "cells"))
    cells = F.slice(F.concat(F.filter("cells", lambda c: c != ""), F.array_repeat(F.lit(""), width)), 1, width)
    return rows.select(
        "report", "page", "tableau", "ligne", cells.alias("cells")
    ).select("report", "page", "tableau", "ligne", *[F.get("cells", F.lit(i)).alias(f"col{i + 1}") for i in range(width)])


def regroup_tables(flat: DataFrame, max_rows: int = 60, width: int = TABLE_COLUMNS) -> DataFrame:
    """Flat rows back to tables: empty cells and rows dropped, the first rows of each table.

    The row limit is applied by rank (cut per partition first), then at most that many rows
    per table are collected.
    """
    cells = F.filter(
        F.transform(F.array(*[F.col(f"col{i + 1}") for i in range(width)]), lambda c: F.trim(F.coalesce(c, F.lit("")))), lambda c: c != ""
    )
    rows = flat.select("report", "page", "tableau", "ligne", cells.alias("cells")).filter(F.size("cells") > 0)
    first = Window.partitionBy("report", "page", "tableau").orderBy("ligne")
    return (
        rows.withColumn("_rn", F.row_number().over(first))
        .filter(F.col("_rn") <= max_rows)
        .groupBy("report", "page", "tableau")
        .agg(F.sort_array(F.collect_list(F.struct("ligne", "cells"))).alias("_rows"))
        .select("report", "page", F.col("tableau").alias("table"), F.transform("_rows", lambda r: r["cells"]).alias("rows"))
        .orderBy("report", "page", "table")
    )


def browse_chunks(chunks: DataFrame, report: str | None = None, limit: int = 500) -> DataFrame:
    df = chunks if report is None else chunks.filter(F.col("report") == report)
    return df.orderBy("report", "id").limit(limit).select("report", "page", "id", "text")


def attach_metadata(chunks: DataFrame, meta: DataFrame) -> DataFrame:
    """Index rows: chunk id `stem::n` and report metadata, the stem where it is unknown."""
    m = meta.select(F.col("stem").alias("report"), *[F.col(c).alias(f"m_{c}") for c in ("company", "company_normalized", "year", "sector")])
    return chunks.join(m, "report", "left").select(
        F.concat(F.col("report"), F.lit("::"), F.col("id").cast("string")).alias("chunk_id"),
        "report", "page", "id", "source", "text",
        F.coalesce("m_company", "report").alias("company"),
        F.coalesce("m_company_normalized", "report").alias("company_normalized"),
        F.coalesce("m_year", F.lit("")).alias("year"),
        F.coalesce("m_sector", F.lit("")).alias("sector"),
    )


def with_defaults(chunks: DataFrame, meta: DataFrame) -> DataFrame:
    """Fill a chunk's own report, company, year, sector, url only where they are missing."""
    names = {"company": "company", "company_normalized": "company_normalized", "year": "year", "sector": "sector", "url": "document_url"}
    m = meta.select("stem", *[F.col(src).alias(f"m_{n}") for n, src in names.items()])
    df = chunks.withColumn("report", F.coalesce("report", "stem")).join(m, "stem", "left")
    last = {n: F.lit("") for n in names} | {"company_normalized": F.col("stem")}
    keep = [c for c in chunks.columns if c not in names]
    return df.select(*keep, *[F.coalesce(*( [F.col(n)] if n in chunks.columns else [] ), F.col(f"m_{n}"), last[n]).alias(n) for n in names])


def report_sources(tree: DataFrame, loose: DataFrame) -> DataFrame:
    """Reports of the tree plus loose files whose stem the tree does not have."""
    extra = loose.withColumn("stem", stem_slug(F.col("path"))).join(tree.select("stem"), "stem", "left_anti")
    return tree.unionByName(extra, allowMissingColumns=True)


def pending_sources(sources: DataFrame, registry: DataFrame, failed: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Sources not indexed yet and not failed before at the same modification time."""
    df = sources if force else sources.join(registry.select("stem"), "stem", "left_anti")
    if failed is not None and not force:
        df = df.join(failed.select("stem", "mtime"), ["stem", "mtime"], "left_anti")
    return df


def upsert_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old rows of the same key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def report_stats(chunks: DataFrame, flat: DataFrame) -> DataFrame:
    """Registry rows: pages, table rows and chunks per report."""
    c = chunks.groupBy("report").agg(F.max("page").alias("pages"), F.count(F.lit(1)).alias("chunks"))
    r = flat.groupBy("report").agg(F.count(F.lit(1)).alias("csv_rows"))
    return c.join(r, "report", "full_outer").select(
        F.col("report").alias("stem"), F.coalesce("pages", F.lit(0)).alias("pages"),
        F.coalesce("csv_rows", F.lit(0)).alias("csv_rows"), F.coalesce("chunks", F.lit(0)).alias("chunks"),
    )


def registry_totals(registry: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return registry.agg(F.count(F.lit(1)).alias("reports"), total("pages"), total("chunks"), total("csv_rows"))


def split_failures(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable pages, dead letters): a report with any unreadable page fails as a whole.

    A page is unreadable when its text is null or its number is no positive integer.
    """
    number = F.col("page").cast("string").try_cast("int")
    problem = F.when(F.col("text").isNull(), "no text").when(number.isNull() | (number < 1), "bad page number")
    bad = (
        pages.withColumn("error", problem).filter(F.col("error").isNotNull())
        .groupBy("report").agg(F.min("error").alias("error"), F.count(F.lit(1)).alias("bad_pages"))
    )
    # Sent to the pages while they are few, so that the texts are not shuffled.
    bad = stored_small(bad, "bad-reports")
    return pages.join(bad.select("report"), "report", "left_anti"), bad


def needs_ocr(reports: DataFrame, pages: DataFrame, sample: int = OCR_SAMPLE, min_chars: int = OCR_MIN_CHARS) -> DataFrame:
    """(report, needs_ocr, reason): mean text size of evenly spread sample pages."""
    chars = F.length(F.translate(F.coalesce("text", F.lit("")), " \n", ""))
    sizes = pages.select("report", "page", chars.alias("chars"))
    counts = sizes.groupBy("report").agg(F.count(F.lit(1)).alias("n_pages"))
    step = F.greatest(F.lit(1), F.floor(F.col("n_pages") / sample))
    index = F.col("page") - 1
    picked = sizes.join(counts, "report").filter(
        (index % step == 0) & (F.floor(index / step) < sample)
    )
    means = picked.groupBy("report").agg(F.avg("chars").alias("avg_chars"))
    low = F.col("avg_chars") < min_chars
    return reports.select("report").join(means, "report", "left").select(
        "report",
        F.coalesce(low, F.lit(True)).alias("needs_ocr"),
        F.when(F.col("avg_chars").isNull(), "PDF has no pages")
        .when(low, F.concat(F.lit("Low text density: avg "), F.format_number("avg_chars", 0), F.lit(f" chars/page (threshold {min_chars})")))
        .otherwise("")
        .alias("reason"),
    )
