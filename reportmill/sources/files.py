"""Readers and writers of the files around the jobs: manifests, report trees, tables,
chunks, event logs. Schemas are explicit; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import stem_slug, strip

# Column order of the manifest and company files.
MANIFEST_COLUMNS = (
    "report_id", "company_id", "company_name", "company_name_normalized", "sector", "year",
    "document_type", "title", "source_url", "document_url", "local_path", "file_name", "file_size",
    "sha256", "download_status", "pdf_pages", "scraped_at", "downloaded_at", "error",
)
COMPANY_COLUMNS = (
    "company_id", "company_name", "company_name_normalized", "sector", "sector_normalized",
    "url", "website", "scraped_at",
)
DONE_STATUSES = ("downloaded", "skipped")
CHUNK_SCHEMA = "id INT, page INT, report STRING, text STRING, source STRING, company STRING, company_normalized STRING, year STRING, sector STRING, url STRING"
FLAT_SCHEMA = "page INT, tableau INT, ligne INT, " + ", ".join(f"col{i} STRING" for i in range(1, 13))
EVENT_SCHEMA = (
    "seq BIGINT, ts TIMESTAMP, event_type STRING, role STRING, ip STRING, ip_hash STRING, device STRING, browser STRING, os STRING, "
    "city STRING, country STRING, country_code STRING, isp STRING, meta STRUCT<ok: BOOLEAN, email: STRING, year: STRING, sector: STRING, "
    "page: STRING, scope: STRING, screen: STRING, lang: STRING, kind: STRING, session: STRING, reason: STRING, question: STRING, error: STRING, "
    "report: STRING, company: STRING, path: STRING, referrer: STRING, latency_ms: DOUBLE, sources: DOUBLE, chars: DOUBLE, count: DOUBLE>"
)


def _strings(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def file_order() -> Column:
    """Sort key that follows the rows of text files, split or read whole."""
    return F.struct(
        F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    )


def _read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    # The schema replaces the header, so a byte-order mark in front of it does no harm. A
    # quoted line break belongs to its cell, so a file is read as a whole; writers spread
    # large tables over many files.
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=True)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows as text plus `row_no`, the place of the row in the file."""
    return _read_csv(spark, path, _strings(MANIFEST_COLUMNS)).withColumn("row_no", file_order())


def read_companies(spark: SparkSession, path: str) -> DataFrame:
    """Company attributes by name; blanks become null."""
    clean = lambda c: F.nullif(strip(F.coalesce(c, F.lit(""))), F.lit(""))
    df = _read_csv(spark, path, _strings(COMPANY_COLUMNS))
    return df.select(
        strip(F.coalesce("company_name", F.lit(""))).alias("name"),
        clean("sector").alias("sector"),
        clean("company_id").alias("external_id"),
        clean("url").alias("url"),
    ).filter(F.col("name") != "")


def write_csv(df: DataFrame, path: str) -> None:
    """Overwrite as CSV with a header. The committer publishes complete files only."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def typed_manifest(manifest: DataFrame) -> DataFrame:
    number = lambda c, t: F.col(c).try_cast(t).alias(c)
    rest = [c for c in manifest.columns if c not in ("year", "file_size", "pdf_pages")]
    return manifest.select(*rest, number("year", "int"), number("file_size", "bigint"), number("pdf_pages", "int"))


def stem_metadata(manifest: DataFrame) -> DataFrame:
    """One row per report stem from downloaded or skipped manifest rows; the last row wins.

    The company folder is the third path part from the end; without a usable path the
    normalised or displayed name stands in.
    """
    text = lambda c: strip(F.coalesce(c, F.lit("")))
    parts = F.filter(F.split(F.translate(text("local_path"), "\\", "/"), "/"), lambda p: p != "")
    usable = (F.size("_parts") >= 4) & F.lower(F.element_at("_parts", -1)).endswith(".pdf")
    named = F.coalesce(F.nullif(text("company_name_normalized"), F.lit("")), text("company_name"))
    df = (
        manifest.filter(text("download_status").isin(*DONE_STATUSES))
        .withColumn("_parts", parts)
        .withColumn("_folder", F.when(usable, F.get("_parts", F.size("_parts") - 3)).otherwise(named))
        .withColumn("company_normalized", stem_slug(F.col("_folder")))
        .withColumn("year", text("year"))
        .filter(F.col("year") != "")
        .withColumn("stem", F.concat_ws("_", "company_normalized", "year"))
    )
    row = F.struct(
        text("company_name").alias("company"), F.col("company_normalized"), F.col("year"), text("sector").alias("sector"),
        text("report_id").alias("report_id"), text("source_url").alias("source_url"), text("document_url").alias("document_url"),
    )
    return df.groupBy("stem").agg(F.max_by(row, "row_no").alias("r")).select("stem", "r.*")


def list_report_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, mtime) of the PDF files below a folder; contents are not read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(root)
        .select("path", "length", F.col("modificationTime").alias("mtime"))
    )


def read_report_files(spark: SparkSession, root: str) -> DataFrame:
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(root)
        .select("path", "length", F.col("modificationTime").alias("mtime"), "content")
    )


def report_tree(files: DataFrame, root: str, meta: DataFrame) -> DataFrame:
    """Files at root/sector/company/year/name.pdf with metadata, else with their path parts."""
    top = root.rstrip("/") + "/"
    plain = F.regexp_replace("path", "^file:/+", "/")
    inner = F.when(F.startswith(plain, F.lit(top)), F.substring(plain, F.lit(len(top) + 1), F.length(plain))).otherwise(plain)
    parts = F.split(inner, "/")
    df = files.withColumn("_p", parts).filter(F.size("_p") == 4)
    base = stem_slug(F.get("_p", F.lit(1)))
    df = df.withColumn("_base", base).withColumn("stem", F.concat_ws("_", "_base", F.get("_p", F.lit(2))))
    m = meta.select("stem", F.lit(True).alias("_known"), *[F.col(c).alias(f"m_{c}") for c in ("company", "company_normalized", "year", "sector", "report_id", "source_url")])
    known = F.col("_known").isNotNull()
    pick = lambda name, other: F.when(known, F.col(f"m_{name}")).otherwise(other).alias(name)
    return df.join(m, "stem", "left").select(
        "stem", *[c for c in files.columns],
        pick("company", F.get("_p", F.lit(1))), pick("company_normalized", F.col("_base")),
        pick("year", F.get("_p", F.lit(2))), pick("sector", F.get("_p", F.lit(0))),
        pick("report_id", F.lit("")), pick("source_url", F.lit("")),
    )


def write_flat_tables(flat: DataFrame, path: str) -> None:
    """Flat table rows as CSV with the report as last column.

    The rows stay in few large files, near each other by report; a folder per report would
    mean one tiny file per report and task.
    """
    columns = [c for c in flat.columns if c != "report"]
    write_csv(flat.select(*columns, "report").hint("rebalance", "report"), path)


def read_flat_tables(spark: SparkSession, path: str) -> DataFrame:
    return _read_csv(spark, path, FLAT_SCHEMA + ", report STRING")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines, one folder per stem; only the folders written to are replaced.

    Rebalancing gathers a stem's rows before the write and splits the stems that are large.
    """
    out = chunks.withColumn("stem", F.col("report")).hint("rebalance", "stem")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("stem").json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK_SCHEMA + ", stem STRING").json(path)


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Event records from JSON lines; lines that are no record are left out."""
    raw = spark.read.schema(EVENT_SCHEMA + ", _bad STRING").option("columnNameOfCorruptRecord", "_bad").option("mode", "PERMISSIVE").json(path)
    return raw.filter(F.col("_bad").isNull() & F.col("event_type").isNotNull()).drop("_bad")


def append_events(events: DataFrame, path: str, known: tuple[str, ...] | None = None, fmt: str = "parquet") -> None:
    """Append events by day; records of unknown types are dropped."""
    from ..operators.events import EVENT_TYPES

    kept = events.filter(F.col("event_type").isin(*(known or EVENT_TYPES)))
    kept.withColumn("day", F.to_date("ts")).hint("rebalance", "day").write.mode("append").partitionBy("day").format(fmt).save(path)


def write_registry(registry: DataFrame, errors: DataFrame, path: str) -> None:
    """Registry and error list as two side outputs of an index run."""
    registry.write.mode("overwrite").json(f"{path.rstrip('/')}/registry")
    errors.write.mode("overwrite").json(f"{path.rstrip('/')}/errors")
