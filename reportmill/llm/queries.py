"""Registered queries of the corpus operators: thin, over whole tables, with their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, divergence, gru_lm, html_blocks, language, negatives, oracles, pii, quality_rules, quotes, simhash, toxicity, url_filter
from .common import held_out, table

RUNNERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file; pass another path to the operators to use another."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def wrap(run):
        RUNNERS[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return wrap


TOXIC_AT = 0.3


@query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = toxicity.score(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 4, 2))
    return rows.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


@query("op2_quality_rules", oracles.QUALITY_RULES)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.clean_lines(table(spark, sf_dir, "documents"))
    return rows.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", "kept_words", F.sha2("cleaned", 256).alias("cleaned_sha256"),
    )


@query("op3_html_blocks")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html_blocks.extract(table(spark, sf_dir, "pages"))
    return rows.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op4_gru_lm")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gru_lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), ~held_out("doc_id", 7, 2))
    return rows.select(
        F.col("id").alias("doc_id"), held_out("id", 7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score",
    )


@query("op5_decontamination")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "found", "wanted", "changed")


@query("op6_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary())


@query("op7_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query("op8_url_filter", oracles.URL_FILTER)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.spam_pages(pages)).withColumnRenamed("id", "page_id")


@query("op9_quotation", r"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, role, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations
), numbered AS (
  SELECT conv_id, turn, role, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM raw
), parsed AS (
  SELECT *, length(replace(regexp_extract(line, '^(?:[ \t]*>)+'), ' ', '')) -
    length(replace(replace(regexp_extract(line, '^(?:[ \t]*>)+'), ' ', ''), '>', '')) AS level,
    CASE WHEN regexp_extract(line, '^(?:[ \t]*>)+') = '' THEN line
      ELSE trim(substr(line, length(regexp_extract(line, '^(?:[ \t]*>)+')) + 1)) END AS content
  FROM numbered
), said AS (
  SELECT conv_id, turn, level, trim(regexp_replace(lower(content), '[^\p{L}\p{N}]+', ' ', 'g')) AS passage FROM parsed
), originals AS (
  SELECT conv_id, passage, min(turn) AS original FROM said WHERE level = 0 AND passage <> '' GROUP BY ALL
), weight AS (
  SELECT q.conv_id, q.turn, q.level, o.original, sum(length(q.passage)) AS chars
  FROM said q JOIN originals o USING (conv_id, passage) WHERE q.level > 0 AND o.original < q.turn GROUP BY ALL
), links AS (
  SELECT conv_id, turn, arg_max(original, row(-level, chars, original)) AS parent FROM weight GROUP BY ALL
), up AS (
  SELECT conv_id, turn, turn AS top FROM conversations
  UNION SELECT u.conv_id, u.turn, l.parent FROM up u JOIN links l ON u.conv_id = l.conv_id AND u.top = l.turn
), root AS (
  SELECT conv_id, turn, min(top) AS root_turn FROM up GROUP BY ALL
), clean AS (
  SELECT conv_id, turn, role, max(level) AS quote_depth,
    regexp_replace(coalesce(string_agg(content, chr(10) ORDER BY i) FILTER (WHERE level = 0 AND NOT introduces), ''), '^\n+|\n+$', '', 'g') AS text
  FROM (SELECT *, regexp_matches(content, '(?i)(wrote|writes|schrieb|écrit|escribió)[ \t]*:[ \t\r]*$')
      AND coalesce(lead(level) OVER (PARTITION BY conv_id, turn ORDER BY i) > 0, false) AS introduces FROM parsed)
  GROUP BY ALL
)
SELECT c.conv_id, c.turn, c.role, c.text, c.quote_depth::INT AS quote_depth, l.parent AS parent_turn, r.root_turn,
  row_number() OVER (PARTITION BY c.conv_id ORDER BY r.root_turn, c.turn) AS position,
  '<|im_start|>' || coalesce(c.role, 'user') || chr(10) || c.text || '<|im_end|>' || chr(10) AS formatted
FROM clean c JOIN root r USING (conv_id, turn) LEFT JOIN links l USING (conv_id, turn)
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quotes.thread(table(spark, sf_dir, "conversations"))
    return rows.select(
        F.col("conv").alias("conv_id"), "turn", "role", "text", "quote_depth", F.col("parent").alias("parent_turn"),
        F.col("root").alias("root_turn"), "position", "formatted",
    )


@query("op10_pii")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(pii.of_kind(F.col("base"), k)).cast("long").alias(f"n_{pii.KINDS[k]}") for k in range(4)]
    return found.select(
        "doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(pii.spans_of_all()).alias("spans"),
    )


@query("op11_language")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rows = language.identify(docs, ~held_out("doc_id", 3, 1))
    return rows.select(F.col("id").alias("doc_id"), held_out("id", 3, 1).alias("held_out"), "lang_pred", "score")


@query("op12_divergence", oracles.DIVERGENCE)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op13_hard_negatives", oracles.HARD_NEGATIVES)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", label)
    return negatives.mine(rows, lambda i: i % 50 == 0)
