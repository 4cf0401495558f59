"""Corpus pipeline: toxicity, near-duplicates, benchmark leaks, personal data, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's docs. All stages work on whole tables. All but the last
return the columns of `documents`, extra ones included; an empty table stays empty in each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reportmill.llm import bpe, decontaminate, pii, simhash, toxicity
from reportmill.llm.common import held_out, table
from reportmill.llm.queries import TOXIC_AT, vocabulary
from reportmill.session import materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose toxicity score is below TOXIC_AT.

    Null and empty texts are scored like any other (by the model's bias) and repeated rows get
    equal scores, so both stay or go together; without labelled rows all stay.
    """
    scored = toxicity.score(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 4, 2))
    return scored.filter(scored["score"] < TOXIC_AT).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document, by id, of each group of copies and near copies.

    Null and empty texts are copies of each other; a null id comes first; of rows repeated as
    a whole one stays.
    """
    return simhash.keep_first(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that take over a benchmark item.

    Null and empty texts and rows without an id match nothing and stay; repeated rows go
    together; without benchmark items all stay.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and the terms that give it away; n_chars follows the text.

    Every row stays. A null text stays null, an empty one empty; repeated rows change alike.
    """
    return pii.sanitise(docs, length_col="n_chars")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the token ids of every document, and the digest of the decoded text.

    Every row gives one row, repeated ones equal ones; a null text counts as empty.
    """
    return bpe.digests(docs, vocabulary())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("personal_data", remove_personal_data),
    ("token_ids", encode),
]

#: No SQL states a fitted classifier, SimHash or BPE; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
