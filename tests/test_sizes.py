"""What reads its input once, and what is sent to large tables instead of shuffling them."""

import random

from pyspark.sql import functions as F

from reportmill.functions.text import WS_CHARS
from reportmill.operators import corpus as C
from reportmill.operators import grams as G
from reportmill.plans import all_queries, corpus_queries, search_queries  # noqa: F401, corpus first
from reportmill.sources.bucketed import BucketTable
from reportmill.sources.runs import newest


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_by_every_white_space(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(["a", "é", "​", " ", *WS_CHARS]) for _ in range(60)) for _ in range(200)] + ["", " ", "a", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", C.words_of(F.col("t")).alias("w")).collect()
    assert {r["i"]: r["w"] for r in rows} == {i: None if t is None else t.split() for i, t in enumerate(texts)}


def test_chunk_counts_are_stored(spark):
    """The texts are cut for the stored counts and for the chunks; only repeated pages once more."""
    rows = [("a", 1, "x " * 700), ("a", 2, "y " * 10), ("a", 2, "b " * 320), ("a", 3, "z"), ("b", 1, "w")]
    df = C.chunk_pages(spark.createDataFrame(rows, "report string, page int, text string"))
    assert any("page-chunks" in f for f in df.inputFiles())
    got = sorted((r["report"], r["id"], r["page"], r["text"][0]) for r in df.collect())
    assert got == [("a", 0, 1, "x"), ("a", 1, 1, "x"), ("a", 2, 1, "x"), ("a", 3, 2, "b"), ("a", 4, 2, "b"), ("a", 5, 2, "y"), ("a", 6, 3, "z"), ("b", 0, 1, "w")]


def test_upserted_chunks_are_numbered_once(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(BucketTable, "replace", lambda self, new: seen.extend(new.inputFiles()))
    spark.createDataFrame([(i, f"word {i}", "en", f"s{i % 2}") for i in range(9)], "doc_id bigint, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    all_queries()["c12_upsert_stored_chunks"](spark, str(tmp_path))
    assert seen and all("numbered-chunks" in f for f in seen)


def test_few_rows_are_sent_to_the_texts(spark, tmp_path, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = spark.createDataFrame([(f"c{i}", f"some word{i} text") for i in range(40)], "chunk_id string, folded string")
        hits = G.containing_words(spark.createDataFrame([("word3",), ("text",)], "word string"), texts)
        assert "BroadcastHashJoin" in plan(hits)
        assert sorted((r["word"], r["chunk_id"]) for r in hits.collect()) == sorted([("text", f"c{i}") for i in range(40)] + [("word3", f"c{i}") for i in (3, *range(30, 40))])
        pages = spark.createDataFrame([("a", 1, "x"), ("b", 1, None), ("b", 2, "y")], "report string, page int, text string")
        good, bad = C.split_failures(pages)
        assert "SortMergeJoin" not in plan(good) and [r["page"] for r in good.collect()] == [1] and bad.count() == 1
        rows = spark.createDataFrame([("a", 1, 0), ("a", 2, 1), ("b", 3, 0)], "k string, v int, batch bigint")
        last = newest("k")(rows)
        assert "SortMergeJoin" not in plan(last) and sorted(r["v"] for r in last.collect()) == [2, 3]
        ranked = spark.createDataFrame([(1, "c1", 7, 1)], "qid bigint, chunk_id string, ord bigint, rank int")
        monkeypatch.setattr(search_queries, "_ranked", lambda s, d: (ranked, texts.withColumns({"ord": F.lit(0), "embedding": F.lit(0)})))
        found = search_queries._hits(spark, "")
        assert "SortMergeJoin" not in plan(found) and [r["folded"] for r in found.collect()] == ["some word1 text"]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
