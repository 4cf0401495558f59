"""Keyword index and vector buckets, against scans of all texts and vectors."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportmill.functions.text import ascii_lower
from reportmill.operators import buckets as B
from reportmill.operators import grams as G
from reportmill.operators import search as R

CHUNKS = "chunk_id string, ord bigint, text string, report string, company_normalized string, year string, sector string"


def corpus(rnd, n):
    parts = ["info", "rmation", "bénéfice", "net", "a", "\n", " ", "ab", "aba", "x.y", "résultat", "(z)", "tion"]
    text = lambda: None if rnd.random() < 0.03 else "".join(rnd.choices(parts, k=rnd.randrange(0, 12)))
    return [(f"c{i}", i, text(), f"r{i % 7}", f"s{i % 2}", str(2018 + i % 3), rnd.choice(["en", "fr", None])) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_words_are_found_anywhere(spark, seed):
    rnd = random.Random(seed)
    frame = spark.createDataFrame(corpus(rnd, 200), CHUNKS).select("chunk_id", ascii_lower(F.col("text")).alias("folded"))
    texts = {r["chunk_id"]: r["folded"] for r in frame.collect()}
    words = ["information", "tion", "aba", "ab", "a", "", "netnet", "x.y", "(z)", "missing", "formationinfo", None, "tion", "\n ", "benefice"]
    asked = spark.createDataFrame([(w,) for w in words], "word string")
    want = {(w, c) for w in words for c, t in texts.items() if w is not None and t is not None and w in t}
    for stored in (None, G.postings(frame, (0, 1, 2, 3, G.GRAM))):
        got = [(r["word"], r["chunk_id"]) for r in G.containing(asked, frame, stored).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert G.containing(asked.limit(0), frame).count() == 0 and G.containing(asked, frame.limit(0)).count() == 0


def test_words_inside_tokens(spark):
    rnd = random.Random(6)
    frame = spark.createDataFrame(corpus(rnd, 150) + [("e", 999, "", "r", "s", "2018", None), ("w", 998, " \n", "r", "s", "2018", None)], CHUNKS).select("chunk_id", ascii_lower(F.col("text")).alias("folded"))
    texts = {r["chunk_id"]: r["folded"] for r in frame.collect()}
    words = ["information", "tion", "ab", "a", "", "netnet", "x.y", "(z)", "missing", None, "tion"]
    want = {(w, c) for w in words for c, t in texts.items() if w is not None and t is not None and w in t}
    for stored in (None, G.token_postings(frame)):
        got = [(r["word"], r["chunk_id"]) for r in G.containing_words(spark.createDataFrame([(w,) for w in words], "word string"), frame, stored).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_the_rarest_gram_is_looked_up(spark):
    texts = spark.createDataFrame([(f"c{i}", "information" if i < 3 else "formation") for i in range(50)], "chunk_id string, folded string")
    grams = G.word_grams(spark.createDataFrame([("information",), ("unknown",)], "word string"))
    chosen = G.rarest(grams, G.postings(texts)).collect()
    assert [(r["word"], r["gram"]) for r in chosen] == [("information", "info")]


def test_keyword_scores_with_filters(spark):
    rnd = random.Random(4)
    words = ["revenue", "growth", "margin", "energy", "mining", "water"]
    rows = [(f"c{i}", i, " ".join(rnd.choices(words, k=3)), f"r{i % 5}", f"s{i % 2}", str(2018 + i % 3), rnd.choice(["en", "fr", None])) for i in range(300)]
    chunks = spark.createDataFrame(rows, CHUNKS)
    asked = [(q, " ".join(rnd.sample(words, 3)), rnd.choice([None, "", "r1"]), rnd.choice([None, "s1"]), rnd.choice([None, [], ["2018", "2020"]]), rnd.choice([None, "en"])) for q in range(40)]
    asked.append((99, "the of a", None, None, None, None))
    prepared = R.prepare_questions(spark.createDataFrame(asked, "qid int, question string, report string, company string, years array<string>, sector string"))
    weights = {r["qid"]: {k["word"]: k["weight"] for k in r["keywords"]} for r in prepared.collect()}
    want = set()
    for q, _, report, company, years, sector in asked:
        seen = [r for r in rows if (not report or r[3] == report) and (not company or r[4] == company) and (not years or r[5] in years) and (not sector or r[6] == sector)]
        scored = sorted((-sum(w for k, w in weights[q].items() if k in r[2]), r[1], r[0]) for r in seen)
        want |= {(q, c, round(-s, 6), i + 1) for i, (s, _, c) in enumerate([x for x in scored if x[0] < 0][:4])}
    got = {(r["qid"], r["chunk_id"], round(r["score"], 6), r["rank"]) for r in R.keyword_top_k(prepared, chunks, 4).collect()}
    assert got == want


def vectors(spark, x, sectors):
    none = F.lit(None).cast("string")
    base = spark.createDataFrame([(i, [float(v) for v in row], s) for i, (row, s) in enumerate(zip(x, sectors))], "i bigint, embedding array<float>, s string")
    chunks = base.select(F.concat(F.lit("v"), "i").alias("chunk_id"), F.col("i").alias("ord"), "embedding", none.alias("report"), none.alias("company_normalized"), none.alias("year"), F.col("s").alias("sector"))
    asked = base.select(F.col("i").alias("qid"), F.lit(0).alias("variant"), "embedding", none.alias("f_report"), none.alias("f_company"), F.lit(None).cast("array<string>").alias("f_years"), F.col("s").alias("f_sector"))
    return asked, chunks


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_probed_search_on_clustered_vectors(spark, metric):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 24))
    x = centres[rng.integers(0, 60, 3000)] + 0.15 * rng.normal(size=(3000, 24))
    x[:200] = x[0]  # one bucket with many copies
    asked, chunks = vectors(spark, x, [None if i % 3 else "a" for i in range(3000)])
    index = B.fit(chunks, 4, metric, bucket_rows=64)
    assert index.sample_recall >= 0.95 and index.thresholds.shape == (B.BANDS, 6)
    want = {(r["qid"], r["chunk_id"]): r["distance"] for r in R.vector_top_k(asked, chunks, 4, metric).collect()}
    got = {(r["qid"], r["chunk_id"]): r["distance"] for r in R.near_vectors(asked, chunks, index, 4, metric).collect()}
    assert len(set(got) & set(want)) >= 0.9 * len(want)
    assert all(abs(got[k] - want[k]) < 1e-12 for k in set(got) & set(want))
    # Far fewer pairs than all of them meet.
    sides = index.sides(B._matrix(x[:500].astype(np.float32), metric))
    own, probed = index.probe(sides, 1), index.probe(sides, index.probes)
    meets = np.zeros((500, 500), bool)
    for t in range(own.shape[1]):
        for p in range(probed.shape[2]):
            meets |= probed[:, None, t, p] == own[None, :, t, 0]
    assert meets[200:, 200:].mean() < 0.35


def test_probes_start_at_home_and_differ():
    rng = np.random.default_rng(5)
    index = B.Buckets(rng.normal(size=(2, 5, 8)), np.zeros((2, 5)), 4, "l2", 1.0)
    sides = index.sides(rng.normal(size=(70, 8)))
    probes = index.probe(sides, 32)
    assert (probes[:, :, 0] == index.buckets(sides)).all()
    assert all(len(set(row)) == 32 for own in probes for row in own)


def test_buckets_of_nothing(spark):
    asked, chunks = vectors(spark, np.zeros((2, 3)), [None, None])
    index = B.fit(chunks.limit(0), 4)
    assert index.probes == 1
    one = B.fit(chunks.limit(1), 4)
    assert R.near_vectors(asked, chunks.limit(1), one, 4).count() == 2


def probed_pairs(x, sectors, index, k, metric):
    """What `near_vectors` should find, from the buckets of all pairs."""
    x = np.asarray(x, np.float32).astype(np.float64)
    sides = index.sides(B.as_rows(x, metric))
    own, probed = index.buckets(sides), index.probe(sides, index.probes)
    out = {}
    for i, q in enumerate(x):
        meets = np.array([any(own[j, t] in set(probed[i, t]) for t in range(own.shape[1])) for j in range(len(x))])
        seen = [j for j in np.flatnonzero(meets) if sectors[i] is None or sectors[j] == sectors[i]]
        far = lambda j: 1 - (x[j] * q).sum() / (np.linalg.norm(x[j]) * np.linalg.norm(q)) if metric == "cosine" else ((x[j] - q) ** 2).sum()
        best = sorted((round(far(j), 12), j) for j in seen if metric != "cosine" or (x[j].any() and q.any()))[:k]
        out |= {(i, f"v{j}"): d for d, j in best}
    return out


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("block", [20, 10_000])
def test_probed_search_meets_the_probed_buckets(spark, metric, block):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(160, 6))
    x[:12], x[12] = x[0], 0.0
    sectors = [None if i % 5 == 0 else f"s{i % 2}" for i in range(160)]
    asked, chunks = vectors(spark, x, sectors)
    fitted = B.fit(chunks, 3, metric, bucket_rows=5)
    assert fitted.bits == 5
    index = B.Buckets(fitted.directions, fitted.thresholds, 3, metric, 0.0)
    want = probed_pairs(x, sectors, index, 3, metric)
    rows = R.near_vectors(asked, chunks, index, 3, metric, question_block=block, chunk_block=block).collect()
    got = {(r["qid"], r["chunk_id"]): r["distance"] for r in rows}
    assert len(rows) == len(got) and set(got) == set(want)
    assert all(abs(got[p] - want[p]) < 1e-9 for p in got)


@pytest.mark.parametrize("bits", [4, 12])
def test_reach_tells_the_probed_buckets(bits):
    rng = np.random.default_rng(5)
    index = B.Buckets(rng.normal(size=(2, bits, 8)), np.zeros((2, bits)), 9, "l2", 1.0)
    sides = index.sides(rng.normal(size=(70, 8)))
    probed, reach = index.probe(sides, index.probes), index.reach(sides)
    for t in range(2):
        within = index.within(sides[:, t], reach[:, t], np.arange(1 << bits))
        assert [set(np.flatnonzero(row)) for row in within] == [set(row) for row in probed[:, t]]
        cells = index.within(sides[:, t], reach[:, t], np.arange(4), 2)
        assert all(set(np.flatnonzero(row)) >= {b & 3 for b in own} for row, own in zip(cells, probed[:, t]))


def test_many_probes_do_not_multiply_questions(spark):
    """Random directions need most buckets; a row for each of them would make millions of rows here."""
    x = np.random.default_rng(9).normal(size=(6000, 32))
    asked, chunks = vectors(spark, x, [f"s{i % 2}" for i in range(6000)])
    index = B.fit(chunks, 4, "cosine", bucket_rows=6)
    assert index.bits == 10 and index.probes > 50
    started = time.time()
    got = {(r["qid"], r["chunk_id"]) for r in R.near_vectors(asked, chunks, index, 4, "cosine").collect()}
    assert time.time() - started < 60
    want = {(r["qid"], r["chunk_id"]) for r in R.vector_top_k(asked, chunks, 4, "cosine").collect()}
    assert len(got & want) >= 0.9 * len(want)


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_equal_vectors_come_in_corpus_order(spark, metric):
    x = np.random.default_rng(4).normal(size=(900, 5))
    x[:700] = x[0]
    asked, chunks = vectors(spark, x, ["a"] * 900)
    rows = R.vector_top_k(asked, chunks, 3, metric, 400, 300).filter("qid < 700").collect()
    assert len(rows) == 2100 and all(r["chunk_id"] == f"v{r['rank'] - 1}" for r in rows)
