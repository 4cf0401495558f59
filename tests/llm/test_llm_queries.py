"""Registered queries of the corpus operators and the pipeline, on the smallest tables."""

import hashlib
import os

import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from harness import compare, connect
from reportmill.llm import queries
from reportmill.llm.common import table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = {
    "op1_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op2_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op3_html_blocks": {"page_id", "url", "text", "n_chars"},
    "op4_gru_lm": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op5_decontamination": {"doc_id", "item_id"},
    "op6_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op7_simhash": {"doc_id", "fingerprint", "component_id"},
    "op8_url_filter": {"page_id", "host", "path", "rule", "verdict"},
    "op9_quotation": {"conv_id", "turn", "position"},
    "op11_language": {"doc_id", "held_out", "lang_pred", "score"},
    "op12_divergence": {"lang", "source", "part", "item", "value", "rank"},
    "op13_hard_negatives": {"anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"},
    "op10_pii": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"},
}


def test_all_are_registered():
    assert set(queries.RUNNERS) == set(COLUMNS)
    assert {*COLUMNS, "pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    found = queries.RUNNERS[name](spark, SF)
    assert COLUMNS[name] <= set(found.columns)
    if name in queries.ORACLES:
        rows, problem = compare(spark, connect(SF), queries.RUNNERS[name], queries.ORACLES[name], SF)
        assert problem is None, problem
    elif name != "op5_decontamination":
        source = "pages" if name in ("op3_html_blocks", "op8_url_filter") else "documents"
        assert found.count() == table(spark, SF, source).count()


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    names = docs.columns
    before = {r["doc_id"] for r in docs.collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        ids = [r["doc_id"] for r in rows]
        assert set(ids) <= before and len(ids) > 0.7 * len(before)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
            docs = spark.createDataFrame(rows, docs.schema)
        before = set(ids)
    assert {(r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()} == {(r["doc_id"], r["ids_sha256"]) for r in rows}


def test_pipeline_of_nothing(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def documents():
    return connect(SF).execute("SELECT doc_id, text FROM documents").fetchall()


def test_simhash_query_against_pairs(spark):
    from test_llm_simhash import classes

    got = [(r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in queries.RUNNERS["op7_simhash"](spark, SF).collect()]
    assert sorted(got, key=str) == classes(documents())


def test_bpe_query_against_the_library(spark):
    library = Tokenizer.from_file(queries.vocabulary())
    want = {}
    for doc, text in documents():
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[doc] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.RUNNERS["op6_bpe"](spark, SF).collect()}
    assert got == want


def test_personal_data_query_against_patterns(spark):
    from test_llm_rules import KINDS, base

    want = {}
    for doc, text in documents():
        found = base(text)
        spans = ",".join(f"{list(KINDS)[k]}:{a}:{b}" for a, k, b in found)
        want[doc] = (*(sum(f[1] == k for f in found) for k in range(4)), hashlib.sha256(spans.encode()).hexdigest())
    rows = queries.RUNNERS["op10_pii"](spark, SF).collect()
    assert {r["doc_id"]: (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in rows} == want


def test_decontamination_query_against_windows(spark):
    from test_llm_rules import windows

    items = [(k, windows(t)) for k, t in connect(SF).execute("SELECT item_id, text FROM benchmark").fetchall()]
    want = {(doc, k) for doc, text in documents() for k, asked in items if 2 * len(asked & windows(text)) >= len(asked)}
    got = {(r["doc_id"], r["item_id"]) for r in queries.RUNNERS["op5_decontamination"](spark, SF).collect()}
    assert want <= got and all(len(dict(items)[k] & windows(dict(documents())[doc])) > 0 for doc, k in got)


def test_language_query_against_counters(spark):
    import zlib

    from test_llm_language import brute

    rows = connect(SF).execute("SELECT doc_id, text, lang FROM documents").fetchall()
    outside = lambda k: zlib.crc32(str(k).encode()) % 3 == 1
    want = brute(rows, lambda k: not outside(k), 400)
    got = queries.RUNNERS["op11_language"](spark, SF).collect()
    assert len(got) == len(rows)
    assert all(r["held_out"] == outside(r["doc_id"]) and r["lang_pred"] == want[r["doc_id"]][0] and abs(r["score"] - want[r["doc_id"]][1]) < 1e-9 for r in got)
    tested = [(r["lang_pred"], lang) for r in got for k, _, lang in rows if k == r["doc_id"] and r["held_out"] and lang is not None]
    assert sum(a == b for a, b in tested) >= 0.95 * len(tested)


def test_html_query_page_by_page(spark):
    """Blocks against the parser of the standard library, labels against one page at a time."""
    from html.parser import HTMLParser

    from reportmill.llm import html_blocks

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.said, self.inside = [], 0

        def handle_starttag(self, tag, attrs):
            self.inside += tag in html_blocks._RAW
            self.said.append("" if tag in html_blocks._INLINE else " ")

        def handle_endtag(self, tag):
            self.inside -= tag in html_blocks._RAW and self.inside > 0
            self.said.append("" if tag in html_blocks._INLINE else " ")

        def handle_data(self, data):
            if not self.inside:
                self.said.append(data)

    pages = table(spark, SF, "pages")
    model = html_blocks.Labeller.load(html_blocks.fit(pages, "page_id", "html"))
    want = {}
    for page in pages.collect():
        found = html_blocks.blocks(page["html"])
        plain = Plain()
        plain.feed(page["html"] or "")
        plain.close()
        assert " ".join(b.text for b in found).split() == "".join(plain.said).split()
        main = model.probabilities(html_blocks.inputs(found), np.array([len(found)])) >= 0.5 if found else []
        text = " ".join(b.text for b, m in zip(found, main, strict=True) if m)
        want[page["page_id"]] = (page["url"], text, len(text))
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in queries.RUNNERS["op3_html_blocks"](spark, SF).collect()}
    assert got == want and any(w[1] for w in want.values())


def test_language_model_query_document_by_document(spark):
    from collections import Counter

    from reportmill.llm import gru_lm
    from reportmill.llm.common import held_out

    docs = table(spark, SF, "documents").select("doc_id", "text")
    teaching = docs.filter(~held_out("doc_id", 7, 2))
    said = {r["doc_id"]: gru_lm.tokens([r["text"]])[0] for r in docs.collect()}
    counts = Counter(h for r in teaching.select("doc_id").collect() for h in said[r["doc_id"]].tolist())
    n, v = sum(counts.values()), len(counts)
    vocabulary = gru_lm.Vocabulary(np.array(list(counts), np.uint64), np.array(list(counts.values()), np.int64))
    model = gru_lm.Gru.load(gru_lm.fit(teaching, vocabulary, n, "doc_id", "text"))
    rest_n, rest_v = n - vocabulary.n_top, v - vocabulary.v_top
    got = {r["doc_id"]: r for r in queries.RUNNERS["op4_gru_lm"](spark, SF).collect()}
    better = []
    for doc, h in said.items():
        places, _ = vocabulary.look_up(h)
        network = model.totals(places, np.array([len(h)]))[0] / np.log(10)
        rare = sum(np.log10((counts[x] + 1) / (rest_n + rest_v + 1)) for x, p in zip(h.tolist(), places, strict=True) if p == vocabulary.OTHER)
        base = sum(np.log10((counts[x] + 1) / (n + v + 1)) for x in h.tolist())
        r = got[doc]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(h), sum(counts[x] > 0 for x in h.tolist()), n)
        assert abs(r["base_score"] - base) < 1e-6 * abs(base) and abs(r["score"] - network - rare) < 1e-3 * abs(network + rare)
        better += [r["score"] > r["base_score"]] if r["held_out"] else []
    assert sum(better) > 0.8 * len(better)
