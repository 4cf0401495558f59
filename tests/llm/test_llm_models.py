"""Fitted operators: gradients, probabilities, held-out accuracy and odd rows."""

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reportmill.llm import gru_lm, hashing, html_blocks, toxicity
from reportmill.llm.common import held_out

DOCS = "doc_id long, text string"


@pytest.mark.parametrize("part", [1 << 20, 7])
def test_word_hashes_follow_words(monkeypatch, part):
    monkeypatch.setattr(hashing, "_PART", part)
    texts = [b"", b"a b  a\n", b" one\x0btwo three\xc3\xa9", b"two", b"\t", b"x" * 50 + b" a"]
    h, n = hashing.word_hashes(texts)
    words = [w for t in texts for w in re.findall(rb"[^\x20\x09-\x0D]+", t)]
    assert n.tolist() == [len(re.findall(rb"[^\x20\x09-\x0D]+", t)) for t in texts]
    names = {}
    for w, x in zip(words, h.tolist(), strict=True):
        assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)


def spoken(rnd, bad):
    words = ["".join(rnd.choice("abcdefgh") for _ in range(3)) for _ in range(rnd.randrange(20, 80))]
    for _ in range(3 * bad):
        words.insert(rnd.randrange(len(words)), rnd.choice(["scumm", "foulx", "nasty"]))
    return " ".join(words)


def test_toxicity_of_held_out_rows(spark):
    rnd = random.Random(1)
    rows = [(i, spoken(rnd, i % 5 == 0)) for i in range(600)]
    odd = [(1000, None), (1001, ""), (1002, "x " * 40000), (1003, rows[0][1]), (1003, rows[0][1]), (None, rows[5][1])]
    docs = spark.createDataFrame(rows + odd, DOCS).withColumn("score", F.lit("own")).withColumn("label", F.lit(3))
    labels = spark.createDataFrame([*((i, int(i % 5 == 0)) for i in range(600)), (1001, None), (None, 1)], "doc_id long, toxic int")
    found = toxicity.score(docs, labels, ~held_out("doc_id", 4, 2))
    assert found.columns == ["doc_id", "text", "label", "score"] and found.count() == len(rows) + len(odd)
    scores = {r["doc_id"]: r["score"] for r in found.collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum((scores[i] >= 0.3) == (i % 5 == 0) for i in held) >= 0.98 * len(held)
    assert all(0 <= s <= 1 for s in scores.values()) and scores[1000] == scores[1001] and scores[1003] == scores[0]
    assert {r["score"] for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_ftrl_keeps_few_weights():
    rnd = np.random.default_rng(2)
    model = toxicity.Ftrl(200)
    for k in range(400):
        model.learn(np.unique(np.append(rnd.integers(2, 200, 10), k % 2)), k % 2)
    w = model.weights(np.arange(200))
    assert w[1] > 0 > w[0] and (w == 0).mean() > 0.5


def test_gru_is_a_distribution():
    model = gru_lm.Gru()
    states = np.random.default_rng(0).normal(0, 1, (1, gru_lm.HIDDEN)).astype(np.float32)
    every = np.arange(gru_lm.Vocabulary.OTHER + 1)
    total = np.exp(model.log_probs(np.repeat(states, len(every), axis=0), every)).sum()
    assert total == pytest.approx(1, abs=1e-4)


def test_gru_gradients(monkeypatch):
    model = gru_lm.Gru()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rng = np.random.default_rng(1)
    places = rng.choice([0, 5, 70, 71, gru_lm.Vocabulary.OTHER], (5, 3))
    xs, ys, h = places, np.roll(places, 1, axis=0), rng.normal(0, 1, (3, gru_lm.HIDDEN))

    def loss():
        state, out = h, 0.0
        for x, y in zip(xs, ys, strict=True):
            state = model.step(state, x)[0]
            out -= model.log_probs(state, y).sum()
        return out

    g, _ = model.gradients(h, xs, ys)
    for name, v in model.p.items():
        at = np.unravel_index(np.abs(g[name]).argmax(), v.shape)
        v[at] += 1e-5
        up = loss()
        v[at] -= 2e-5
        down = loss()
        v[at] += 1e-5
        assert g[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-4), name


def test_gru_scores_the_tail_of_a_long_text_at_once(monkeypatch):
    """Few documents under way: their words are scored when enough have come together."""
    rng, calls, score = np.random.default_rng(5), [], gru_lm.Gru.log_probs
    model, counts = gru_lm.Gru(), np.array([1, 2000, 40])
    places = rng.integers(0, gru_lm.Vocabulary.OTHER + 1, counts.sum())
    monkeypatch.setattr(gru_lm.Gru, "log_probs", lambda self, states, said: calls.append(len(said)) or score(self, states, said))
    at_once = model.totals(places, counts)
    assert calls == [counts.sum()]
    monkeypatch.setattr(gru_lm, "KEPT", 7)
    assert model.totals(places, counts) == pytest.approx(at_once, rel=1e-5) and sum(calls) == 2 * counts.sum()


def test_places_of_words_with_equal_leading_bits():
    rng = np.random.default_rng(6)
    hashes = np.unique(np.concatenate((rng.integers(0, 1 << 64, 500, np.uint64), np.arange(40, dtype=np.uint64), ~np.arange(40, dtype=np.uint64))))
    rng.shuffle(hashes)
    held, out = hashes[:300], hashes[300:]
    vocabulary = gru_lm.Vocabulary(held, np.arange(1, 301))
    assert vocabulary.look_up(held)[1].tolist() == list(range(1, 301)) and set(vocabulary.look_up(out)[1].tolist()) == {-1}


def test_whole_documents_one_by_one():
    """Documents walked side by side have the likelihood they have alone, whatever the window."""
    model, rng = gru_lm.Gru(), np.random.default_rng(4)
    documents = [rng.integers(0, 300, n) for n in (1, 40, 7, 33, 1, 100)]
    together = model.totals(np.concatenate(documents), np.array([len(d) for d in documents]))
    for d, got in zip(documents, together, strict=True):
        h, x, out = np.zeros((1, gru_lm.HIDDEN), np.float32), np.array([gru_lm.Vocabulary.OTHER]), 0.0
        for y in d:
            h = model.step(h, x)[0]
            x = np.array([y])
            out += model.log_probs(h, x)[0]
        assert got == pytest.approx(out, rel=1e-4)


def test_every_teaching_row_is_learned_once(spark, monkeypatch):
    """Tasks of a round are averaged by their tokens; all rows but the held out ones take part."""
    seen = spark.sparkContext.accumulator(0)
    learn = gru_lm.Learner.learn

    def counted(self, said, counts):
        seen.add(len(said))
        learn(self, said, counts)

    monkeypatch.setattr(gru_lm.Learner, "learn", counted)
    rnd = random.Random(7)
    chain = {w: [f"n{rnd.randrange(40)}" for _ in range(2)] for w in [f"n{k}" for k in range(40)]}

    def text():
        words = ["n0"]
        for _ in range(rnd.randrange(20, 120)):
            words.append(rnd.choice(chain[words[-1]]))
        return " ".join(words)

    docs = spark.createDataFrame([(i, text()) for i in range(600)], DOCS).repartition(4)
    found = gru_lm.score(docs, ~held_out("doc_id", 7, 2)).collect()
    outside = [r for r in found if zlib.crc32(str(r["id"]).encode()) % 7 == 2]
    assert sum(r["score"] > r["base_score"] for r in outside) > 0.95 * len(outside) and outside
    taught = sum(r["n_tokens"] for r in found) - sum(r["n_tokens"] for r in outside)
    assert seen.value in (0, taught)  # workers that were forked before the patch do not count


def test_average_of_weights():
    a, b = gru_lm.Gru(1), gru_lm.Gru(2)
    rows = gru_lm.pa.table({"task": [1, 0], "piece": [0, 0], "tokens": [300, 100], "weights": [gru_lm._pieces(m)[0].astype("<f4").tobytes() for m in (a, b)]})
    mean = np.frombuffer(gru_lm._average(rows).column("weights")[0].as_py(), "<f4")
    assert mean == pytest.approx(0.75 * gru_lm._pieces(a)[0] + 0.25 * gru_lm._pieces(b)[0], abs=1e-6)
    again = gru_lm._joined(gru_lm._pieces(a))
    assert all((again.p[k] == v).all() for k, v in a.p.items())


def test_start_says_what_counts_say():
    vocabulary = gru_lm.Vocabulary(np.arange(5, dtype=np.uint64), np.array([8, 4, 2, 1, 1]))
    model = gru_lm.Gru.start(vocabulary, 16)
    state = np.zeros((5, gru_lm.HIDDEN), np.float32)
    p = np.exp(model.log_probs(state, vocabulary.places))
    assert p == pytest.approx(np.array([8, 4, 2, 1, 1]) / 16, rel=0.75) and p[0] > p[1] > p[2] > p[3]


def test_language_model_columns(spark, monkeypatch):
    monkeypatch.setattr(gru_lm, "SENT", 50)
    rnd = random.Random(3)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join(rnd.choices(vocabulary[:5] if rnd.random() < 0.5 else vocabulary, k=rnd.randrange(0, 60))).upper()) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "w1 " * 20000), (203, "unseen w1"), (203, "unseen w1"), (None, "w2")]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    said = [[*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)), None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for words, h in zip(said, held, strict=True) if not h for w in words)
    n, v = sum(c.values()), len(c)
    want = Counter((i, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 4)) for (i, _), w in zip(rows, said, strict=True))
    docs = spark.createDataFrame(rows, DOCS).withColumn("n_tokens", F.lit("own"))
    found = gru_lm.score(docs, ~held_out("doc_id", 7, 2)).collect()
    got = Counter((r["id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in found)
    assert got == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in found)
    assert len({r["score"] for r in found if r["id"] == 203}) == 1
    assert gru_lm.score(docs.limit(0), ~held_out("doc_id", 7, 2)).count() == 0


def test_tags_by_the_rules_of_html():
    texts = lambda page: [b.text for b in html_blocks.blocks(page)]
    assert texts("<p title=don't>One</p><p>Two</p><p>Three's</p>") == ["One", "Two", "Three's"]
    assert texts('<a href="x>y</a>') == ["y"] and texts("<script src=/js/>var x=1;</script>ok") == ["ok"]
    assert texts("<script/>text") == ["text"] and texts("<svg/>x") == ["x"] and texts("a < b <c") == ["a < b <c"]
    assert texts("<p a='>' b=\">\">t</p>1<2>3") == ["t", "1<2>3"] and texts("x <!-- <p> --> y<!doctype html>z <!-- w") == ["x yz"]
    page = html_blocks.blocks("<P Class = 'Big One' id=top role=\"main\"/>up<td>a<td>b</td><style>p</style >c")
    assert [(b.text, b.path) for b in page] == [("up", ["p", "big", "one", "top", "main"]), ("a", ["td", "p", "big", "one", "top", "main"]), ("b", ["td", "p", "big", "one", "top", "main"]), ("c", ["p", "big", "one", "top", "main"])]


@pytest.mark.parametrize("piece", ['<p a="', '"', "<p title='x", "<a ", "</script", "<!--", "<p a='\" b=\"'"])
def test_pages_of_broken_tags_take_linear_time(piece):
    page = piece * (1_000_000 // len(piece))
    begin = time.process_time()
    html_blocks.blocks(page)
    assert time.process_time() - begin < 3


def test_labeller_gradients():
    model = html_blocks.Labeller()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    pages = [html_blocks.blocks(f"<nav><a>Home</a></nav><article><p>{'Some text. ' * k}</p><p>b</p></article>") for k in (1, 3)] + [html_blocks.blocks("<p>one</p>")]
    flat = [b for p in pages for b in p]
    seen, lengths, labels = html_blocks.inputs(flat), np.array([len(p) for p in pages]), np.array([0, 1, 1, 0, 1, 1, 0.0])

    def loss():
        p = model.probabilities(seen, lengths)
        return -(labels * np.log(p) + (1 - labels) * np.log(1 - p)).mean()

    g = model.gradients(seen, lengths, labels)
    for name, v in model.p.items():
        at = np.unravel_index(np.abs(g[name]).argmax(), v.shape)
        v[at] += 1e-3
        up = loss()
        v[at] -= 2e-3
        down = loss()
        v[at] += 1e-3
        assert g[name][at] == pytest.approx((up - down) / 2e-3, rel=2e-2, abs=1e-6), name


def test_blocks_of_odd_pages():
    text = lambda page: [b.text for b in html_blocks.blocks(page)]
    assert text(None) == text("") == text("<p> </p>") == []
    assert text("plain &lt; text &amp;\n more") == ["plain < text & more"]
    assert text('<script>var t="</p>";</script><p>a<b>b</b>c<br>d</p><style>x') == ["abc", "d"]
    assert text("<p>one<p>two<!-- <p>no</p> -->&eacute;</div></p>") == ["one", "twoé"]
    assert text('<a title="x>y">in</a> <td>1<td>2') == ["in", "1", "2"]
    assert len(text("<div>" * 5000 + "deep" + "<p>x</p>" * 3000)) == 3001


def page(rnd, k):
    words = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    paragraphs = [words(rnd.randrange(5, 40)) + "." for _ in range(rnd.randrange(2, 6))]
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return paragraphs, f"<html><head><title>{words(3)}</title></head><body><nav><ul><li><a href='/'>{words(1)}</a></li></ul></nav><div class=ad>{words(6)}</div><article>{body}</article><footer>&copy; {words(4)}</footer></body></html>"


def test_main_text_of_pages(spark):
    rnd = random.Random(5)
    made = [page(rnd, k) for k in range(120)]
    rows = [(k, f"u{k}", p) for k, (_, p) in enumerate(made)] + [(500, None, None), (501, "u", ""), (502, "u", "<script>x</script>"), (0, "u0", made[0][1])]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("own"))
    found = html_blocks.extract(frame).collect()
    right = sum(r["text"] == " ".join(made[r["id"]][0]) for r in found if r["id"] < 120)
    assert right >= 0.97 * 121 and len(found) == len(rows)
    assert {r["text"] for r in found if r["id"] >= 500} == {""}
    assert html_blocks.extract(frame.limit(0)).count() == 0


def test_other_page_layouts(spark):
    model = html_blocks.Labeller.load(html_blocks.fit(spark.createDataFrame([(k, page(random.Random(k), k)[1]) for k in range(200)], "page_id long, html string"), "page_id", "html"))
    story = ["The first paragraph of this story is long enough to be read as such.", "The second paragraph goes on for a while, as they do."]
    found = html_blocks.blocks(
        f"<body><header><a>Home</a><a>News</a></header><div class='cookie banner'>We use cookies.</div><div class='main content'><p>{story[0]}</p><p>{story[1]}</p></div>"
        "<aside class='sidebar'><ul><li><a>Other post</a></li></ul></aside><form><label>Your name</label></form>"
        "<section id='comments'><p>I think this text is wrong in many ways, really.</p></section><footer>&copy; us</footer></body>"
    )
    main = model.probabilities(html_blocks.inputs(found), np.array([len(found)])) >= 0.5
    assert [b.text for b, m in zip(found, main, strict=True) if m] == story
