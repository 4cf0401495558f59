"""Divergence of sources, against counters and against all dominators."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from reportmill.llm import divergence

DOCS = "doc_id long, text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, k):
    docs = [(lang or "", source or "", terms(text)) for _, text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(t for d in own for t in set(d[2]))
        kept = sorted((t for t in held if held[t] >= 3), key=lambda t: t.encode())
        said = {s: Counter(t for d in own if d[1] == s for t in d[2] if held[t] >= 3) for s in {d[1] for d in own}}
        whole = sum(said.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        shares, q = {s: share(c) for s, c in said.items()}, share(whole)
        far = lambda p, q: (p - q) * (p - q) // q
        for s, p in shares.items():
            pairs = [(-sum(far(p[t], shares[o][t]) for t in kept), o.encode(), o) for o in shares if o != s]
            best = [(-far(p[t], q[t]), t.encode(), t) for t in kept if said[s][t] and p[t] > q[t]]
            for part, found, n in (("pair", pairs, len(pairs)), ("term", best, k)):
                out |= {(lang, s, part, x[2], -x[0], i + 1) for i, x in enumerate(sorted(found)[:n])}
    return out


def corpus(rnd, n):
    words = ["".join(rnd.choice("abcéßω") for _ in range(rnd.randrange(1, 4))) for _ in range(150)]
    draw = lambda: words[min(int(rnd.expovariate(0.03)), len(words) - 1)].upper() if rnd.random() < 0.1 else words[min(int(rnd.expovariate(0.03)), len(words) - 1)]
    rows = []
    for k in range(n):
        lang = rnd.choice(["en", "en", "fr", None, ""])
        source = rnd.choice(["s1", "s1", "s1", "s2", "s3", "ü", None])
        rows.append((k, rnd.choice([" ", "\n", "1-", "\x00"]).join(draw() for _ in range(rnd.randrange(80))), lang, source))
    return rows + [(900, None, "en", "empty"), (901, "", "alone", "one"), (902, "😀 a", "alone", "one"), (903, "12", "none", "a"), (904, None, "none", "b")]


def listed(found):
    rows = [tuple(r) for r in found.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_against_counters(spark, monkeypatch):
    rnd = random.Random(3)
    rows = corpus(rnd, 300)
    rows += rows[:20]
    frame = spark.createDataFrame(rows, DOCS).repartition(5)
    for k, block in ((200, 1 << 16), (4, 40)):
        monkeypatch.setattr(divergence, "BLOCK_ROWS", block)
        monkeypatch.setattr(divergence, "CELLS", block)
        assert listed(divergence.audit(frame, k=k)) == brute(rows, k)


def test_sums_pass_on_in_parts(spark, monkeypatch):
    rnd = random.Random(4)
    rows = corpus(rnd, 100)
    monkeypatch.setattr(divergence, "GATHERED", 30)
    monkeypatch.setattr(divergence, "STRETCH", 200)
    assert listed(divergence.audit(spark.createDataFrame(rows, DOCS), k=10)) == brute(rows, 10)


def test_terms_of_sliced_texts():
    texts = ["", "Ab é", "", "b-B", "x", "ünï 1y", ""]
    array = pa.array(texts)
    for a in range(len(texts) + 1):
        for b in range(a, len(texts) + 1):
            found, owner = divergence.terms(array.slice(a, b - a))
            assert [(x.decode(), int(o)) for x, o in zip(found.to_pylist(), owner, strict=True)] == [(t, i) for i, x in enumerate(texts[a:b]) for t in terms(x)]


def test_skyband_of_a_group():
    rng = np.random.default_rng(1)
    for size, k, step in ((400, 7, 64), (900, 3, 500), (50, 200, 16)):
        n, total = rng.integers(1, 9, size), rng.integers(1, 40, size)
        names = rng.permutation([f"t{i:04d}é" for i in range(size)])
        order = sorted(range(size), key=lambda i: (-n[i], total[i], names[i]))
        n, total, names = n[order], total[order], [str(names[i]) for i in order]
        above = [sum(n[j] >= n[i] and total[j] <= total[i] and names[j] < names[i] for j in range(size)) for i in range(size)]
        band = divergence._Band(k)
        got = np.concatenate([band.take(n[a : a + step], total[a : a + step], pa.array(names[a : a + step])) for a in range(0, size, step)])
        assert got.tolist() == [x < k for x in above]


def test_clashing_columns_and_nothing(spark):
    rows = [(k, "a b b", "en", f"s{k % 2}", 1, "x") for k in range(8)]
    frame = spark.createDataFrame(rows, DOCS + ", n int, term string")
    assert listed(divergence.audit(frame)) == brute([r[:4] for r in rows], 200)
    assert divergence.audit(frame.limit(0)).count() == 0
