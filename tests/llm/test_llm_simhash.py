"""SimHash classes against a pairwise comparison, and the rows that are kept."""

import random

import pytest
import xxhash

import reportmill.llm.components as links
from reportmill.llm import simhash
from reportmill.llm.components import components
from reportmill.session import materialise

SCHEMA = "doc_id long, text string"


def fingerprint(text, n=4):
    words = [w.encode() for w in (text or "").split()]
    words = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


def classes(rows):
    prints = [fingerprint(t) for _, t in rows]
    near = {i: {j for j in range(len(rows)) if (prints[i] ^ prints[j]).bit_count() <= 4} for i in range(len(rows))}
    out = []
    for i, (doc, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((doc, prints[i], min(ids) if ids else None))
    return sorted(out, key=str)


def texts(seed=1):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 8))) for _ in range(400)]
    rows = []
    for i in range(60):
        words = [rnd.choice(vocabulary) for _ in range(rnd.choice([1, 3, 4, 5, 50, 300]))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(rnd.randrange(4)):
            changed = list(words)
            changed[rnd.randrange(len(words))] = "new"
            rows.append((len(rows), "\n".join(changed).upper()))
    return rows


def test_classes_match_pairs(spark):
    rows = [*texts(), (900, None), (901, ""), (902, " \n\t "), (903, "a b c"), (903, "a b c"), (None, "a b c"), (None, "quite alone here"), (904, "x " * 30000)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    got = sorted([(r["id"], r["fp"] % 2**64, r["component_id"]) for r in found], key=str)
    assert got == classes(rows)


def test_columns_and_empty_tables(spark):
    odd = spark.createDataFrame([(1, "a b", 5, "z")], "doc_id long, text string, fp int, id string")
    assert simhash.near_duplicates(odd).count() == 1
    assert simhash.keep_first(odd).columns == odd.columns
    none = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(none).count() == simhash.keep_first(none).count() == 0


def test_every_close_pair_is_found_once(spark):
    rnd = random.Random(3)
    values = {rnd.getrandbits(64) for _ in range(50)}
    for v in list(values):
        for bits in range(1, 7):
            w = v
            for b in rnd.sample(range(64), bits):
                w ^= 1 << b
            values.add(w)
    signed = [v - 2**64 if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = [(r["a"], r["b"]) for r in simhash.close_pairs(frame).collect()]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 4}
    assert len(got) == len(set(got)) and set(got) == want


def test_grown_sides_are_not_sent(spark, monkeypatch):
    """Fingerprints grow by the number of choices: no broadcast of them, however small their table looks."""
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    plans = []

    def seen(df, name):
        plans.append(plan(df))
        return materialise(df, name)

    pairs = simhash.close_pairs(spark.createDataFrame([(1,), (3,), (2**40,)], "fp long"))
    assert [(r["a"], r["b"]) for r in pairs.collect()].count((1, 3)) == 1 and "Broadcast" not in plan(pairs)
    for module in (simhash, links):
        monkeypatch.setattr(module, "materialise", seen)
        monkeypatch.setattr(module, "MAX_SENT", 0)
    rows = texts(2)
    found = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA))
    got = sorted([(r["id"], r["fp"] % 2**64, r["component_id"]) for r in found.collect()], key=str)
    assert got == classes(rows)
    assert len(plans) > 5 and not any("Broadcast" in p for p in [*plans, plan(found)])


@pytest.mark.parametrize("edges", [[], [(1, 1), (None, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51), (52, 51)]])
def test_components(spark, edges):
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges if None not in e and e[0] != e[1] for n in e}
    for _ in edges:
        for a, b in edges:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_near_copies_leave_one_row(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    base = [rnd.sample(words, 300) for _ in range(12)]
    rows = []
    for k, b in enumerate(base):
        rows.append((k, " ".join(b)))
        for copy in range(5):
            changed = list(b)
            changed[rnd.randrange(300)] = f"x{copy}"
            rows.append((100 + 10 * k + copy, " ".join(changed)))
    rows += [(500, None), (501, ""), (502, "short one"), (502, "short one")]
    got = sorted(r["doc_id"] for r in simhash.keep_first(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [*range(12), 500, 502]


def strangers_and_pairs(n=2000, size=400, pairs=40, share=0.06):
    """Words of pairs of near copies, and of texts that have nothing in common."""
    rnd = random.Random(11)
    out = []
    for i in range(pairs):
        words = [f"p{i}_{j}" for j in range(size)]
        changed = list(words)
        for at in rnd.sample(range(size), int(size * share / 3)):
            changed[at] = "other"
        out += [words, changed]
    return out + [[f"s{i}_{j}" for j in range(60)] for i in range(n)]


def near_pairs(prints, max_bits=62):
    import numpy as np

    bits = np.array(prints, np.int64).view(np.uint64)
    return {(i, j) for i in range(len(bits)) for j in (np.flatnonzero(np.bitwise_count(bits[i + 1 :] ^ bits[i]).sum(axis=1) <= max_bits) + i + 1).tolist()}


def test_near_copies_among_strangers_with_least_fingerprints(spark):
    """A bucket's members are compared with each other, not with its least member only."""
    import numpy as np

    rnd = np.random.default_rng(2)
    bits = rnd.integers(0, 2**63, (300, 6), np.uint64)
    for i in range(0, 300, 2):  # pairs whose bits differ in 60 of 384 places, in any table
        flips = np.zeros(6, np.uint64)
        for at in rnd.choice(384, 60, replace=False).tolist():
            flips[at // 64] |= np.uint64(1 << at % 64)
        bits[i + 1] = bits[i] ^ flips
    rows = [(i, bytearray(bits[i].tobytes()), [7]) for i in range(300)]  # one bucket of 150 strange pairs
    frame = spark.createDataFrame(rows, "k long, bits binary, bands array<long>")
    want = {(i, i + 1) for i in range(0, 300, 2)}
    for tile in (4096, 37):
        got = {(min(r), max(r)) for r in simhash.similar_links(frame, 62, tile).collect()}
        assert got == want


def test_recall_of_candidates_does_not_depend_on_strangers(spark):
    """All texts within the limit fall in one group, also where single fingerprints differ in more than 12 bits."""
    words = strangers_and_pairs()
    prints = [simhash.text_fingerprints(" ".join(w), 5, 6) for w in words]
    near = near_pairs(prints)
    assert len(near) >= 20 and any(all(((prints[a][t] ^ prints[b][t]) % 2**64).bit_count() > 6 for t in range(6)) for a, b in near)
    rows = [(i, " ".join(w)) for i, w in enumerate(words)]
    kept = {r["doc_id"] for r in simhash.keep_first(spark.createDataFrame(rows, SCHEMA), max_bits=62).collect()}
    assert {i for i in range(len(rows))} - kept == {b for _, b in near}


def test_limit_of_bits_against_shingle_sets():
    """Of pairs whose sets of 5-word shingles are just 0.8 alike more than four in five lie within MAX_BITS; pairs of 0.5 hardly ever do."""
    import numpy as np

    rnd = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    within = {0.8: [], 0.5: []}
    for _ in range(300):
        text = rnd.choices(words, k=400)
        for like, found in within.items():
            other = list(text)
            whole = set(simhash._shingles(" ".join(text), 5).tolist())
            for at in rnd.sample(range(400), 400):  # change words until the sets are no more alike than that
                before = list(other)
                other[at] = rnd.choice(words)
                own = set(simhash._shingles(" ".join(other), 5).tolist())
                if len(whole & own) < like * len(whole | own):
                    other = before
                    break
            prints = [np.array(simhash.text_fingerprints(" ".join(t), 5, 6), np.int64).view(np.uint64) for t in (text, other)]
            found.append(int(np.bitwise_count(prints[0] ^ prints[1]).sum()) <= simhash.MAX_BITS)
    assert np.mean(within[0.8]) > 0.8 and np.mean(within[0.5]) < 0.02
