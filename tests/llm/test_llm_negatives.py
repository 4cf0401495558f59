"""Hard negatives, against all pairs."""

import math

import numpy as np
import pytest

from reportmill.llm import negatives

ROWS = "vec_id long, embedding array<float>, label int"


def brute(rows, asks, least=50, most=95):
    kept = {}
    for i, vector, label in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        v = tuple(math.floor(256 * float(np.float32(x))) for x in vector)
        kept[i, label, v] = None
    kept = list(kept)
    dot = lambda a, b: sum(x * y for x, y in zip(a[2], b[2]))
    out = []
    for a in kept:
        if not asks(a[0]):
            continue
        order = lambda found: sorted((-dot(a, b), b[0]) for b in found)
        others = [b for b in kept if b != a]
        for p, positive in order(b for b in others if b[1] == a[1])[:5]:
            hard = [x for x in order(b for b in others if b[1] != a[1]) if least * -p <= 100 * -x[0] <= most * -p][:3]
            out += [(a[0], positive, k + 1, x[1], -p, -x[0]) for k, x in enumerate(hard)]
    return sorted(out)


def found(frame, **more):
    return sorted(tuple(r) for r in negatives.mine(frame, lambda i: i % 5 == 0, **more).collect())


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK", block)
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(4, 20)) * 0.3
    rows = [(i, [float(x) for x in centres[i % 4] + rng.normal(size=20) * (0.05 if i % 3 else 0.6)], int(rng.choice([0, 0, 0, 1, 2]))) for i in range(160)]
    rows += [(200 + i, rows[7][1], i % 3) for i in range(30)]  # ties
    rows += rows[:9]  # repeated rows
    rows += [(5, [float("nan")] * 20, 0), (10, None, 0), (15, [0.1, None], 0), (20, rows[3][1], None), (None, rows[3][1], 0), (301, [float("inf")], 0)]
    rows += [(400, [], 0), (405, [0.5] * 7, 1), (410, [0.25] * 33, 2), (415, [0.0] * 20, 0), (415, [0.125] * 20, 1)]  # lengths, zeros, one id with two vectors
    got = found(spark.createDataFrame(rows, ROWS).repartition(3))
    assert got == brute(rows, lambda i: i % 5 == 0) and got


def test_bounds_hold_on_all_levels():
    rng = np.random.default_rng(2)
    rows = [rng.integers(-200, 200, n) for n in (64, 64, 61, 9, 8, 1, 0, 64)]
    ends = np.append(0, np.cumsum([len(r) for r in rows]))
    mean, deviation, first = negatives.summaries(np.concatenate(rows), ends)
    cut = lambda x: [x[a:b].tolist() for a, b in zip(first, first[1:])]
    table = negatives.pa.table({"id": list(range(8)), "row": [0] * 8, "label": ["a"] * 8, "v": negatives.pa.array([r.tolist() for r in rows], negatives.pa.list_(negatives.pa.int64())), "mean": cut(mean), "deviation": cut(deviation)})
    block = negatives.Vectors(table, 64)
    exact = block.v @ block.v.T
    widths = []
    for m, d in block.levels:
        middle, reach = m @ m.T, d @ d.T + 1e-6
        assert (middle - reach <= exact).all() and (exact <= middle + reach).all()
        widths.append(reach.mean())
    assert [m.shape[1] for m, _ in block.levels] == [1, 2, 4, 8] and widths == sorted(widths, reverse=True)


def test_large_components(spark):
    rows = [(i, [1e6 * (i + 1), -1e6], 0 if i < 4 else 1) for i in range(12)]
    assert found(spark.createDataFrame(rows, ROWS)) == brute(rows, lambda i: i % 5 == 0)


def test_clashing_columns_and_nothing(spark):
    rows = [(i, [0.1 * i, 0.2], i % 2, i, "x") for i in range(12)]
    frame = spark.createDataFrame(rows, ROWS + ", row int, part string")
    assert found(frame) == brute([r[:3] for r in rows], lambda i: i % 5 == 0)
    assert found(frame.limit(0)) == []
    assert found(frame.filter("label = 0")) == []
