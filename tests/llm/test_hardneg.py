"""Hard negatives against brute force: ties, repeated ids, odd vectors; the intervals hold every score."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.llm import hardneg

KIND = "vec_id long, embedding array<float>, label int, score string, slot int"


def product(a, b):
    return sum(x * y for x, y in zip(a, b))


def brute(rows, every=50):
    use = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            use.append((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    out = []
    for i, label, q in {r for r in use if r[0] % every == 0}:
        near = sorted((-product(q, w), j) for j, other, w in use if other == label and j != i)[:5]
        for s, j in near:
            found = sorted((-product(q, w), n) for n, other, w in use if other != label and n != i and 50 * -s <= 100 * product(q, w) <= 95 * -s)[:3]
            out += [(i, j, rank, n, -s, -t) for rank, (t, n) in enumerate(found, 1)]
    return sorted(out)


def vectors():
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(4, 20))
    rows = []
    for i in range(600):
        c = int(rng.integers(4))
        rows.append((i, [float(x) for x in (centers[c] + rng.normal(size=20)) / 3], c))
    rows += [(9, rows[10][1], 1), (700, rows[50][1], None), (750, None, 1), (800, [1.0, None], 1), (850, [float("nan")] * 20, 1), (900, [], 1),
             (950, [0.0] * 20, 2), (1000, [float("inf")], 3), (None, [1.0], 1), (1050, [5.0] * 3, 2), (50, rows[50][1], rows[50][2]), (100, rows[7][1], 3)]
    rows += [(1100 + i, rows[200][1], 3) for i in range(30)]  # ties
    return rows


@pytest.mark.parametrize("per_anchor_block", [256, 3])
def test_mining(spark, per_anchor_block):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], KIND).repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = hardneg.hard_negatives(hardneg.quantised(df, label), F.col("vec_id") % 50 == 0, per_anchor_block=per_anchor_block)
    got = sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in out.collect())
    want = brute(rows)
    assert len(want) > 50 and got == want


def test_empty_and_too_large(spark):
    none = hardneg.quantised(spark.createDataFrame([], KIND), F.col("label"))
    assert hardneg.hard_negatives(none, F.col("vec_id") % 50 == 0).count() == 0
    big = hardneg.quantised(spark.createDataFrame([(0, [3e7], 1, "", 0), (1, [3e7], 1, "", 0)], KIND), F.col("label"))
    with pytest.raises(ValueError):
        hardneg.hard_negatives(big, F.col("vec_id") % 50 == 0)


@pytest.mark.parametrize("size,width", [(64, 1), (64, 20), (64, 64), (256, 200)])
def test_intervals_hold(size, width):
    rng = np.random.default_rng(width)
    m = rng.integers(-300, 300, (400, width))
    m[0], m[1] = 0, m[2]
    block = hardneg.Codes.of(np.arange(400), np.arange(400) % 3, m, size)
    for q in (*rng.integers(-300, 300, (20, width)), m[5], np.zeros(width, np.int64)):
        low, high = block.interval(q)
        score = block.m @ q
        assert (low <= score).all() and (score <= high).all()
        a, b = block.of_label(1)
        assert set(block.labels[a:b]) == {1} and b - a == 133
        assert np.array_equal(block.interval(q, a, b)[0], low[a:b])
        assert np.array_equal(block.scores(np.arange(400), q << 36), block.scores(np.arange(400), q) << 36)  # beyond 2^53


def test_search_skips_rows():
    rng = np.random.default_rng(1)
    center = rng.normal(size=64) * 60
    m = np.rint(np.concatenate([center + rng.normal(size=(50, 64)) * 3, rng.normal(size=(5000, 64)) * 60])).astype(np.int64)
    block = hardneg.Codes.of(np.arange(5050), np.zeros(5050, np.int64), m, 64)
    scored = []
    block.scores = lambda rows, q: scored.append(len(rows)) or m[rows] @ q
    anchor = {"q": m[0], "label": 0, "anchor_id": 0, "key": 1}
    got = list(hardneg.positives_in(block, anchor, 5))
    want = np.lexsort((np.arange(1, 5050), -(m[1:] @ m[0])))[:5] + 1
    assert [r[2] for r in got] == want.tolist() and sum(scored) < 1000
