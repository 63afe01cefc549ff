import math
import random

import numpy as np
from pyspark.sql import functions as F

from gleaner.llm import negatives


def brute(rows, step, k=5, m=5, share=(80, 100), scale=256):
    ok = [(i, r, [math.floor(scale * c) for c in v], label) for r, (i, v, label) in enumerate(rows) if i is not None and label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, r, q, label in ok:
        if i % step:
            continue
        scored = [(-sum(a * b for a, b in zip(q, v)), j, s, other) for j, s, v, other in ok]
        positives = sorted(x for x in scored if x[3] == label and x[2] != r)[:m]
        for p, j, _, _ in positives:
            fits = sorted(x[:2] for x in scored if x[3] != label and share[0] * -p <= share[1] * -x[0] <= share[1] * -p)[:k]
            out += [(i, j, n + 1, b, -p, -a) for n, (a, b) in enumerate(fits)]
    return sorted(out)


def mined(spark, rows, step, k=5, m=5):
    frame = spark.createDataFrame([(i, v, label, 5, "x") for i, v, label in rows], "vec_id long, embedding array<double>, label int, row int, slots string")
    got = negatives.mine(frame, F.col("vec_id") % step == 0, positives=m, negatives=k)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, got.collect()))


ODD = [(500, None, 1), (510, [None, 1.0], 1), (520, [float("nan")] * 4, 1), (530, [float("inf")] * 4, 2), (540, [2.0, 1.0], 2), (None, [1.0] * 4, 1), (550, [1.0] * 4, None), (560, [], 1)]


def test_as_mined_slowly(spark, monkeypatch):
    monkeypatch.setattr(negatives, "CHUNK", 40)
    monkeypatch.setattr(negatives, "GROUP", 7)
    monkeypatch.setattr(negatives, "AT_ONCE", 3)
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, rng.gauss(0.3, 1)]) for _ in range(4)], rng.choice([1, 1, 1, 2, 3])) for i in range(240)]
    rows += [*ODD, (20, rows[20][1], 2), (20, rows[20][1], 1), (21, rows[20][1], 1)]
    want = brute(rows, 10)
    assert len(want) > 100
    assert mined(spark, rows, 10) == want
    assert mined(spark, rows, 10, k=2, m=9) == brute(rows, 10, k=2, m=9)


def test_copies_and_equal_limits(spark, monkeypatch):
    monkeypatch.setattr(negatives, "CHUNK", 16)
    rows = [(i, [1.0, 0.5], 1 + (i % 3 == 0)) for i in range(100)] + [(100 + i, [0.9, 0.5 + i / 100], 3) for i in range(30)]
    assert mined(spark, rows, 10) == brute(rows, 10)


def test_none(spark):
    assert mined(spark, [], 10) == []
    assert mined(spark, ODD[:4], 10) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1)], 10) == []  # no other label
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 2)], 10) == []  # no positive
    assert mined(spark, [(0, [1.0], 1), (1, [-1.0], 1), (2, [-1.0], 2)], 10) == []  # a negative limit


def test_large_scores_are_exact():
    a, b = np.array([[2**40 + 1, 3]]), np.array([[2**20 + 1, 5], [7, -(2**50)]])
    assert negatives.product(a, b).tolist() == [[(2**40 + 1) * (2**20 + 1) + 15, (2**40 + 1) * 7 - 3 * 2**50]]
