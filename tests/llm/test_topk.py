import math
import random

import numpy as np

from gleaner.llm import topk


def brute(rows, k, step):
    ok = [(i, r, [math.floor(64 * c) for c in v]) for r, (i, v) in enumerate(rows) if i is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for i, r, q in ok:
        if i % step == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, s, v in ok if s != r)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return sorted(out)


def test_as_scored_slowly(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 8)
    monkeypatch.setattr(topk, "SHARD", 32)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, rng.gauss(0, 1)]) for _ in range(6)]) for i in range(300)]
    rows += [(7, None), (8, []), (9, [1.0, None]), (10, [float("nan")] * 6), (20, [float("inf")] * 6), (40, [2.0, 1.0]), (60, rows[0][1]), (61, rows[0][1]), (None, rows[0][1]), (500, [100.0] * 6)]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, id int, row string")
    for k in (3, 500):
        got = topk.search(frame, "id % 20 = 0", k).collect()
        assert sorted(map(tuple, got)) == brute(rows, k, 20)


def test_blocks_of_grouped_vectors_are_pruned():
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 64, (40, 32))
    group = np.sort(rng.integers(0, 40, 4000))  # vectors of a group lie together
    vectors = np.floor(centres[group] + rng.normal(0, 6, (4000, 32)))
    shard = topk.Shard(np.arange(4000), np.arange(4000), vectors)
    asked = vectors[::50]
    kth = np.array([np.sort(q @ vectors.T)[-20] for q in asked])
    assert shard.reached(asked, kth) < 0.25
    found = shard.search(asked, np.full(len(asked), -1), np.full(len(asked), -np.inf), 20)
    for q, (ids, scores) in zip(asked, found, strict=True):
        want = sorted(zip(-(q @ vectors.T), range(4000), strict=True))[:20]
        assert [(-s, i) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)] == want


def test_none(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(frame, "id % 20 = 0", 20).count() == 0
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert topk.search(one, "id % 20 = 0", 20).count() == 0
    odd = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert topk.search(odd, "id % 20 = 0", 20).count() == 0
