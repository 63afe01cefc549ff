"""Blocked vector pairs against all pairs: chunks, ties, copies, and vectors that take no part."""

import math
import random

import pytest

from gleaner.operators import semantic

SCHEMA = "k long, v array<float>, b string, similarity int"


def rows():
    draw = random.Random(7)
    out = [(i, [draw.choice([-1.0, 0.5, 2.0, 0.25]) for _ in range(5)], "hot" if i % 3 else "b", 1) for i in range(90)]
    out += [(200 + i, [1.0, 2.0, 0.0, 0.0, 1.0], "hot", 1) for i in range(12)]  # copies: ties go to the least key
    odd = [(300, None, "hot", 1), (301, [0.0] * 5, "hot", 1), (302, [1.0, None, 0.0, 0.0, 0.0], "hot", 1), (303, [math.nan] * 5, "hot", 1), (304, [math.inf] + [0.0] * 4, "hot", 1)]
    return out, odd + [(305, [1.0] * 5, None, 1), (None, [1.0] * 5, "hot", 1), (306, [1.0, 2.0], "hot", 1)]


def slow(data, least, most):
    cos = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True)) / (math.sqrt(sum(p * p for p in x)) * math.sqrt(sum(q * q for q in y)))
    out = []
    for k, v, b, _ in data:
        met = sorted((-cos(v, w), o) for o, w, c, _ in data if c == b and o != k)
        met = [(o, -s) for s, o in met if least is None or -s >= least][:most]
        out += [(k, o, s) for o, s in met]
    return sorted(out)


@pytest.mark.parametrize("chunk", [1000, 7])
@pytest.mark.parametrize(("least", "most"), [(None, 3), (0.8, None), (0.5, 2)])
def test_pairs_equal_brute_force(spark, chunk, least, most):
    good, odd = rows()
    got = semantic.similar_pairs(spark.createDataFrame(good + odd, SCHEMA), "k", "v", "b", least, most, chunk)
    assert sorted((r.k, r.other, r["similarity"]) for r in got.collect()) == slow(good, least, most)


def test_no_vectors_no_pairs(spark):
    assert semantic.similar_pairs(spark.createDataFrame([], SCHEMA), "k", "v", "b", most=3).collect() == []
