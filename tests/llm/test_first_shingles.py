"""The shingles that open pairs: only those leave a task, and the order by shared counters is exact however few counters there are."""

import random

import pytest

from gleaner.llm import overlap

from test_overlap import boilerplate, planted, similarity


@pytest.mark.parametrize("slots", [16, 1 << 22])
def test_any_number_of_counters_is_exact(spark, monkeypatch, slots):
    monkeypatch.setattr(overlap, "SLOTS", slots)
    texts = boilerplate(20, 60, 30, seed=4) + planted(10)[:60]
    sets = {i: overlap.shingles(t) for i, t in enumerate(texts)}
    frame = spark.createDataFrame([(i, [int(x) for x in s.view("int64")]) for i, s in sets.items()], "fp long, shingles array<long>")
    rooted = spark.createDataFrame([(i, i) for i in sets], "fp long, root long")
    met = {(x.u, x.v) for x in overlap._pairs_outside(overlap.first_shingles(frame), rooted).collect()}
    want = {(i, j) for i in sets for j in sets if i < j and similarity(texts[i], texts[j]) >= 0.8}
    assert len(want) > 20 and want <= met


def test_only_what_opens_is_spelt_out(spark):
    """A large group of near copies: each keeps a fifth of its shared shingles at most, and none is joined with its frequency."""
    r = random.Random(5)
    words = [f"w{r.randrange(5000)}" for _ in range(200)]
    texts = [" ".join(x if r.random() > 0.005 else f"y{r.randrange(10**6)}" for x in words) for _ in range(100)]
    rows = [(i, [int(x) for x in overlap.shingles(t).view("int64")]) for i, t in enumerate(texts)]
    first = overlap.first_shingles(spark.createDataFrame(rows, "fp long, shingles array<long>"))
    assert "Join" not in first._jdf.queryExecution().executedPlan().toString()
    found = first.collect()
    assert {x.fp for x in found} and len(found) <= sum(len(s) // 5 + 1 for _, s in rows)
    assert all(x.left * 5 >= x.size * 4 for x in found)
