import random

import pytest
from pyspark.sql import functions as F

from gleaner.llm import mixing


def slow_targets(sizes: dict, weights=(5, 2, 1), most=3):
    names = sorted((n for n in sizes if n is not None), key=lambda n: n.encode()) + [None] * (None in sizes)
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    target, full = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[n] for n in full)
        open_ = [n for n in names if n not in full]
        target = {n: most * sizes[n] for n in full} | {n: rest * weight[n] / sum(weight[m] for m in open_) for n in open_}
        over = {n for n in open_ if target[n] > most * sizes[n]}
        if not over:
            return target
        full |= over


def test_targets_and_sample(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * min(400, int(rng.paretovariate(0.9) * 5))), rng.choice(["a", "b", "Z", "é", None, "b", "b"])) for i in range(3000)] + [(9001, "tiny here", "zz"), (9002, None, "void"), (9003, " \n", "a"), (None, "x y z", "a"), (9010, "one two", "b"), (9010, "one two", "b")]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, source string, size int, q int")
    got = mixing.mix(docs).join(docs.select("doc_id", "source").distinct(), "doc_id", "left").collect()
    again = mixing.mix(docs.repartition(5)).collect()
    assert len(got) == len(rows) and sorted((str(r.doc_id), r.size, r.taken) for r in got) == sorted((str(r.doc_id), r.size, r.taken) for r in again)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = slow_targets(sizes)
    by_id = {k: s for k, _, s in rows}
    taken = {}
    for r in got:
        s = by_id[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and r.taken == r.size * r.copies and 0 <= r.copies <= 3
        taken[s] = taken.get(s, 0) + r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(30, 0.02 * want[s]), (s, taken[s], want[s])


def test_water_fill_caps(spark):
    parts = spark.createDataFrame([("a", 5, 6, 30), ("b", 2, 9, 30), ("c", 1, 90, 30)], "source string, weight long, cap long, total long")
    got = {r.source: r.out for r in mixing.water_fill(parts, [], "weight", "cap", "total", "out").collect()}
    assert got == {"a": 6.0, "b": 9.0, "c": 15.0}


def test_more_odds_are_taken_more_often(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', if(id % 2 = 0, 2, 200))").alias("text"), F.lit("a").alias("source"))
    both = docs.unionByName(docs.select((F.col("doc_id") + 4000).alias("doc_id"), "text", F.lit("b").alias("source"))).unionByName(docs.select((F.col("doc_id") + 8000).alias("doc_id"), "text", F.lit("c").alias("source")))
    rates = {r.size: r.m for r in mixing.mix(both).where("doc_id >= 8000").groupBy("size").agg(F.avg("copies").alias("m")).collect()}
    # copies go as the digits of the size in binary: 2 and 8
    assert rates[200] / rates[2] == pytest.approx(4, rel=0.15)


def test_no_rows_and_no_words(spark):
    kind = "doc_id long, text string, source string"
    assert mixing.mix(spark.createDataFrame([], kind)).count() == 0
    assert [(r.taken, r.target) for r in mixing.mix(spark.createDataFrame([(1, "", "a")], kind)).collect()] == [(0, 0.0)]
