"""Quantiles from buckets, sustained alerts, ranks without a task for each key, vectors from slots."""

import hashlib
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gleaner.operators import activity, ml, semantic

INF = float("inf")


@pytest.mark.parametrize(
    ("counts", "p", "want"),
    [([2, 6, 10, 10], 0.5, 1.75), ([2, 6, 10, 10], 0.1, 0.5), ([2, 6, 10, 10], 1.0, 3.0), ([0, 0, 0, 4], 0.5, 3.0), ([0, 0, 0, 0], 0.5, None), ([4, 4, 4, 8], 0.5, 1.0), ([0, 4, 4, 4], 0.25, 1.25)],
)
def test_quantile_within_its_bucket(spark, counts, p, want):
    rows = spark.createDataFrame([("m", le, n) for le, n in zip([1.0, 2.0, 3.0, INF], counts)], "metric string, le double, n long")
    assert activity.histogram_quantile(rows, p, "metric").first()["quantile"] == want


def test_quantile_needs_the_last_bucket(spark):
    assert activity.histogram_quantile(spark.createDataFrame([(1.0, 3)], "le double, n long"), 0.5).first()["quantile"] is None
    low = spark.createDataFrame([(-1.0, 4), (INF, 4)], "le double, n long")
    assert activity.histogram_quantile(low, 0.5).first()["quantile"] == -1.0


def test_sustained_alerts(spark):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    high = [*range(0, 12), *range(13, 20), 30, 31, *range(40, 51)]  # 12 fails, 51 and on are missing
    rows = [("a", at(m), 9.0 if m in high else 1.0) for m in range(51)] + [("b", at(m), 9.0) for m in range(0, 60, 2)] + [("c", at(m), None) for m in range(60)]
    got = activity.sustained(spark.createDataFrame(rows, "metric string, at timestamp, v double"), F.col("v") > 5, 60, 600).collect()
    assert sorted(map(tuple, got)) == [("a", at(0), at(10), at(11), 12), ("a", at(40), at(50), at(50), 11)]


def test_ranks(spark):
    draw = random.Random(1)
    rows = [("hot" if i % 3 else draw.choice("abc"), draw.randrange(10**9)) for i in range(2000)]
    got = ml.ranked(spark.createDataFrame(rows, "k string, v long").repartition(7), "k", "v")
    want = []
    for k in {k for k, _ in rows}:
        mine = sorted(v for x, v in rows if x == k)
        want += [(k, v, i + 1, len(mine)) for i, v in enumerate(mine)]
    assert sorted((r.k, r.v, r.place, r.size) for r in got.collect()) == sorted(want)
    assert ml.ranked(spark.createDataFrame([], "k string, v long"), "k", "v").count() == 0


def test_vectors_from_slots(spark):
    draw = random.Random(2)
    rows = [(i, [draw.choice(["сайт", "бот", "a", "b", *map(str, range(300))]) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 50, 4000])]
    frame = spark.createDataFrame(rows, "k long, tokens array<string>")
    got = {r.k: r.vector for r in semantic.hashed_vectors(frame, "k", "tokens", 64).collect()}
    assert 0 not in got
    for k, tokens in rows[1:]:
        v = [0.0] * 64
        for t in tokens:
            h = hashlib.sha256(t.encode()).hexdigest()
            v[int(h[:8], 16) % 64] += 1.0 if int(h[9], 16) % 2 == 0 else -1.0
        norm = math.sqrt(sum(x * x for x in v)) or 1.0
        assert got[k] == [x / norm for x in v]
    plain = {r.k: r.v for r in frame.select("k", semantic.hash_embedding(F.col("tokens"), 64).alias("v")).collect()}
    assert all(got[k] == plain[k] for k in got) and plain[0] == [0.0] * 64


def test_backfill_counts(spark):
    rows = [("a", "нужен сайт", None), ("b", None, None), ("c", "x", [1.0] * 8), ("d", "y", [1.0] * 3)]
    orders = spark.createDataFrame(rows, "order_id string, title string, embedding array<float>").withColumns({c: F.lit(None).cast("string") for c in ("project_type", "summary", "deadline_text")})
    assert tuple(semantic.backfill_counts(orders, 8).first()) == (4, 2, 1, 2, 1)
    got = {r.order_id: r.embedding for r in semantic.embed_orders(orders, dimension=8).collect()}
    assert got["b"] == [0.0] * 8 and sum(x * x for x in got["a"]) == pytest.approx(1) and got["d"] == [1.0] * 3
