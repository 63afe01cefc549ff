"""Admission of deliveries: the fold over parts against a plain loop, and a user with very many candidates."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gleaner.operators import notify

SCHEMA = "user_id string, order_id long, published_at timestamp, duplicate_fingerprint string, recent long, most int, cooldown boolean, similar_before boolean, quiet boolean"


def slow(rows):
    sent, prints, out = {}, {}, []
    for u, o, _, mark, recent, most, cooldown, similar, quiet in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        if most is not None and recent + sent.get(u, 0) >= most:
            out.append((u, o, "rate_limited"))
        elif similar or (cooldown and mark in prints.setdefault(u, set())):
            out.append((u, o, "similar_recently"))
        elif quiet:
            out.append((u, o, "deferred"))
        else:
            out.append((u, o, "send"))
            sent[u] = sent.get(u, 0) + 1
            if mark is not None:
                prints.setdefault(u, set()).add(mark)
    return sorted(out)


@pytest.mark.parametrize("part", [40, 1 << 18])
def test_as_decided_one_by_one(spark, part):
    draw, rows = random.Random(5), []
    for i in range(600):
        user = "hot" if i % 3 else draw.choice("abcdefgh")
        at = datetime(2024, 1, 1) + timedelta(minutes=draw.randrange(200))
        rows.append((user, i, at, draw.choice([None, *[f"f{k}" for k in range(60)]]), draw.randrange(3), draw.choice([None, None, 9, 40, 70]), draw.random() < 0.7, draw.random() < 0.1, draw.random() < 0.1))
    got = notify.admit(spark.createDataFrame(rows, SCHEMA), part)
    assert sorted(map(tuple, got.collect())) == slow(rows)


def test_no_candidates(spark):
    assert notify.admit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_user_with_a_million_candidates(spark):
    """A million rows of one user, in several parts; twice the rows take about twice the time."""

    def run(n):
        rows = spark.range(n).select(
            F.lit("u").alias("user_id"), F.col("id").alias("order_id"), F.expr("timestamp_seconds(1700000000 + id div 3)").alias("published_at"), (F.col("id") % (n // 2)).cast("string").alias("duplicate_fingerprint"),
            F.lit(0).cast("long").alias("recent"), F.when(F.col("id") < n // 4, F.lit(10)).cast("int").alias("most"), F.lit(True).alias("cooldown"), F.lit(False).alias("similar_before"),
        )
        began = time.time()
        got = {r["decision"]: r["n"] for r in notify.admit(rows).groupBy("decision").agg(F.count("*").alias("n")).collect()}
        # the first quarter sends ten, then all up to the half are new; after the half those of the first quarter that were held back
        assert got == {"rate_limited": n // 4 - 10, "send": 10 + n // 4 + n // 4 - 10, "similar_recently": n // 4 + 10}
        return time.time() - began

    small, large = run(500_000), run(1_000_000)
    assert large < 4 * small + 5
