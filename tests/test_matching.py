"""Orders against many subscriptions: pointless ones are left out, each way of meeting gives the same pairs."""

import pytest
from pyspark.sql import functions as F

from gleaner.operators import notify

SUB = "subscription_id long, user_id long, created_at timestamp, enabled boolean, min_relevance_score int, project_types array<string>, budget_min decimal(14,2), budget_max decimal(14,2), currencies array<string>, source_ids array<long>, positive_keywords array<string>, negative_keywords array<string>, freshness_days int"
ORDER = "order_id long, source_id long, project_type string, title string, summary string, normalized_text string, relevance_score int, budget_from decimal(14,2), budget_to decimal(14,2), budget_currency string, published_at timestamp"


def made(spark):
    k, text = F.col("id"), lambda n, *given: F.when(k % n == 0, F.array(*map(F.lit, given)))
    whole = lambda c: c.cast("int")
    subs = spark.range(400).select(
        k.alias("subscription_id"), (k % 3).alias("user_id"), F.timestamp_seconds(k % 5).alias("created_at"), (k % 17 > 0).alias("enabled"), F.when(k % 23 > 0, whole(k * 7 % 50 + 20)).alias("min_relevance_score"), text(5, "a", "b").alias("project_types"),
        F.when(k % 19 > 0, (k * 13 % 40).cast("decimal(14,2)")).alias("budget_min"), F.when(k % 2 == 0, (k * 13 % 40 + 30).cast("decimal(14,2)")).alias("budget_max"), text(4, "usd").alias("currencies"), F.when(k % 7 == 0, F.array(k % 11)).alias("source_ids"),
        text(13, "one", "Two").alias("positive_keywords"), text(6, "three").alias("negative_keywords"), F.when(k % 9 == 0, whole(k % 4)).alias("freshness_days"),
    )
    at = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), whole(k % len(values) + 1))
    orders = spark.range(120).select(
        k.alias("order_id"), (k % 12).alias("source_id"), at("a", "c", None, "b", "a").alias("project_type"), at("one", "four", "two three").alias("title"), F.lit(None).cast("string").alias("summary"), F.lit("").alias("normalized_text"), F.when(k % 29 > 0, whole(k * 11 % 90)).alias("relevance_score"),
        F.when(k % 8 > 0, (k * 17 % 60).cast("decimal(14,2)")).alias("budget_from"), F.when(k % 3 == 0, (k * 17 % 60 + 9).cast("decimal(14,2)")).alias("budget_to"), at("usd", "eur", None, "USD").alias("budget_currency"), F.timestamp_seconds(864000 - k * 3600 * 2).alias("published_at"),
    )
    return spark.createDataFrame(subs.collect(), SUB), spark.createDataFrame(orders.collect(), ORDER)


def brute(subs, orders, now):
    out = {}
    for o in orders:
        low, high = o.budget_from, o.budget_to
        amount = (low + high) / 2 if low is not None and high is not None else (low or high or None)
        words = " ".join(x or "" for x in (o.title, o.summary, o.normalized_text)).lower()
        for s in sorted((s for s in subs if s.enabled), key=lambda s: (s.created_at, s.subscription_id)):
            least = lambda limit, x: limit is None or (x is not None and x >= limit)
            listed = lambda values, x: not values or x in values
            fits = least(s.min_relevance_score, o.relevance_score) and least(s.budget_min, amount) and (s.budget_max is None or (amount is not None and amount <= s.budget_max))
            fits = fits and (s.freshness_days is None or o.published_at.timestamp() >= now - s.freshness_days * 86400) and listed(s.project_types, o.project_type) and listed(s.source_ids, o.source_id)
            fits = fits and listed([c.upper() for c in s.currencies or []], (o.budget_currency or "").upper() or None)
            fits = fits and not any(w in words for w in s.negative_keywords or []) and (not s.positive_keywords or any(w.lower() in words for w in s.positive_keywords))
            if fits:
                out.setdefault((o.order_id, s.user_id), s.subscription_id)
    return out


@pytest.mark.parametrize("limits", [{}, {"CHUNK": 20}, {"CHUNK": 20, "FEW": 0}, {"CHUNK": 20, "FEW": 0, "WIDE": 0}])
def test_each_way_of_meeting_gives_the_first_that_fits(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(notify, name, value)
    subs, orders = made(spark)
    got = notify.match_pairs(orders, subs, F.timestamp_seconds(F.lit(864000)), compose=False)
    want = brute(subs.collect(), orders.collect(), 864000)
    assert {(r.order_id, r.user): r.id for r in got.select("order_id", F.col("subscription.user_id").alias("user"), F.col("subscription.subscription_id").alias("id")).collect()} == want and len(want) > 200


def test_what_an_earlier_subscription_covers_is_left_out(spark):
    subs, _ = made(spark)
    more = subs.unionByName(subs.withColumns({"subscription_id": F.col("subscription_id") + 1000, "created_at": F.timestamp_seconds(F.lit(99))}))
    count = lambda rows: notify.without_pointless(notify.stored(notify._limits(rows), "limits")).count()
    assert count(more) == count(subs) < 200
