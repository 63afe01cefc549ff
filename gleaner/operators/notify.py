"""Matching orders to subscriptions, quiet hours, rate limits, cooldowns and deferred deliveries."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import normalize_text
from gleaner.operators.semantic import representative_budget
from gleaner.sources.scratch import dropped, stored

#: Candidates that one task decides one after the other, about.
PART = 1 << 18

#: Up to so many subscriptions that name sources, and so many of the others, are broadcast to the orders; more are shuffled by key.
FEW, WIDE = 20_000, 200_000
#: Subscriptions of a user that are held against each other at a time, to leave out those that can never be the first to fit.
CHUNK = 4096
#: Orders of a task that collects what fits them, about.
ORDERS = 1 << 15
#: Wide enough for the mean of two amounts of decimal(14,2).
MONEY = "decimal(18,4)"
LISTS = ("types", "sources", "currencies_", "yes", "no")
#: Limits of a subscription as whole numbers.
BOUNDS = ("least", "low", "high", "below", "days")


def in_quiet_hours(at: Column, start: Column, end: Column, zone: Column) -> Column:
    """Local time in [start, end), over midnight if start is later; no hours, never."""
    local = F.date_format(F.from_utc_timestamp(at, zone), "HH:mm:ss")
    s, e = F.concat(start, F.lit(":00")), F.concat(end, F.lit(":00"))
    inside = F.when(s <= e, (local >= s) & (local < e)).otherwise((local >= s) | (local < e))
    return F.when((F.length(start) > 0) & (F.length(end) > 0), inside).otherwise(False)


def next_quiet_end(at: Column, start: Column, end: Column, zone: Column) -> Column:
    """When quiet hours end, in UTC, told in the zone's own time; null outside them."""
    local = F.from_utc_timestamp(at, zone)
    today = F.to_timestamp(F.concat(F.date_format(local, "yyyy-MM-dd"), F.lit(" "), end), "yyyy-MM-dd HH:mm")
    candidate = F.when(today <= local, F.to_timestamp(F.concat(F.date_format(F.date_add(F.to_date(local), 1), "yyyy-MM-dd"), F.lit(" "), end), "yyyy-MM-dd HH:mm")).otherwise(today)
    return F.when(in_quiet_hours(at, start, end, zone), F.to_utc_timestamp(candidate, zone))


def keyword_hit(text: Column, keywords: Column) -> Column:
    """Whether any keyword is a substring; none given, no hit.  Both sides are normalised by the caller."""
    return F.coalesce(F.exists(F.filter(keywords, lambda k: F.length(k) > 0), lambda k: F.contains(text, k)), F.lit(False))


def _listed(values: Column, value: Column) -> Column:
    """An empty or null list lets everything through; else the value must be in it."""
    return (F.coalesce(F.size(values), F.lit(0)) <= 0) | F.coalesce(F.array_contains(values, value), F.lit(False))


def _cents(amount: Column) -> Column:
    """Ten thousandths, as a long: faster to compare than a decimal."""
    return (amount.cast(MONEY) * 10_000).cast("long")


def _limits(subscriptions: DataFrame) -> DataFrame:
    """Enabled subscriptions as `s`, with their filters in one form: empty lists for null ones, words normalised, currencies in upper case, and `rank` within the user.

    Of a user's subscriptions that differ only in their least budget, a later one that asks for no less than an earlier
    one can never be the first to fit, so it is left out; another fits only `below` what the earlier ones ask.
    """
    tidy = lambda c, f=None: F.array_sort(F.array_distinct(F.transform(F.coalesce(F.col(c), F.array().cast(dict(subscriptions.dtypes)[c])), f) if f else F.coalesce(F.col(c), F.array().cast(dict(subscriptions.dtypes)[c]))))
    words = lambda k: normalize_text(k, False)
    lists = {"types": tidy("project_types"), "sources": tidy("source_ids"), "currencies_": tidy("currencies", F.upper), "yes": tidy("positive_keywords", words), "no": tidy("negative_keywords", words)}
    subs = subscriptions.where("enabled").withColumn("s", F.struct(*subscriptions.columns)).withColumns(lists)
    same = Window.partitionBy("user_id", *lists, "min_relevance_score", "budget_max", "freshness_days").orderBy("created_at", "subscription_id")
    least = F.coalesce(F.col("budget_min").cast("decimal(38,2)"), F.lit(-1).cast("decimal(38,2)"))
    before = F.min(least).over(same.rowsBetween(Window.unboundedPreceding, -1))
    subs = subs.withColumn("__below", before).where(F.col("__below").isNull() | (least < F.col("__below")))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("created_at", "subscription_id"))
    bounds = [F.col("s.min_relevance_score").alias("least"), _cents(F.col("s.budget_min")).alias("low"), _cents(F.col("s.budget_max")).alias("high"), _cents(F.col("__below")).alias("below"), F.col("s.freshness_days").alias("days")]
    return subs.select("s", *lists, *bounds, rank.alias("rank"), F.col("user_id").alias("user"))


def _first_to_fit(rows: pd.DataFrame) -> pd.DataFrame:
    """The rows that no earlier one makes pointless by letting through all that they do: each list of it the same or empty, each bound as wide."""
    rows = rows.sort_values("rank")
    told = rows.drop(columns=["user", "rank", "chunk"]).to_numpy(np.int64)
    kept, n, fits, lists = np.empty_like(told), 0, np.zeros(len(told), bool), len(LISTS)
    for i, own in enumerate(told):
        others = kept[:n]
        if not (((others[:, :lists] == own[:lists]) | (others[:, :lists] == 0)).all(1) & (others[:, lists:] <= own[lists:]).all(1)).any():
            kept[n], fits[i] = own, True
            n += 1
    return rows.loc[fits, ["user", "rank"]]


def without_pointless(limits: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """limits without the subscriptions that can't be the first of their user to fit any order, as far as chunks of a user's subscriptions tell.

    Taken in the order of their ranks, twice: what a chunk leaves is dealt into chunks again.
    """
    wide = F.lit(2**63 - 1)
    named = [F.when(F.size(c) > 0, F.xxhash64(F.to_json(c))).otherwise(F.lit(0).cast("long")).alias(c) for c in LISTS]
    bounds = [F.coalesce(c, -wide).alias(n) for n, c in {"least": _cents(F.col("least")), "low": F.col("low"), "high": -F.col("high"), "days": -F.col("days").cast("long")}.items()]
    rows = limits.select("user", "rank", *named, *bounds)
    kind, kept = dict(limits.dtypes), limits
    for _ in range(2):
        nth = F.row_number().over(Window.partitionBy("user").orderBy("rank"))
        dealt = rows.join(kept.select("user", "rank"), ["user", "rank"], "left_semi").withColumn("chunk", F.floor((nth - 1) / chunk))
        kept = stored(dealt.groupBy("user", "chunk").applyInPandas(_first_to_fit, f"user {kind['user']}, rank int"), "limits")
    return limits.join(kept, ["user", "rank"], "left_semi")


def match_pairs(orders: DataFrame, subscriptions: DataFrame, as_of: Column, compose: bool = True) -> DataFrame:
    """(order_id, subscription): for each order and user the earliest of the user's enabled subscriptions that the order fits.

    Subscriptions that a user's earlier ones make pointless are left out first.  Orders meet the others on keys: a
    subscription stands under its sources if it names any, else its project types, else its currencies, else alone; an
    order has its own source, its type, its currency and nothing.  Subscriptions without sources are broadcast up to WIDE
    of them, to orders that were dealt by their id, so that the earliest one of a user is a minimum of ranks without a
    further shuffle.  More are shuffled by key and by the band of ten that their least relevance lies in, as an order has
    its keys with all bands up to its own.  Those with sources are broadcast up to FEW, else shuffled by source.
    """
    text = normalize_text(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")), F.coalesce("normalized_text", F.lit(""))), compose)
    key = lambda kind, value: F.concat(F.lit(f"{kind}:"), value.cast("string"))
    currency, amount = F.upper("budget_currency"), _cents(representative_budget(F.col("budget_from"), F.col("budget_to")))
    far, or_ = F.lit(1 << 61), F.coalesce
    left = orders.select(
        "order_id", "source_id", "project_type", "relevance_score", currency.alias("currency"), text.alias("text"), or_(F.col("relevance_score").cast("double"), F.lit(float("-inf"))).alias("score"), or_(amount, -far).alias("from"), or_(amount, far).alias("to"), or_(F.unix_seconds("published_at"), -far).alias("at"),
    )
    # what an order lacks is further out than any limit, and a limit that a subscription lacks is further out still, so numbers are compared without nulls
    bounds = [
        or_(F.col("least").cast("double"), F.lit(float("-inf"))).alias("least"), or_(F.col("low"), -2 * far).alias("low"), or_(F.col("high"), 2 * far).alias("high"), or_(F.col("below"), 2 * far).alias("below"),
        or_(F.unix_seconds(as_of) - F.col("days").cast("long") * 86400, -2 * far).alias("since"),
    ]
    subs = stored(_limits(subscriptions), "limits")
    if subs.count() > CHUNK:
        subs = stored(without_pointless(subs), "limits")
    everywhere, few = subs.where(F.size("sources") <= 0), subs.count() <= FEW
    wide = everywhere.count()
    placed = subs.where(F.size("sources") > 0).select("user", "rank", *LISTS, *bounds, F.explode("sources").alias("source")).withColumn("key", key("source", F.col("source"))).drop("source")
    sourced = placed.count()

    numbers = (F.col("score") >= F.col("least")) & (F.col("from") >= F.col("low")) & (F.col("from") < F.col("below")) & (F.col("to") <= F.col("high")) & (F.col("at") >= F.col("since"))
    listed = (
        _listed(F.col("types"), F.col("project_type")) & _listed(F.col("sources"), F.col("source_id")) & _listed(F.col("currencies_"), F.col("currency"))
        & ~keyword_hit(F.col("text"), F.col("no")) & ((F.size("yes") <= 0) | keyword_hit(F.col("text"), F.col("yes")))
    )
    met = []
    if wide:
        kinds = F.array(key("type", F.col("project_type")), key("currency", F.col("currency")), F.lit("any"))
        asked = lambda rows: rows.withColumn("key", F.explode(F.filter(kinds, lambda k: k.isNotNull())))
        keys = lambda kind, c: F.transform(c, lambda v: key(kind, v))
        under = F.when(F.size("types") > 0, keys("type", F.col("types"))).when(F.size("currencies_") > 0, keys("currency", F.col("currencies_"))).otherwise(F.array(F.lit("any")))
        if wide <= WIDE:
            # lists and words are asked once for all subscriptions that share them
            parts = max(int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-orders.count() // ORDERS))
            shared = stored(everywhere.select(*LISTS).distinct().withColumn("set", F.monotonically_increasing_id()), "limits")
            same = reduce(Column.__and__, [everywhere[c] == shared[c] for c in LISTS])
            right = everywhere.join(F.broadcast(shared), same).select("set", "user", "rank", *bounds)
            sets = asked(left.repartition(parts, "order_id")).join(F.broadcast(shared.select("set", *LISTS, F.explode(under).alias("key"))), "key").where(listed)
            met.append(sets.select("order_id", "set", "score", "from", "to", "at").join(F.broadcast(right), "set").where(numbers))
        else:
            band = lambda score: F.greatest(F.lit(0), F.least(F.lit(10), F.floor(F.coalesce(score, F.lit(0)) / 10))).cast("int")
            right = everywhere.select("user", "rank", *LISTS, band(F.col("least")).alias("band"), *bounds, F.explode(under).alias("key"))
            met.append(asked(left).withColumn("band", F.explode(F.sequence(F.lit(0), band(F.col("relevance_score"))))).join(right, ["key", "band"]).where(numbers & listed))
    if sourced or not met:
        met.append(left.withColumn("key", key("source", F.col("source_id"))).join(F.broadcast(placed) if sourced <= FEW else placed, "key").where(numbers & listed))
    first = [m.groupBy("order_id", "user").agg(F.min("rank").alias("rank")) for m in met]
    if len(first) > 1:
        first = [reduce(DataFrame.unionByName, first).groupBy("order_id", "user").agg(F.min("rank").alias("rank"))]
    named = subs.select("user", "rank", F.col("s").alias("subscription"))
    return first[0].join(F.broadcast(named) if few else named, ["user", "rank"]).select("order_id", "subscription")


def match_subscriptions(orders: DataFrame, subscriptions: DataFrame, as_of: Column, compose: bool = True) -> DataFrame:
    """orders with `subscription`: a row for each order and user, with the earliest of the user's subscriptions that fits (see match_pairs)."""
    return orders.join(match_pairs(orders, subscriptions, as_of, compose), "order_id").select(*orders.columns, "subscription")


def sent_within(candidates: DataFrame, deliveries: DataFrame, minutes: str, as_of: Column) -> DataFrame:
    """candidates with `recent`: the user's deliveries sent in the last so many minutes (a column), over all subscriptions."""
    users = candidates.select("user_id", F.col(minutes).alias("__m")).distinct()
    sent = deliveries.where("status = 'sent'").select("user_id", "sent_at")
    counts = users.join(sent, "user_id").where(F.unix_micros("sent_at") >= F.unix_micros(as_of) - F.col("__m") * F.lit(60_000_000).cast("long")).groupBy("user_id", "__m").agg(F.count("*").alias("recent"))
    out = candidates.withColumn("__m", F.col(minutes)).join(counts, ["user_id", "__m"], "left")
    return out.drop("__m").withColumn("recent", F.coalesce("recent", F.lit(0)))


def rate_limited(deliveries: DataFrame, minutes: int, most: int) -> DataFrame:
    """deliveries with how many of the user's came in the trailing minutes before each, and whether that is the limit."""
    trailing = Window.partitionBy("user_id").orderBy(F.unix_seconds("sent_at")).rangeBetween(-minutes * 60, -1)
    return deliveries.withColumn("recent", F.count("*").over(trailing)).withColumn("limited", F.col("recent") >= most)


def similar_sent(candidates: DataFrame, deliveries: DataFrame, as_of: Column) -> DataFrame:
    """candidates whose user was sent another order of the same fingerprint within their cooldown (a semi join over a range)."""
    sent = deliveries.where("status = 'sent'").select(F.col("user_id").alias("__u"), F.col("duplicate_fingerprint").alias("__f"), F.col("order_id").alias("__o"), F.col("sent_at").alias("__t"))
    near = F.unix_micros("__t") >= F.unix_micros(as_of) - F.col("similar_cooldown_minutes") * F.lit(60_000_000).cast("long")
    return candidates.join(sent, (F.col("user_id") == F.col("__u")) & (F.col("duplicate_fingerprint") == F.col("__f")) & (F.col("order_id") != F.col("__o")) & near, "left_semi")


def recipients(users: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Active users with a chat, limited to an allow-list(tg_chat_id) if given; listed chats without a user get a row of their own."""
    active = users.where("is_active and tg_chat_id is not null").select("user_id", "tg_chat_id")
    if allowed is None:
        return active
    new = allowed.join(users, "tg_chat_id", "left_anti").select(F.concat(F.lit("chat:"), F.col("tg_chat_id").cast("string")).alias("user_id"), "tg_chat_id")
    return active.join(allowed, "tg_chat_id", "left_semi").select("user_id", "tg_chat_id").unionByName(new)


def _folded(rows: pd.DataFrame) -> pd.DataFrame:
    """Decisions over the rows of one part, whose users come in with what they were sent in earlier parts."""
    rows = rows.sort_values(["user_id", "published_at", "order_id"], kind="stable")
    user, sent, prints, decided = None, 0, set(), []
    columns = ("user_id", "duplicate_fingerprint", "left", "cooldown", "similar_before", "quiet", "sent_before", "print_before")
    for u, mark, left, cooldown, similar, quiet, before, seen in zip(*[rows[c] for c in columns], strict=True):
        if u != user:
            user, sent, prints = u, before, set()
        if not pd.isna(left) and sent >= left:
            decided.append("rate_limited")
        elif similar or (cooldown and (seen or mark in prints)):
            decided.append("similar_recently")
        elif quiet:
            decided.append("deferred")
        else:
            decided.append("send")
            sent += 1
            if mark is not None:
                prints.add(mark)
    return pd.DataFrame({"user_id": rows["user_id"], "order_id": rows["order_id"], "duplicate_fingerprint": rows["duplicate_fingerprint"], "decision": decided})


def admit(candidates: DataFrame, part: int = PART) -> DataFrame:
    """(user_id, order_id, decision): decided in order (published_at, order_id) for each user; each send counts for the next decision.

    candidates: user_id, order_id, published_at, duplicate_fingerprint, recent (sent before), most (null: no limit),
    cooldown (boolean: a similar order may not follow), similar_before (boolean) and, if given, quiet (what passes is
    deferred and doesn't count as sent).

    The candidates are sorted into parts of about `part` rows and each part is folded row by row, in time that grows
    with its rows.  A user whose candidates fill several parts is taken up part after part: how many orders were sent
    and which fingerprints they had are handed on as tables.  All users' n-th parts are decided at once.
    """
    quiet = F.col("quiet") if "quiet" in candidates.columns else F.lit(False)
    told = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    kept = stored(candidates.select("user_id", "order_id", "published_at", "duplicate_fingerprint", (F.col("most") - F.col("recent")).cast("long").alias("left"), told("cooldown"), told("similar_before"), F.coalesce(quiet, F.lit(False)).alias("quiet")), "candidates")
    parts = max(1, -(-kept.count() // part))
    rows = stored(kept.repartitionByRange(parts, "user_id", "published_at", "order_id").withColumn("part", F.spark_partition_id()), "candidates")
    dropped(kept)
    spans = rows.groupBy("user_id").agg(F.min("part").alias("first"), F.max("part").alias("last")).where("first < last")
    spans = stored(spans, "spans")  # fewer users than parts, as each holds a border of two
    rows = rows.join(F.broadcast(spans.select("user_id", "first")), "user_id", "left").withColumn("turn", F.coalesce(F.col("part") - F.col("first"), F.lit(0)))
    kind = dict(candidates.dtypes)
    schema = f"user_id {kind['user_id']}, order_id {kind['order_id']}, duplicate_fingerprint string, decision string"
    done: list[DataFrame] = []
    for turn in range(1 + (spans.agg(F.max(F.col("last") - F.col("first"))).first()[0] or 0)):
        now = rows.where(F.col("turn") == turn)
        if done:
            sends = reduce(DataFrame.unionByName, done).where("decision = 'send'").join(F.broadcast(spans.select("user_id")), "user_id", "left_semi")
            counts = sends.groupBy("user_id").agg(F.count("*").alias("sent_before"))
            prints = sends.select("user_id", "duplicate_fingerprint", F.lit(True).alias("print_before")).where("duplicate_fingerprint is not null").distinct()
            now = now.join(F.broadcast(counts), "user_id", "left").join(prints, ["user_id", "duplicate_fingerprint"], "left")
            now = now.fillna({"sent_before": 0, "print_before": False})
        else:
            now = now.withColumns({"sent_before": F.lit(0).cast("long"), "print_before": F.lit(False)})
        columns = ["user_id", "order_id", "published_at", "duplicate_fingerprint", "left", "cooldown", "similar_before", "quiet", "sent_before", "print_before", "part"]
        done.append(stored(now.select(*columns).groupBy("part").applyInPandas(_folded, schema), "decided"))
    return reduce(DataFrame.unionByName, done).drop("duplicate_fingerprint")


def match_notifications(orders: DataFrame, subscriptions: DataFrame, users: DataFrame, deliveries: DataFrame, as_of: Column, channel: str = "telegram", compose: bool = True) -> DataFrame:
    """(order_id, user_id, subscription_id, decision, scheduled_for): send, rate_limited, similar_recently, or deferred to the end of quiet hours.

    orders are notifiable and carry duplicate_fingerprint; deliveries carry the fingerprint of their order.  Pairs
    that already have a delivery by the channel are left out.  Limits and cooldowns are asked before quiet hours, so
    what they hold back isn't deferred.
    """
    met = match_subscriptions(orders, subscriptions, as_of, compose)
    s = lambda c: F.col(f"subscription.{c}")
    flat = met.select(
        "order_id", "published_at", "duplicate_fingerprint", s("user_id").alias("user_id"), s("subscription_id").alias("subscription_id"), s("max_notifications_per_period").alias("most"),
        F.coalesce(s("rate_limit_period_minutes"), F.lit(0)).alias("period"), F.coalesce(s("similar_cooldown_minutes"), F.lit(0)).alias("similar_cooldown_minutes"),
        s("quiet_hours_start").alias("q1"), s("quiet_hours_end").alias("q2"), F.coalesce(s("timezone"), F.lit("UTC")).alias("zone"),
    )
    flat = flat.join(users.select("user_id"), "user_id", "left_semi").join(deliveries.where(F.col("channel") == channel).select("order_id", "user_id"), ["order_id", "user_id"], "left_anti")
    flat = flat.withColumn("scheduled_for", next_quiet_end(as_of, F.col("q1"), F.col("q2"), F.col("zone")))
    flat = sent_within(flat, deliveries, "period", as_of)
    similar = similar_sent(flat, deliveries, as_of).select("order_id", "user_id", F.lit(True).alias("similar_before"))
    flat = flat.join(similar, ["order_id", "user_id"], "left").withColumn("similar_before", F.coalesce("similar_before", F.lit(False))).withColumn("cooldown", F.col("similar_cooldown_minutes") > 0)
    decided = admit(flat.withColumn("quiet", F.col("scheduled_for").isNotNull()))
    told = flat.join(decided, ["order_id", "user_id"])
    return told.select("order_id", "user_id", "subscription_id", "decision", F.when(F.col("decision") == "deferred", F.col("scheduled_for")).alias("scheduled_for"))


def release_deferred(deliveries: DataFrame, notifiable_orders: DataFrame, users: DataFrame, as_of: Column, limit: int | None = None) -> DataFrame:
    """Deferred deliveries that are due, oldest first: decision send, or skipped if the order or the user no longer qualifies."""
    due = deliveries.where((F.col("status") == "deferred") & (F.col("scheduled_for") <= as_of)).orderBy("scheduled_for", "delivery_id")
    due = due if limit is None else due.limit(limit)
    ok = notifiable_orders.select("order_id", F.lit(True).alias("__o"))
    active = users.where("is_active").select("user_id", F.lit(True).alias("__u"))
    met = due.join(ok, "order_id", "left").join(active, "user_id", "left")
    return met.withColumn("decision", F.when(F.col("__o") & F.col("__u"), "send").otherwise("skipped")).drop("__o", "__u")


def validate_subscriptions(subs: DataFrame) -> DataFrame:
    """Lists trimmed, currencies in upper case, and `error`: null or the first thing wrong."""
    tidy = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    out = subs.withColumns({c: tidy(c) for c in ("project_types", "currencies", "source_ids", "positive_keywords", "negative_keywords")}).withColumn("currencies", F.transform("currencies", F.upper))
    blank = lambda c: F.coalesce(F.length(c), F.lit(0)) == 0
    time = r"^([01]\d|2[0-3]):[0-5]\d$"
    # the zones that the session's own time functions know; about 600
    known = F.col("timezone").isin(list(subs.sparkSession._jvm.java.time.ZoneId.getAvailableZoneIds()))
    tests = [
        (F.exists("source_ids", lambda x: ~x.rlike("^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$")), "source_ids"),
        (F.col("timezone").isNotNull() & ~known, "timezone"),
        (blank("quiet_hours_start") != blank("quiet_hours_end"), "quiet_hours_pair"),
        (~blank("quiet_hours_start") & ~(F.col("quiet_hours_start").rlike(time) & F.col("quiet_hours_end").rlike(time)), "quiet_hours_format"),
        (F.col("budget_min") > F.col("budget_max"), "budget_range"),
        (~F.col("min_relevance_score").between(0, 100), "min_relevance_score"),
    ]
    error = F.lit(None).cast("string")
    for test, name in reversed(tests):
        error = F.when(test, name).otherwise(error)
    return out.withColumn("error", error)
