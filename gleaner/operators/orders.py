"""The order feed: filters, paging, export, cards, status changes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.sources.merge import insert_missing

#: From which status an order may go to which.
TRANSITIONS = {"new": ["viewed", "contacted", "irrelevant", "archived"], "viewed": ["contacted", "irrelevant", "archived"], "contacted": ["archived", "irrelevant"], "irrelevant": ["archived"], "archived": []}
EXPORT = ["order_id", "published_at", "status", "relevance_score", "project_type", "budget_from", "budget_to", "budget_currency", "title", "summary", "message_url"]
MOST_EXPORTED = 1000


@dataclass(frozen=True)
class OrderFilters:
    date_from: date | None = None
    date_to: date | None = None
    budget_min: float | None = None
    budget_max: float | None = None
    project_type: Sequence[str] | None = None
    relevance_min: int | None = None
    source_id: str | None = None
    status: Sequence[str] | None = None
    q: str | None = None


def search_text(q: str) -> Column:
    """Case-insensitive substring of title or summary; %, _ and backslash stand for themselves."""
    has = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))).contains(q.lower())
    return has("title") | has("summary")


def filter_orders(orders: DataFrame, f: OrderFilters) -> DataFrame:
    """All given filters hold.  A budget limit holds if either end of the budget keeps it."""
    day, out = F.to_date("published_at"), orders
    tests = [
        (f.date_from, lambda v: day >= F.lit(v)),
        (f.date_to, lambda v: day <= F.lit(v)),
        (f.budget_min, lambda v: (F.col("budget_from") >= v) | (F.col("budget_to") >= v)),
        (f.budget_max, lambda v: (F.col("budget_from") <= v) | (F.col("budget_to") <= v)),
        (f.project_type, lambda v: F.col("project_type").isin(list(v))),
        (f.relevance_min, lambda v: F.col("relevance_score") >= v),
        (f.source_id, lambda v: F.col("source_id") == v),
        (f.status, lambda v: F.col("status").isin(list(v))),
        (f.q, search_text),
    ]
    for value, test in tests:
        if value is not None and value != []:
            out = out.where(test(value))
    return out


def feed_page(orders: DataFrame, page: int, size: int = 20) -> DataFrame:
    """Newest first, then most relevant, then by id; pages count from 1 and hold 100 rows at most."""
    size = min(size, 100)
    return orders.orderBy(F.desc("published_at"), F.desc("relevance_score"), "order_id").offset((page - 1) * size).limit(size)


def with_message(orders: DataFrame, messages: DataFrame) -> DataFrame:
    """Orders with their post's url; an order whose post is gone drops out."""
    return orders.join(messages.select("message_id", "message_url"), "message_id")


def order_details(orders: DataFrame, messages: DataFrame, sources: DataFrame, groups: DataFrame) -> DataFrame:
    """Orders with their post's url, their source's columns and, if they are in a group, the group's."""
    return with_message(orders, messages).join(sources, "source_id").join(groups, "duplicate_group_id", "left")


def add_favourites(favourites: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all, added): favourites(user_id, order_id, created_at); one that is there already stays as it is."""
    return insert_missing(favourites, new, ["user_id", "order_id"])


def list_favourites(favourites: DataFrame, orders: DataFrame) -> DataFrame:
    """Favourites with their order's columns, newest first; those whose order is gone drop out."""
    return favourites.join(orders, "order_id").orderBy(F.desc("created_at"), "user_id", "order_id")


def order_payload(orders: DataFrame) -> DataFrame:
    return orders.drop("duplicate_fingerprint")


def export_orders(orders: DataFrame, limit: int = MOST_EXPORTED) -> DataFrame:
    """Fixed columns as strings, in feed order."""
    top = orders.orderBy(F.desc("published_at"), F.desc("relevance_score"), "order_id").limit(min(limit, MOST_EXPORTED))
    return top.select(*[(F.col(c) if c in orders.columns else F.lit(None)).cast("string").alias(c) for c in EXPORT])


def lookup(ids: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """ids left-joined to the table, with a flag `found`."""
    return ids.select(key).join(table.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def change_status(orders: DataFrame, updates: DataFrame) -> DataFrame:
    """updates(order_id, next_status, version) with outcome ok, not_found, version_conflict or invalid_transition, and the status and version after it."""
    now = orders.select("order_id", F.col("status").alias("old_status"), F.col("version").alias("old_version"))
    allowed = F.lit(False)
    for old, ways in TRANSITIONS.items():
        if ways:
            allowed = allowed | ((F.col("old_status") == old) & F.col("next_status").isin(ways))
    outcome = F.when(F.col("old_status").isNull(), "not_found").when(F.col("old_version") != F.col("version"), "version_conflict").when(~allowed, "invalid_transition").otherwise("ok")
    done = F.col("outcome") == "ok"
    out = updates.join(now, "order_id", "left").withColumn("outcome", outcome)
    return out.withColumn("new_status", F.when(done, F.col("next_status")).otherwise(F.col("old_status"))).withColumn("new_version", F.when(done, F.col("old_version") + 1).otherwise(F.col("old_version")))


def archive_stale(orders: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Orders older than `days` become archived and not fresh; `archived_now` tells which did."""
    stale = (F.col("published_at") < as_of - F.expr(f"interval {days} days")) & (F.col("status") != "archived")
    out, now = orders.withColumn("archived_now", F.coalesce(stale, F.lit(False))), F.col("archived_now")
    return out.withColumn("status", F.when(now, "archived").otherwise(F.col("status"))).withColumn("is_fresh", F.when(now, False).otherwise(F.col("is_fresh")))


def notifiable(orders: DataFrame, as_of: Column, days: int = 7, least: int = 60) -> DataFrame:
    """Canonical (canonical_order_id null or its own), fresh, relevant, not irrelevant or archived."""
    canonical = F.col("canonical_order_id").isNull() | (F.col("canonical_order_id") == F.col("order_id"))
    return orders.where(canonical & F.col("is_fresh") & (F.col("published_at") >= as_of - F.expr(f"interval {days} days")) & (F.col("relevance_score") >= least) & ~F.col("status").isin("irrelevant", "archived"))


def money_text(amount: Column) -> Column:
    whole = amount == F.floor(amount)
    return F.translate(F.when(whole, F.format_number(amount, 0)).otherwise(F.format_number(amount, 2)), ",", " ")


def order_card(orders: DataFrame) -> DataFrame:
    """What a notification shows: summary or title, deadline, budget in words, first contact by kind."""
    low, high = F.col("budget_from"), F.col("budget_to")
    unit = F.coalesce(F.concat(F.lit(" "), F.col("budget_currency")), F.lit(""))
    budget = (
        F.when(low.isNull() & high.isNull(), "не указан").when(high.isNull() | (low == high), F.concat(money_text(low), unit))
        .when(low.isNull(), F.concat(F.lit("до "), money_text(high), unit)).otherwise(F.concat(money_text(low), F.lit("-"), money_text(high), unit))
    )
    contact = F.coalesce(*[F.get(F.col("contacts")[k], F.lit(0)) for k in ("telegram_username", "telegram_url", "phone", "email")])
    return orders.select("order_id", "source_id", "published_at", "project_type", F.coalesce("summary", "title").alias("summary"), budget.alias("budget"), F.coalesce("deadline_text", F.col("deadline").cast("string")).alias("deadline"), contact.alias("contact"), "relevance_score")


def rank_sources(sources: DataFrame, as_of: Column) -> DataFrame:
    """Sources due for a visit: enabled, public, accessible, not paused; by score, then longest unvisited."""
    due = F.col("enabled") & F.col("is_public") & (F.col("access_status") == "ok") & (F.col("pause_until").isNull() | (F.col("pause_until") <= as_of))
    return sources.where(due).orderBy(F.desc("activity_score"), F.asc_nulls_first("last_checked_at"), "source_id")


def list_sources(sources: DataFrame, q: str | None = None, page: int = 1, size: int = 20) -> tuple[DataFrame, DataFrame]:
    """A page of sources, newest first, and the total of all that fit (one row)."""
    out = sources if not q else sources.where(F.lower("normalized_username").contains(q.lower()))
    return out.orderBy(F.desc("created_at"), F.desc("source_id")).offset((page - 1) * size).limit(size), out.agg(F.count("*").alias("total"))
