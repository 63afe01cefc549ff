"""Duplicate orders: fingerprints, groups, canonical orders, manual regrouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.sources.scratch import stored


def normalize_contacts(contacts: Column) -> Column:
    """Values in lower case and sorted, kinds sorted; null gives an empty map."""
    entries = F.transform(F.map_entries(contacts), lambda e: F.struct(e["key"].alias("key"), F.array_sort(F.transform(e["value"], F.lower)).alias("value")))
    return F.coalesce(F.map_from_entries(F.array_sort(entries)), F.create_map().cast("map<string,array<string>>"))


def fingerprint(orders: DataFrame) -> DataFrame:
    """Add duplicate_fingerprint: SHA-256 of canonical JSON of text, contacts, budget and project type."""
    money = lambda c: F.col(c).cast("decimal(14,2)").cast("string").alias(c.removeprefix("budget_"))
    body = F.coalesce(F.nullif(F.col("normalized_text"), F.lit("")), F.col("summary"), F.lit(""))
    budget = F.struct(F.col("budget_currency").alias("currency"), money("budget_from"), F.col("budget_negotiable").alias("negotiable"), money("budget_to"))
    payload = F.struct(budget.alias("budget"), normalize_contacts(F.col("contacts")).alias("contacts"), F.col("project_type"), body.alias("text"))
    return orders.withColumn("duplicate_fingerprint", F.sha2(F.to_json(payload, {"ignoreNullFields": "false"}).cast("binary"), 256))


def completeness() -> Column:
    """How many of six facts an order states."""
    has = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    facts = [
        F.col("budget_from").isNotNull() | F.col("budget_to").isNotNull(), F.coalesce("budget_negotiable", F.lit(False)), F.col("deadline").isNotNull() | has("deadline_text"),
        F.coalesce(F.size("contacts"), F.lit(0)) > 0, has("project_type"), has("summary"),
    ]
    return sum((f.cast("int") for f in facts[1:]), facts[0].cast("int"))


def canonical(df: DataFrame, group: str, order: list[Column], key: str) -> DataFrame:
    """(group, canonical, size): the first of each group by order.  A minimum with partial aggregation, so a huge group is no one task's work.

    order holds ascending columns; negate numbers to go down.
    """
    first = F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(key).alias("key")))
    return df.groupBy(group).agg(first["key"].alias("canonical"), F.count("*").alias("size"))


def deduplicate_orders(orders: DataFrame, as_of: Column | None = None, days: int | None = 7, hash_on: str = "content_hash") -> DataFrame:
    """orders with duplicate_group_id, canonical_order_id, group_size and method; all null for an order without a duplicate.

    The fingerprinted orders are written once to the shared folder, so that what makes them runs once.

    Equal raw texts give equal fingerprints, so grouping by fingerprint is the closure over both keys.  Only
    orders of the last `days` before as_of are grouped (days=None: all).  method is content_hash where the row has one.
    """
    rows = orders if "duplicate_fingerprint" in orders.columns else fingerprint(orders)
    inside = F.lit(True) if days is None or as_of is None else F.col("published_at") >= as_of - F.expr(f"interval {days} days")
    rows = stored(rows.withColumn("__in", inside), "orders")  # read by the grouping and by the join
    order = [F.col("published_at"), -completeness(), -F.col("relevance_score"), F.col("order_id").cast("string")]
    groups = canonical(rows.where("__in"), "duplicate_fingerprint", order, "order_id").where("size > 1")
    out = rows.join(groups, "duplicate_fingerprint", "left")
    grouped = F.col("__in") & F.col("canonical").isNotNull()
    has_hash = F.col(hash_on).isNotNull() if hash_on in orders.columns else F.lit(False)
    return out.select(
        *[c for c in rows.columns if c != "__in"], F.when(grouped, F.col("duplicate_fingerprint")).alias("duplicate_group_id"), F.when(grouped, F.col("canonical")).alias("canonical_order_id"),
        F.when(grouped, F.col("size")).alias("group_size"), F.when(grouped, F.when(has_hash, "content_hash").otherwise("fingerprint")).alias("method"),
    )


def duplicate_groups(deduplicated: DataFrame) -> DataFrame:
    """(duplicate_group_id, canonical_order_id, method, similarity, size)."""
    return deduplicated.where("duplicate_group_id is not null").groupBy("duplicate_group_id").agg(F.min("canonical_order_id").alias("canonical_order_id"), F.min("method").alias("method"), F.lit(1).cast("decimal(5,4)").alias("similarity"), F.count("*").alias("size"))


def regroup(deduplicated: DataFrame, overrides: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply overrides(order_id, duplicate_group_id, canonical_order_id); returns the orders and an audit row for each change."""
    new = overrides.select("order_id", F.col("duplicate_group_id").alias("__group"), F.col("canonical_order_id").alias("__canonical"), F.lit(True).alias("__set"))
    met = deduplicated.join(new, "order_id", "left")
    audit = met.where("__set").select(F.lit("order.regroup").alias("action"), F.lit("order").alias("entity"), F.col("order_id").alias("entity_id"), F.to_json(F.struct(F.col("duplicate_group_id").alias("from"), F.col("__group").alias("to"))).alias("payload"))
    out = met.withColumn("duplicate_group_id", F.when(F.col("__set"), F.col("__group")).otherwise(F.col("duplicate_group_id"))).withColumn("canonical_order_id", F.when(F.col("__set"), F.col("__canonical")).otherwise(F.col("canonical_order_id")))
    return out.drop("__group", "__canonical", "__set"), audit


def set_canonical(deduplicated: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each chosen(order_id) becomes the canonical order of its group (the least, if a group has several); returns the orders and an audit row for each group.

    A chosen order that is in no group changes nothing.
    """
    asked = deduplicated.where("duplicate_group_id is not null").join(chosen.select("order_id"), "order_id", "left_semi")
    new = asked.groupBy("duplicate_group_id").agg(F.min("order_id").alias("__canonical"), F.min("canonical_order_id").alias("__before"))
    audit = new.select(F.lit("order.set_canonical").alias("action"), F.lit("order").alias("entity"), F.col("__canonical").alias("entity_id"), F.to_json(F.struct(F.col("__before").alias("from"), F.col("__canonical").alias("to"))).alias("payload"))
    out = deduplicated.join(new, "duplicate_group_id", "left").withColumn("canonical_order_id", F.coalesce("__canonical", "canonical_order_id"))
    return out.select(*deduplicated.columns), audit


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
