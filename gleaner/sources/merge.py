"""Reading raw posts, keyed merges, soft deletes, high-water marks, rule tables, partitions, audit and quarantine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import content_hash
from gleaner.operators.dedup import first_by
from gleaner.settings import DEFAULT, Settings

#: Fields of a source post whose change counts as an update.  What processing adds is not asked.
TRACKED = ["text", "published_at", "edited_at", "views_count", "replies_count", "forward_original_date", "message_url", "content_hash"]


def incremental_scan(raw: DataFrame, sources: DataFrame, as_of: Column, cap: int | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """raw posts past each source's last seen id; on a first load only those of the last days.

    cap, if given, keeps the oldest so many of each source, so the rest follow in the next run.
    """
    days = settings.backfill_days + settings.backfill_buffer_days
    known = sources.select("source_id", F.coalesce("last_seen_message_id", F.lit(0)).alias("__seen"))
    out = raw.join(known, "source_id").where(F.col("id") > F.col("__seen"))
    out = out.where((F.col("__seen") > 0) | (F.col("date") >= as_of - F.expr(f"interval {days} days"))).drop("__seen")
    if cap is not None:
        out = out.withColumn("__n", F.row_number().over(Window.partitionBy("source_id").orderBy("id"))).where(F.col("__n") <= cap).drop("__n")
    return out


def snapshot_messages(raw: DataFrame, sources: DataFrame, host: str = "https://t.me") -> DataFrame:
    """Raw posts as typed rows of `messages`."""
    named = raw.join(sources.select("source_id", "normalized_username"), "source_id")
    return named.select(
        "source_id", F.col("id").alias("tg_message_id"), F.col("date").alias("published_at"), F.col("edit_date").alias("edited_at"), F.col("fwd_date").alias("forward_original_date"), F.col("message").alias("text"),
        content_hash(F.col("message")).alias("content_hash"), F.concat(F.lit(f"{host}/"), "normalized_username", F.lit("/"), F.col("id").cast("string")).alias("message_url"),
        F.col("views").cast("int").alias("views_count"), F.col("replies").cast("int").alias("replies_count"), F.to_json(F.struct(*raw.columns)).alias("raw_payload"),
    )


def latest(snapshot: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last write for each key."""
    return first_by(snapshot, keys, order)


def merge(current: DataFrame, snapshot: DataFrame, keys: list[str], tracked: list[str], as_of: Column) -> DataFrame:
    """Full outer merge by key: current columns with `action` inserted, updated, unchanged or kept.

    A snapshot row replaces tracked fields if any differs or the row was deleted, and un-deletes it.  collected_at
    changes only with the row.  Both sides have one row for each key (see latest()).
    """
    fields = [c for c in tracked if c in snapshot.columns and c in current.columns]
    new = snapshot.select(*[F.col(k).alias(f"__{k}") for k in keys], F.struct(*fields).alias("__new"))
    on = F.lit(True)
    for k in keys:
        on = on & (current[k] == new[f"__{k}"])
    met = current.withColumn("__old", F.struct(*fields)).withColumn("__here", F.lit(True)).join(new, on, "full_outer")
    changed = ~F.col("__new").eqNullSafe(F.col("__old")) | F.col("deleted_at").isNotNull()
    action = F.when(F.col("__here").isNull(), "inserted").when(F.col("__new").isNull(), "kept").when(changed, "updated").otherwise("unchanged")
    met = met.withColumn("action", action)
    take = F.col("action").isin("inserted", "updated")
    out = [F.coalesce(F.col(k), F.col(f"__{k}")).alias(k) if k in keys else F.when(take, F.col("__new")[k]).otherwise(F.col(k)).alias(k) if k in fields else F.when(take, as_of).otherwise(F.col(k)).alias(k) if k == "collected_at" else F.when(take, F.lit(None)).otherwise(F.col(k)).alias(k) if k == "deleted_at" else F.col(k) for k in current.columns]
    return met.select(*out, "action")


def upsert_messages(current: DataFrame, snapshot: DataFrame, as_of: Column) -> DataFrame:
    return merge(current, snapshot, ["source_id", "tg_message_id"], TRACKED, as_of)


def soft_delete_missing(current: DataFrame, observed: DataFrame, as_of: Column) -> DataFrame:
    """current with deleted_at set where the key was not observed; `action` is deleted or kept."""
    seen = observed.select("source_id", "tg_message_id").distinct().withColumn("__seen", F.lit(True))
    met = current.join(seen, ["source_id", "tg_message_id"], "left").withColumn("action", F.when(F.col("__seen").isNull() & F.col("deleted_at").isNull(), "deleted").otherwise("kept"))
    return met.withColumn("deleted_at", F.when(F.col("action") == "deleted", as_of).otherwise(F.col("deleted_at"))).select(*current.columns, "action")


def advance_high_water(sources: DataFrame, batch: DataFrame, as_of: Column) -> DataFrame:
    top = batch.groupBy("source_id").agg(F.max("tg_message_id").alias("__top"))
    met = sources.join(top, "source_id", "left")
    return met.withColumn("last_seen_message_id", F.greatest("last_seen_message_id", "__top")).withColumn("last_checked_at", F.when(F.col("__top").isNotNull(), as_of).otherwise(F.col("last_checked_at"))).select(*sources.columns)


def changed_ids(*results: DataFrame) -> DataFrame:
    """Keys to process again: inserted, updated or deleted."""
    out = None
    for r in results:
        part = r.where(F.col("action").isin("inserted", "updated", "deleted")).select("source_id", "tg_message_id", "action")
        out = part if out is None else out.unionByName(part)
    return out


def merge_counts(*results: DataFrame) -> DataFrame:
    """Per source: saved, updated, deleted, enqueued."""
    is_ = lambda a: F.count_if(F.col("action") == a)
    return changed_ids(*results).groupBy("source_id").agg(is_("inserted").alias("saved"), is_("updated").alias("updated"), is_("deleted").alias("deleted"), F.count("*").alias("enqueued"))


def load_rules(rules: DataFrame, kind: str) -> DataFrame:
    """Enabled rules only; negative ones get the category `negative`."""
    out = rules.where("enabled")
    return out.withColumn("category", F.lit("negative")) if kind == "negative" else out


def list_rules(rules: DataFrame, kind: str | None = None) -> DataFrame:
    """Dictionary rows by phrase, of one category if given; equal phrases by their language."""
    out = rules if kind is None else rules.where(F.col("category") == kind)
    return out.orderBy("phrase", *[c for c in ("lang",) if c in rules.columns])


def list_subscriptions(subscriptions: DataFrame, user: object = None) -> DataFrame:
    """Subscriptions, the newest first, of one user or of all; equal times by key."""
    out = subscriptions if user is None else subscriptions.where(F.col("user_id") == user)
    return out.orderBy(F.desc("created_at"), "subscription_id")


def insert_missing(existing: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(all rows, inserted rows): new rows whose key is not there yet, the first of each key."""
    added = new.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(added, allowMissingColumns=True), added


def replace_by_key(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of a key go when any new row has it, so reruns change nothing."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def apply_changes(table: DataFrame, changes: DataFrame, key: str, unique: list[str], check: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Keyed create / update / delete: (new table, changes with `outcome` ok, not_found, duplicate or invalid).

    changes has `op`, the key and any columns of the table; null keeps a column.  check is a column that is true
    for a valid row after the change.  A change that would repeat the unique columns of another row is refused.
    """
    fields = [c for c in table.columns if c != key and c in changes.columns]
    old = table.select(F.col(key).alias("__id"), F.struct(*table.columns).alias("__old"))
    met = changes.join(old, F.col(key) == F.col("__id"), "left")
    exists = F.col("__id").isNotNull()
    after = F.struct(F.col(key), *[(F.coalesce(F.col(c), F.col("__old")[c]) if c in fields else F.col("__old")[c]).alias(c) for c in table.columns if c != key])
    met = met.withColumn("__after", after).withColumn("__bad", F.lit(False) if check is None else ~F.coalesce(check, F.lit(False)))
    keys_after = met.where(F.col("op") != "delete").select(F.col(key).alias("__owner"), *[F.col(f"__after.{c}").alias(f"__u_{c}") for c in unique])
    untouched = table.join(changes.select(key), key, "left_anti").select(F.col(key).alias("__owner"), *[F.col(c).alias(f"__u_{c}") for c in unique])
    clash = keys_after.unionByName(untouched).groupBy(*[f"__u_{c}" for c in unique]).agg(F.count("*").alias("__n"), F.min("__owner").alias("__first")).where("__n > 1")
    on = F.lit(True)
    for c in unique:
        on = on & (F.col(f"__after.{c}") == F.col(f"__u_{c}"))
    met = met.join(clash, on, "left")
    outcome = (
        F.when((F.col("op") != "create") & ~exists, "not_found").when((F.col("op") == "create") & exists, "duplicate").when((F.col("op") != "delete") & F.col("__bad"), "invalid")
        .when((F.col("op") != "delete") & F.col("__n").isNotNull(), "duplicate").otherwise("ok")
    )
    met = met.withColumn("outcome", outcome)
    done = met.where("outcome = 'ok'")
    out = table.join(done.select(key), key, "left_anti").unionByName(done.where(F.col("op") != "delete").select("__after.*"))
    return out, met.select(*changes.columns, "outcome")


def with_month(messages: DataFrame) -> DataFrame:
    return messages.withColumn("published_month", F.trunc("published_at", "MM"))


def write_partitioned(messages: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder for each month; only months in the data are replaced."""
    with_month(messages).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("published_month").parquet(path)


def expired_months(messages: DataFrame, as_of: Column, settings: Settings = DEFAULT) -> DataFrame:
    """(published_month, rows, expired): a month goes if it lies wholly before the month of the cutoff."""
    days = max(settings.retention_days, settings.least_retention_days)
    cutoff = F.trunc(F.date_sub(F.to_date(as_of), days), "MM")
    return with_month(messages).groupBy("published_month").agg(F.count("*").alias("rows")).withColumn("expired", F.col("published_month") < cutoff)


def keep_months(messages: DataFrame, as_of: Column, settings: Settings = DEFAULT) -> DataFrame:
    days = max(settings.retention_days, settings.least_retention_days)
    return messages.where(F.col("published_at") >= F.trunc(F.date_sub(F.to_date(as_of), days), "MM"))


def audit_rows(changes: DataFrame, action: str, entity: str, key: str, as_of: Column, correlation: Column | None = None) -> DataFrame:
    """A row for each change: (action, entity, entity_id, payload, created_at), and correlation_id if what ties the changes of one run together is given."""
    out = changes.select(F.lit(action).alias("action"), F.lit(entity).alias("entity"), F.col(key).cast("string").alias("entity_id"), F.to_json(F.struct(*changes.columns)).alias("payload"), as_of.alias("created_at"), *([] if correlation is None else [correlation.cast("string").alias("correlation_id")]))
    return out


def append_audit(rows: DataFrame, path: str) -> None:
    """Add audit rows to the log at path, a folder for each day; what is there stays."""
    rows.withColumn("created_on", F.to_date("created_at")).write.mode("append").partitionBy("created_on").parquet(path)


def quarantine(df: DataFrame, error: str, task: str, key: str, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, new dead letters): rows with an error leave, once for each task and key."""
    bad = df.where(F.col(error).isNotNull())
    letters = bad.select(F.concat(F.lit(f"{task}:"), F.coalesce(F.col(key).cast("string"), F.to_json(F.struct(*df.columns)))).alias("dedup_key"), F.lit(task).alias("task"), F.col(error).alias("error"), F.to_json(F.struct(*df.columns)).alias("payload")).dropDuplicates(["dedup_key"])
    return df.where(F.col(error).isNull()), letters if known is None else letters.join(known.select("dedup_key"), "dedup_key", "left_anti")


def check_constraints(df: DataFrame, tests: dict[str, Column], unique: dict[str, list[str]] | None = None) -> DataFrame:
    """(rule, violations): rows that break a test, in one pass; and keys that occur more than once."""
    counted = df.agg(*[F.count_if(~F.coalesce(t, F.lit(True))).alias(n) for n, t in tests.items()])
    out = counted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in tests])).alias("r")).select("r.*")
    for name, keys in (unique or {}).items():
        out = out.unionByName(df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").agg(F.lit(name).alias("rule"), F.count("*").alias("violations")))
    return out


def load_labelled(spark, path: str, labels: list[str], normalize: Callable[[Column], Column]) -> DataFrame:
    """Labelled texts from a JSON array of {text, label}; an unknown label raises when read."""
    raw = spark.read.schema("text string, label string").option("multiLine", True).json(path)
    checked = F.when(F.col("label").isin(labels), F.col("label")).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce("label", F.lit("null")))))
    return raw.select("text", checked.alias("label")).withColumn("normalized_text", normalize(F.col("text"))).withColumn("text_hash", content_hash(F.col("normalized_text")))
