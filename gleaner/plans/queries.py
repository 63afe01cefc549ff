"""Registered queries over the driver's tables, each with its DuckDB SQL where SQL can express it.

documents stand for posts (source for source_id, published at 2024-01-01 plus doc_id mod 720 hours), orders for the
order feed, events for deliveries and message logs, embeddings for order vectors, pages for source links.
Dictionaries and patterns are arguments of the operators; those here fit the tables' invented prose.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import extract, rules, text
from gleaner.operators import activity, dedup, ml, notify, orders, posts, semantic
from gleaner.settings import DEFAULT, Settings
from gleaner.sources import merge
from gleaner.sources.scratch import shared_dir
from gleaner.streaming import posts as streams

AS_OF = "2024-01-31 00:00:00"
#: Fixed value: how many posts of a source a collector takes in one run.
BATCH = 500
POSITIVE = [text.Rule("of the", "en", 5, "need"), text.Rule("and the", "en", 4, "need"), text.Rule("with", "en", 3, "need")]
NEGATIVE = [text.Rule("license", "en", 5), text.Rule("free", "en", 4), text.Rule("by the", "en", 3)]
FUZZY = [text.Rule("attion", "en"), text.Rule("ertion", "en")]
REGEX = [text.Rule("th[a-z]+tion", "en", is_regex=True)]
MARKERS = {"de": ["und"], "fr": ["les"], "es": ["que"]}
PROJECTS = [("license", ["license"]), ("free", ["free"]), ("thing", ["thing"])]
WORDS = {"need": "with", "task": "that|this", "vacancy": "office|salary", "service_ad": "license", "resume": "worthless|garbage", "partnership": "partner", "spam": "free", "discussion": "question|was", "task_object": "thing"}
PATTERNS = rules.Patterns(**{k: rf"\b({v})\b" for k, v in WORDS.items() if k != "task_object"}, task_object=r"\b(thing)\w*\b")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


def _posts(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("message_id"), F.col("source").alias("source_id"), "text", F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, cast(doc_id % 720 as int), 0, 0)").alias("published_at"))


def _normal(spark: SparkSession, d: str) -> DataFrame:
    return _posts(spark, d).withColumn("normalized_text", text.normalize_text(F.col("text")))


def _feed(spark: SparkSession, d: str) -> DataFrame:
    money = F.col("o_totalprice").cast("decimal(14,2)")
    return _table(spark, d, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("source_id"), F.col("o_orderpriority").alias("project_type"), F.concat(F.lit("Order "), F.col("o_orderkey")).alias("title"), F.concat_ws(" ", "o_orderpriority", F.lit("for"), "o_custkey").alias("summary"),
        money.alias("budget_from"), (money * 2).cast("decimal(14,2)").alias("budget_to"), F.lit("USD").alias("budget_currency"), (F.col("o_orderkey") % 101).cast("int").alias("relevance_score"), F.col("o_orderdate").cast("timestamp").alias("published_at"),
        F.when(F.col("o_orderstatus") == "O", "new").when(F.col("o_orderstatus") == "F", "contacted").otherwise("viewed").alias("status"), (F.col("o_orderkey") % 3 + 1).cast("int").alias("version"), F.lit(True).alias("is_fresh"),
    )


# ---- posts ----


def prefilter_by_source(spark: SparkSession, d: str) -> DataFrame:
    done = posts.process_messages(_posts(spark, d), POSITIVE, NEGATIVE, _as_of())
    lang = text.language_by_markers(F.col("normalized_text"), MARKERS)
    return done.groupBy("source_id", lang.alias("lang")).agg(F.count("*").alias("posts"), F.count_if("passed_prefilter").alias("passed"))


def language_mix(spark: SparkSession, d: str) -> DataFrame:
    told = _normal(spark, d).join(_table(spark, d, "documents").select(F.col("doc_id").alias("message_id"), "lang"), "message_id")
    return told.groupBy("lang", text.language_by_markers(F.col("normalized_text"), MARKERS).alias("detected"), text.detect_language(F.col("normalized_text")).alias("script")).agg(F.count("*").alias("posts"))


def keyword_hits(spark: SparkSession, d: str) -> DataFrame:
    return text.keyword_hits(_normal(spark, d).select("message_id", "normalized_text"), POSITIVE + NEGATIVE).select("message_id", "phrase", "matched_text", "weight")


def fuzzy_hits(spark: SparkSession, d: str) -> DataFrame:
    return text.keyword_hits(_normal(spark, d).select("message_id", "normalized_text"), FUZZY).select("message_id", "phrase", "matched_text", "is_fuzzy", "distance")


def regex_rule_hits(spark: SparkSession, d: str) -> DataFrame:
    return text.keyword_hits(_normal(spark, d).select("message_id", "normalized_text"), REGEX).groupBy("message_id", "matched_text").agg(F.count("*").alias("n"))


def contact_entities(spark: SparkSession, d: str) -> DataFrame:
    return _posts(spark, d).select("message_id", F.explode(extract.contacts(F.col("text"))).alias("e")).select("message_id", "e.value_norm.kind", "e.value_norm.value")


def budget_entities(spark: SparkSession, d: str) -> DataFrame:
    found = _normal(spark, d).select("message_id", F.explode(extract.budget(F.col("normalized_text"))).alias("e"))
    return found.select("message_id", "e.value_text", "e.value_norm.amount_from", "e.value_norm.amount_to", "e.value_norm.currency")


def entity_types(spark: SparkSession, d: str) -> DataFrame:
    done = posts.process_messages(_posts(spark, d), POSITIVE, NEGATIVE, _as_of(), project_rules=PROJECTS)
    return posts.entity_rows(done).groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("message_id").alias("posts"))


def _classified(spark: SparkSession, d: str, settings: Settings = DEFAULT) -> DataFrame:
    return posts.classify(posts.process_messages(_posts(spark, d), POSITIVE, NEGATIVE, _as_of(), settings, project_rules=PROJECTS), _as_of(), PATTERNS, settings)


def rules_labels(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).groupBy("label", F.col("confidence").cast("double").alias("confidence"), "manual_review").agg(F.count("*").alias("posts"), F.sum("relevance_score").alias("relevance"))


def orders_built(spark: SparkSession, d: str) -> DataFrame:
    """From posts to deduplicated orders: the flagship flow."""
    settings = Settings(order_min_relevance=40, freshness_days=30)
    made = posts.build_orders(_classified(spark, d, settings), _as_of(), settings)
    return dedup.deduplicate_orders(made, _as_of(), 30).select("message_id", "source_id", "project_type", "title", "relevance_score", F.coalesce("group_size", F.lit(1)).alias("group_size"), (F.coalesce("canonical_order_id", "order_id") == F.col("order_id")).alias("is_canonical"))


def exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))
    return dedup.canonical(docs, "content_hash", [F.col("doc_id")], "doc_id").where("size > 1")


def fingerprint_groups(spark: SparkSession, d: str) -> DataFrame:
    plain = F.lit(None).cast("string")
    made = _normal(spark, d).withColumns({"summary": plain, "project_type": F.col("source_id"), "contacts": F.lit(None).cast("map<string,array<string>>"), "budget_from": F.lit(None).cast("decimal(14,2)"), "budget_to": F.lit(None).cast("decimal(14,2)"), "budget_currency": plain, "budget_negotiable": F.lit(False)})
    return dedup.canonical(dedup.fingerprint(made), "duplicate_fingerprint", [F.col("published_at"), F.col("message_id")], "message_id").where("size > 1").select("canonical", "size")


def shard_assignment(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").groupBy(text.shard_for(F.col("source"), 7).alias("shard"), "source").agg(F.count("*").alias("posts"))


def masked_texts(spark: SparkSession, d: str) -> DataFrame:
    return _posts(spark, d).select("message_id", F.sha2(text.mask_pii(F.col("text")).cast("binary"), 256).alias("masked_sha256"))


def hash_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Hashed embeddings of whole texts, with the operator's own dimension and aliases."""
    none = F.lit(None).cast("string")
    whole = _posts(spark, d).select("message_id", none.alias("project_type"), none.alias("title"), F.col("text").alias("summary"), none.alias("deadline_text"), F.lit(None).cast("array<float>").alias("embedding"))
    return semantic.embed_orders(whole).select("message_id", F.array_join(F.transform("embedding", lambda x: F.format_string("%.4f", F.round(x.cast("double"), 6))), ",").alias("vector"))


def source_links(spark: SparkSession, d: str) -> DataFrame:
    """Links to chats made from pages: a host's first label as the name."""
    pages = _table(spark, d, "pages")
    label = F.regexp_extract("url", r"://([^./]+)", 1)
    n = F.col("page_id") % 5
    link = F.when(n == 0, F.concat(F.lit("@"), label)).when(n == 1, F.concat(F.lit("https://t.me/"), label, F.lit("/5"))).when(n == 2, F.concat(F.lit("t.me/joinchat/"), label)).when(n == 3, F.col("url")).otherwise(F.concat(F.lit(" "), label, F.lit("bot ")))
    return pages.select("page_id", text.source_link(link).alias("l")).select("page_id", "l.username", "l.error")


# ---- the feed ----


def order_feed_page(spark: SparkSession, d: str) -> DataFrame:
    return orders.feed_page(_feed(spark, d), 3, 50).select("order_id", "published_at", "relevance_score")


def order_filters(spark: SparkSession, d: str) -> DataFrame:
    f = orders.OrderFilters(date_from=date(1995, 1, 1), budget_min=100000, budget_max=150000, project_type=["1-URGENT", "2-HIGH"], relevance_min=20, status=["new", "viewed"], q="HIGH for 1")
    return orders.filter_orders(_feed(spark, d), f).select("order_id", F.col("budget_from").cast("double").alias("budget_from"), F.col("budget_to").cast("double").alias("budget_to"), "status")


def order_export(spark: SparkSession, d: str) -> DataFrame:
    return orders.export_orders(_feed(spark, d)).select("order_id", "status", "relevance_score", "project_type", "budget_from", "title", "message_url")


def stats_summary(spark: SparkSession, d: str) -> DataFrame:
    labels = _table(spark, d, "labels").select(F.when(F.col("toxic") == 1, "spam").when(F.col("quality") == 1, "order").otherwise("irrelevant").alias("label"))
    return activity.stats_summary(_feed(spark, d), _table(spark, d, "customer"), labels)


def status_transitions(spark: SparkSession, d: str) -> DataFrame:
    feed = _feed(spark, d)
    asked = feed.select(F.when(F.col("order_id") % 10 == 9, -F.col("order_id")).otherwise(F.col("order_id")).alias("order_id"), F.element_at(F.array(*map(F.lit, ["viewed", "contacted", "archived"])), (F.col("order_id") % 3 + 1).cast("int")).alias("next_status"), F.when(F.col("order_id") % 7 == 0, 9).otherwise(F.col("version")).alias("version"))
    return orders.change_status(feed, asked).groupBy("outcome", "new_status").agg(F.count("*").alias("n"), F.sum(F.coalesce("new_version", F.lit(0))).alias("versions"))


def stale_archive(spark: SparkSession, d: str) -> DataFrame:
    done = orders.archive_stale(_feed(spark, d), F.lit("1998-01-01 00:00:00").cast("timestamp"), 365)
    return done.groupBy("status", "is_fresh", "archived_now").agg(F.count("*").alias("n"))


def canonical_orders(spark: SparkSession, d: str) -> DataFrame:
    feed = _feed(spark, d)
    return dedup.canonical(feed, "source_id", [F.col("published_at"), -F.col("relevance_score"), F.col("order_id")], "order_id").where("size > 1")


def subscription_matches(spark: SparkSession, d: str) -> DataFrame:
    """Orders against a subscription for each customer, every twentieth of which names a project type."""
    users = _table(spark, d, "customer")
    empty = F.array().cast("array<string>")
    subs = users.select(
        F.col("c_custkey").alias("subscription_id"), (F.col("c_custkey") % 50).alias("user_id"), F.lit(AS_OF).cast("timestamp").alias("created_at"), F.lit(True).alias("enabled"), (F.col("c_custkey") % 100).cast("int").alias("min_relevance_score"),
        F.when(F.col("c_custkey") % 20 == 0, F.array(F.lit("1-URGENT"))).otherwise(empty).alias("project_types"), F.lit(300000).cast("decimal(14,2)").alias("budget_min"), F.lit(None).cast("decimal(14,2)").alias("budget_max"),
        F.array(F.lit("usd")).alias("currencies"), F.lit(None).cast("array<bigint>").alias("source_ids"), empty.alias("positive_keywords"), F.array(F.lit("for 7")).alias("negative_keywords"), F.lit(None).cast("int").alias("freshness_days"),
    )
    feed = _feed(spark, d).withColumn("normalized_text", F.lit(""))
    met = notify.match_pairs(feed, subs, _as_of(), compose=False)
    return met.select("order_id", F.col("subscription.user_id").alias("user_id"), F.col("subscription.subscription_id").alias("subscription_id"))


def subscription_matches_all(spark: SparkSession, d: str) -> DataFrame:
    """Orders against a subscription for each customer: types by segment, budgets by balance.  No SQL: tests/test_whole_jobs.py has brute force."""
    empty, segment = F.array().cast("array<string>"), F.col("c_mktsegment")
    subs = _table(spark, d, "customer").select(
        F.col("c_custkey").alias("subscription_id"), (F.col("c_custkey") % 50).alias("user_id"), F.lit(AS_OF).cast("timestamp").alias("created_at"), F.lit(True).alias("enabled"), (F.col("c_custkey") % 100).cast("int").alias("min_relevance_score"),
        F.when(segment == "BUILDING", F.array(F.lit("1-URGENT"))).when(segment == "MACHINERY", F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))).otherwise(empty).alias("project_types"),
        (F.greatest(F.col("c_acctbal"), F.lit(0.0)) * 30).cast("decimal(14,2)").alias("budget_min"), F.lit(None).cast("decimal(14,2)").alias("budget_max"),
        F.array(F.lit("usd")).alias("currencies"), F.lit(None).cast("array<bigint>").alias("source_ids"), empty.alias("positive_keywords"), F.array(F.lit("for 7")).alias("negative_keywords"), F.lit(None).cast("int").alias("freshness_days"),
    )
    met = notify.match_pairs(_feed(spark, d).withColumn("normalized_text", F.lit("")), subs, _as_of(), compose=False)
    return met.select("order_id", F.col("subscription.user_id").alias("user_id"), F.col("subscription.subscription_id").alias("subscription_id"))


# ---- events ----


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def source_activity(spark: SparkSession, d: str) -> DataFrame:
    """Users as sources; views as posts, purchases as orders, clicks as spam."""
    e = _events(spark, d)
    sources = e.select(F.col("user_id").alias("source_id")).distinct().withColumn("type", F.when(F.col("source_id") % 2 == 0, "megagroup").otherwise("channel"))
    messages = e.select(F.col("event_id").alias("message_id"), F.col("user_id").alias("source_id"), F.col("ts").alias("published_at"), F.lit(None).cast("timestamp").alias("deleted_at"), (F.col("value") > 50).alias("passed_prefilter"))
    made = e.where("event_type = 'purchase'").select(F.col("user_id").alias("source_id"), F.col("ts").alias("published_at"), F.least(F.col("value"), F.lit(100.0)).alias("relevance_score"), F.when(F.col("event_id") % 4 == 0, F.lit("g")).alias("duplicate_group_id"))
    told = e.select(F.col("event_id").alias("message_id"), F.when(F.col("event_type") == "click", "spam").otherwise("order").alias("label"))
    out = activity.score_sources(sources, messages, made, told, F.lit("2024-01-30 00:00:00").cast("timestamp"))
    return out.select("source_id", "msg_count", "active_days", "order_candidates", "spam", "relevant_orders", "dup", "activity_score", "activity_status", "poll_mode")


def runtime_gauges(spark: SparkSession, d: str) -> DataFrame:
    sources = _table(spark, d, "customer").select((F.col("c_acctbal") > 0).alias("enabled"), F.when(F.col("c_nationkey") < 20, "ok").when(F.col("c_nationkey") < 24, "floodwait").otherwise("odd").alias("access_status"), F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(c_custkey % 1000 as int), 0)").alias("last_checked_at"))
    return activity.runtime_gauges(_events(spark, d).where("event_type = 'error'"), sources, _as_of())


def latency_histogram(spark: SparkSession, d: str) -> DataFrame:
    return activity.latency_histogram(_events(spark, d), "value", [1.0, 5.0, 10.0, 50.0, 100.0, 500.0])


def rate_limited_deliveries(spark: SparkSession, d: str) -> DataFrame:
    sent = _events(spark, d).select("event_id", "user_id", F.col("ts").alias("sent_at"))
    return notify.rate_limited(sent, 720, 2).select("event_id", "recent", "limited")


def similar_cooldown(spark: SparkSession, d: str) -> DataFrame:
    e = _events(spark, d)
    sent = e.where("event_type = 'purchase'").select("user_id", F.lit("sent").alias("status"), (F.col("event_id") % 20).alias("duplicate_fingerprint"), F.col("event_id").alias("order_id"), F.col("ts").alias("sent_at"))
    asked = e.where("event_type <> 'purchase'").select("user_id", (F.col("event_id") % 20).alias("duplicate_fingerprint"), F.col("event_id").alias("order_id"), F.lit(60 * 24 * 20).alias("similar_cooldown_minutes"))
    return notify.similar_sent(asked, sent, F.lit("2024-01-30 00:00:00").cast("timestamp")).select("order_id", "user_id")


def quiet_hours(spark: SparkSession, d: str) -> DataFrame:
    zone = F.when(F.col("user_id") % 2 == 0, "Europe/Moscow").otherwise("America/New_York")
    e = _events(spark, d).withColumns({"zone": zone, "a": F.lit("22:00"), "b": F.lit("07:30")})
    args = [F.col(c) for c in ("ts", "a", "b", "zone")]
    return e.select("event_id", notify.in_quiet_hours(*args).alias("quiet"), F.date_format(notify.next_quiet_end(*args), "yyyy-MM-dd HH:mm:ss").alias("until"))


def streaming_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Each event twice through a stream that drops repeats, into a shared table; run to its end, then read."""
    every = _table(spark, d, "events")
    source = spark.readStream.schema(every.schema).parquet(f"{d}/events.parquet*")
    twice = source.withColumn("ts", F.col("ts").cast("timestamp")).select("event_id", "ts", "event_type", F.explode(F.array(F.lit(1), F.lit(2))).alias("n")).drop("n")
    root = f"{shared_dir(spark)}/gleaner-stream-{uuid.uuid4().hex}"
    kept = streams.drop_repeats(twice, ["event_id"], "ts", "1 day")
    kept.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id long, ts timestamp, event_type string").parquet(f"{root}/out").groupBy("event_type").agg(F.count("*").alias("n"))


def retention_months(spark: SparkSession, d: str) -> DataFrame:
    feed = _feed(spark, d).select("published_at")
    return merge.expired_months(feed, F.lit("1996-01-15 00:00:00").cast("timestamp")).withColumn("published_month", F.col("published_month").cast("string"))


# ---- merges ----


def _messages(spark: SparkSession, d: str) -> DataFrame:
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return _posts(spark, d).select("source_id", F.col("message_id").alias("tg_message_id"), "text", "published_at", text.content_hash(F.col("text")).alias("content_hash"), stamp.alias("collected_at"), F.when(F.col("message_id") % 11 == 0, stamp).alias("deleted_at"))


def merge_messages(spark: SparkSession, d: str) -> DataFrame:
    """Documents split by id: those not 0 mod 3 are stored, those not 1 mod 3 come in, some edited."""
    every = _messages(spark, d)
    new = every.where("tg_message_id % 3 <> 1").withColumn("text", F.when(F.col("tg_message_id") % 5 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text"))).withColumn("content_hash", text.content_hash(F.col("text")))
    return merge.upsert_messages(every.where("tg_message_id % 3 <> 0"), new, _as_of()).groupBy("action").agg(F.count("*").alias("n"), F.count("deleted_at").alias("deleted"), F.sum(F.length("text")).alias("chars"), F.count_if(F.col("collected_at") == _as_of()).alias("collected_now"))


def soft_deletes(spark: SparkSession, d: str) -> DataFrame:
    every = _messages(spark, d)
    return merge.soft_delete_missing(every, every.where("tg_message_id % 4 <> 2"), _as_of()).groupBy("source_id", "action").agg(F.count("*").alias("n"), F.count("deleted_at").alias("deleted"))


def high_water(spark: SparkSession, d: str) -> DataFrame:
    every = _messages(spark, d)
    sources = every.groupBy("source_id").agg((F.min("tg_message_id") + 300).alias("last_seen_message_id")).withColumn("last_checked_at", F.lit(None).cast("timestamp"))
    return merge.advance_high_water(sources, every.where("tg_message_id % 2 = 0 and source_id <> 'src1'"), _as_of()).select("source_id", "last_seen_message_id", F.col("last_checked_at").isNotNull().alias("checked"))


def _scanned(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    raw = _posts(spark, d).select("source_id", F.col("message_id").alias("id"), F.col("published_at").alias("date"))
    return raw, raw.select("source_id").distinct().withColumn("last_seen_message_id", F.when(F.col("source_id") == "src0", 100).otherwise(0).cast("long"))


def incremental_scan(spark: SparkSession, d: str) -> DataFrame:
    """The oldest 500 new posts of each source, a collector's batch; incremental_scan_all takes every new post."""
    return merge.incremental_scan(*_scanned(spark, d), _as_of(), cap=BATCH)


def incremental_scan_all(spark: SparkSession, d: str) -> DataFrame:
    return merge.incremental_scan(*_scanned(spark, d), _as_of())


def constraint_violations(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    return merge.check_constraints(docs, {"text_present": F.col("text").isNotNull(), "chars_match": F.length("text") == F.col("n_chars"), "known_lang": F.col("lang").isin("en", "fr", "de"), "short": F.col("n_chars") <= 5000}, {"unique_id": ["doc_id"], "unique_text": ["text"]})


# ---- vectors and labels ----


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """The three nearest vectors of the same label for each vector."""
    return semantic.similar_pairs(_table(spark, d, "embeddings"), "vec_id", "embedding", "label", most=3).select("vec_id", "other", "rank", F.round("similarity", 4).alias("similarity"))


def semantic_pairs(spark: SparkSession, d: str) -> DataFrame:
    return semantic.similar_pairs(_table(spark, d, "embeddings"), "vec_id", "embedding", "label", least=0.82).select("vec_id", "other", F.when(F.col("similarity") >= 0.9, "auto_merge").otherwise("manual_review").alias("outcome"))


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    told = _table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label"))
    return _table(spark, d, "documents").join(told, "doc_id").select("doc_id", "label", text.content_hash(F.col("text")).alias("text_hash"))


def holdout_split(spark: SparkSession, d: str) -> DataFrame:
    return ml.holdout_split(_labelled(spark, d)).select("doc_id", "label", "holdout")


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    told = _table(spark, d, "labels").select(F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label"), F.when(F.col("toxic") == 1, "bad").otherwise("good").alias("predicted"))
    return activity.confusion(told)


def evaluation(spark: SparkSession, d: str) -> DataFrame:
    told = _table(spark, d, "labels").select(F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label"), F.when(F.col("toxic") == 1, "bad").otherwise("good").alias("predicted"))
    return activity.evaluate(told, ["good", "bad", "odd"])


# ---- SQL ----

_N = r"trim(regexp_replace(lower(regexp_replace(nfc_normalize(coalesce(text, '')), '[\p{Mn}\p{So}]', '', 'g')), '\s+', ' ', 'g'))"
_POSTS = f"posts AS (SELECT doc_id AS message_id, source AS source_id, text, TIMESTAMP '2024-01-01' + to_hours((doc_id % 720)::INT) AS published_at, {_N} AS n FROM documents)"
_EDGE_L, _EDGE_R = r"(?:^|[^\p{L}\d_])", r"(?:[^\p{L}\d_]|$)"


def _has(words: str, column: str = "n", tail: str = "") -> str:
    return f"regexp_matches({column}, '{_EDGE_L}(?:{words}){tail}{_EDGE_R}')"


def _any(rs: list[text.Rule]) -> str:
    """Exact phrase, or for one long word a word within one edit."""
    tests = []
    for r in rs:
        t = _has(r.phrase.replace(" ", r"\s+"))
        if " " not in r.phrase and len(r.phrase) >= 6:
            t = f"({t} OR len([w FOR w IN {_WORDS} IF len(w) >= 6 AND levenshtein('{r.phrase}', w) <= 1]) > 0)"
        tests.append(t)
    return "(" + " OR ".join(tests) + ")"


_WORDS = r"regexp_extract_all(n, '[\p{L}\p{M}\d_-]+')"
_LANG = f"CASE WHEN {_has('und')} THEN 'de' WHEN {_has('les')} THEN 'fr' WHEN {_has('que')} THEN 'es' ELSE 'unknown' END"
_FEED = """feed AS (
  SELECT o_orderkey AS order_id, o_custkey AS source_id, o_orderpriority AS project_type, 'Order ' || o_orderkey AS title, o_orderpriority || ' for ' || o_custkey AS summary, o_totalprice::DECIMAL(14,2) AS budget_from, (o_totalprice::DECIMAL(14,2) * 2)::DECIMAL(14,2) AS budget_to,
    (o_orderkey % 101)::INT AS relevance_score, o_orderdate::TIMESTAMP AS published_at, CASE o_orderstatus WHEN 'O' THEN 'new' WHEN 'F' THEN 'contacted' ELSE 'viewed' END AS status, (o_orderkey % 3 + 1)::INT AS version FROM orders)"""
_NUM, _SUF, _CUR = r"\d[\d\s.]*", r"(тыс|k|к)?", r"(руб\.?|р\.?|₽|rub|\$|usd|€|eur|грн|uah|тенге|kzt|бел)?"
_RANGE = rf"(?i)(?:от\s+)?({_NUM})\s*{_SUF}\s*(?:-|–|—|\s+до\s+)\s*({_NUM})\s*{_SUF}\s*{_CUR}"
_MONEY = rf"(?i)({_NUM})\s*{_SUF}\s*{_CUR}"
_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in extract.CURRENCIES.items()) + "}"


#: What Java's Unicode word characters are, in the oracle's patterns.
_MASKED = r"\p{L}\p{M}\p{Nd}\p{Pc}"


def _amount(raw: str, suffix: str) -> str:
    return f"TRY_CAST(regexp_replace({raw}, '[^0-9]', '', 'g') AS BIGINT) * CASE WHEN lower({suffix}) IN ('тыс', 'k', 'к') THEN 1000 ELSE 1 END"


def _currency(raw: str) -> str:
    return f"{_MAP}[replace(lower({raw}), '.', '')]"


_SIGNALS = f"""{_POSTS},
hits AS (SELECT *, {_any(POSITIVE)} AS pos, {_any(NEGATIVE)} AS neg, contains(n, 'license') OR contains(n, 'free') OR contains(n, 'thing') AS niche FROM posts),
sig AS (
  SELECT *, CASE WHEN pos OR {_has(WORDS["need"])} THEN 1.0::DOUBLE ELSE 0 END AS need,
    CASE WHEN niche OR {_has(WORDS["task"])} THEN 1.0::DOUBLE WHEN {_has(WORDS["task_object"], tail=chr(92) + "p{L}*")} THEN 0.5 ELSE 0 END AS task,
    CASE WHEN b.message_id IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END AS budget, CASE WHEN c.message_id IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END AS contact,
    greatest(0, least(1, 1 - greatest(0, epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(published_at)) / 86400e6 / 7))::DOUBLE AS fresh,
    CASE WHEN neg OR {_has(WORDS["service_ad"])} THEN 1.0::DOUBLE ELSE 0 END AS ad, CASE WHEN {_has(WORDS["spam"])} THEN 1.0::DOUBLE ELSE 0 END AS spam
  FROM hits LEFT JOIN (SELECT message_id FROM ({{budgets}})) b USING (message_id) LEFT JOIN (SELECT DISTINCT message_id FROM ({{contacts}})) c USING (message_id)),
sig2 AS (
  SELECT *, CASE WHEN {_has(WORDS["vacancy"])} OR {_has(WORDS["resume"])} THEN least(greatest(0, least(1, 1 - 0.75 * ad - 0.35 * spam)), 0.35) ELSE greatest(0, least(1, 1 - 0.75 * ad - 0.35 * spam)) END AS client,
    0.32::DOUBLE * need + 0.24::DOUBLE * task + 0.16::DOUBLE * niche::INT + 0.12::DOUBLE * budget + 0.08::DOUBLE * contact AS strength FROM sig),
told AS (
  SELECT *, CASE WHEN n = '' THEN 'irrelevant' WHEN {_has(WORDS["spam"])} THEN 'spam' WHEN {_has(WORDS["vacancy"])} THEN 'vacancy' WHEN {_has(WORDS["resume"])} THEN 'resume' WHEN {_has(WORDS["partnership"])} THEN 'partnership'
      WHEN neg OR {_has(WORDS["service_ad"])} THEN 'service_ad' WHEN {_has(WORDS["discussion"])} AND need < 1 THEN 'discussion' WHEN NOT (pos AND NOT neg) AND NOT pos AND strength < 0.42 THEN 'irrelevant'
      WHEN strength >= 0.58 AND ad < 0.5 AND spam < 0.5 THEN 'order' WHEN strength >= 0.42 THEN 'order' WHEN {_has(WORDS["discussion"])} THEN 'discussion' ELSE 'irrelevant' END AS label,
    CASE WHEN n = '' THEN 0.9 WHEN {_has(WORDS["spam"])} THEN 0.92 WHEN {_has(WORDS["vacancy"])} THEN 0.86 WHEN {_has(WORDS["resume"])} THEN 0.86 WHEN {_has(WORDS["partnership"])} THEN 0.82
      WHEN neg OR {_has(WORDS["service_ad"])} THEN 0.88 WHEN {_has(WORDS["discussion"])} AND need < 1 THEN 0.76 WHEN NOT (pos AND NOT neg) AND NOT pos AND strength < 0.42 THEN 0.9
      WHEN strength >= 0.58 AND ad < 0.5 AND spam < 0.5 THEN least(0.95, greatest(0.62, strength + 0.18)) WHEN strength >= 0.42 THEN 0.55 WHEN {_has(WORDS["discussion"])} THEN 0.72 ELSE 0.78 END AS conf,
    round_even(greatest(0, least(1, 0.18::DOUBLE * need + 0.16::DOUBLE * task + 0.14::DOUBLE * budget + 0.10::DOUBLE * contact + 0.14::DOUBLE * niche::INT + 0.08::DOUBLE * fresh + 0.12::DOUBLE * client - 0.10::DOUBLE * ad - 0.10::DOUBLE * spam)) * 100, 0)::INT AS raw
  FROM sig2)"""

_BUDGETS = f"""SELECT message_id, value_text, amount_from, amount_to, currency FROM (
  SELECT message_id, r AS value_text, {_amount("regexp_extract(n, '" + _RANGE + "', 1)", "regexp_extract(n, '" + _RANGE + "', 2)")} AS amount_from, {_amount("regexp_extract(n, '" + _RANGE + "', 3)", "regexp_extract(n, '" + _RANGE + "', 4)")} AS amount_to, {_currency("regexp_extract(n, '" + _RANGE + "', 5)")} AS currency
  FROM (SELECT *, regexp_extract(n, '{_RANGE}') AS r FROM posts WHERE regexp_matches(n, '{_RANGE}'))
  UNION ALL
  SELECT message_id, m, {_amount("regexp_extract(m, '" + _MONEY + "', 1)", "regexp_extract(m, '" + _MONEY + "', 2)")}, {_amount("regexp_extract(m, '" + _MONEY + "', 1)", "regexp_extract(m, '" + _MONEY + "', 2)")}, {_currency("regexp_extract(m, '" + _MONEY + "', 3)")}
  FROM (SELECT message_id, [x FOR x IN regexp_extract_all(n, '{_MONEY}') IF regexp_extract(x, '{_MONEY}', 2) <> '' OR {_currency("regexp_extract(x, '" + _MONEY + "', 3)")} IS NOT NULL][1] AS m FROM posts WHERE NOT regexp_matches(n, '{_RANGE}')) WHERE m IS NOT NULL)"""
_CONTACTS = r"""SELECT DISTINCT message_id, kind, value FROM (
  SELECT message_id, 'email' AS kind, lower(unnest(regexp_extract_all(text, '(?i)([\p{L}\d_.+-]+@[\p{L}\d_-]+(?:\.[\p{L}\d_-]+)+)(?:[^\p{L}\d_.+-]|$)', 1))) AS value FROM posts
  UNION ALL SELECT message_id, 'phone', regexp_replace(unnest(regexp_extract_all(text, '(?:^|[^\d+])(\+?\d[\d\s()\-]{7,}\d)', 1)), '[^\d+]', '', 'g') FROM posts)"""

ORACLES = {
    "prefilter_by_source": f"WITH {_POSTS} SELECT source_id, {_LANG} AS lang, count(*) AS posts, count(*) FILTER (WHERE n <> '' AND {_any(POSITIVE)} AND NOT {_any(NEGATIVE)}) AS passed FROM posts GROUP BY ALL",
    "language_mix": f"WITH {_POSTS} SELECT d.lang, {_LANG} AS detected, CASE WHEN regexp_matches(n, '[a-z]') THEN 'en' ELSE 'unknown' END AS script, count(*) AS posts FROM posts p JOIN documents d ON d.doc_id = p.message_id GROUP BY ALL",
    "keyword_hits": f"WITH {_POSTS} " + " UNION ALL ".join(
        f"SELECT message_id, '{r.phrase}' AS phrase, matched_text, {r.weight} AS weight FROM (SELECT message_id, CASE WHEN {_has(p)} THEN regexp_extract(n, '{_EDGE_L}({p}){_EDGE_R}', 1) " + (f"ELSE [w FOR w IN {_WORDS} IF len(w) >= 6 AND levenshtein('{r.phrase}', w) <= 1][1] " if " " not in r.phrase and len(r.phrase) >= 6 else "") + "END AS matched_text FROM posts) WHERE matched_text IS NOT NULL"
        for r in POSITIVE + NEGATIVE for p in [r.phrase.replace(" ", r"\s+")]
    ),
    "fuzzy_hits": f"WITH {_POSTS} " + " UNION ALL ".join(
        f"SELECT message_id, '{r.phrase}' AS phrase, CASE WHEN hit THEN '{r.phrase}' ELSE w END AS matched_text, NOT hit AND levenshtein('{r.phrase}', w) > 0 AS is_fuzzy, CASE WHEN hit THEN 0 ELSE levenshtein('{r.phrase}', w) END::INT AS distance FROM (SELECT message_id, {_has(r.phrase)} AS hit, [w FOR w IN {_WORDS} IF len(w) >= 6 AND levenshtein('{r.phrase}', w) <= 1][1] AS w FROM posts) WHERE hit OR w IS NOT NULL"
        for r in FUZZY
    ),
    "regex_rule_hits": f"WITH {_POSTS} SELECT message_id, matched_text, count(*) AS n FROM (SELECT message_id, unnest(regexp_extract_all(n, 'th[a-z]+tion')) AS matched_text FROM posts) GROUP BY ALL",
    "contact_entities": f"WITH {_POSTS} {_CONTACTS}",
    "budget_entities": f"WITH {_POSTS} {_BUDGETS}",
    "rules_labels": "WITH " + _SIGNALS.replace("{budgets}", _BUDGETS).replace("{contacts}", _CONTACTS) + " SELECT label, round(conf, 4)::DOUBLE AS confidence, conf BETWEEN 0.4 AND 0.6 AS manual_review, count(*) AS posts, sum(CASE WHEN label = 'order' THEN raw ELSE 0 END)::BIGINT AS relevance FROM told GROUP BY ALL",
    "exact_duplicates": "SELECT sha256(coalesce(text, '')) AS content_hash, min(doc_id) AS canonical, count(*) AS size FROM documents GROUP BY 1 HAVING count(*) > 1",
    "fingerprint_groups": f"WITH {_POSTS} SELECT arg_min(message_id, published_at::VARCHAR || lpad(message_id::VARCHAR, 20, '0')) AS canonical, count(*) AS size FROM posts GROUP BY n, source_id HAVING count(*) > 1",
    "entity_types": "WITH " + _SIGNALS.split("sig AS (")[0].rstrip(", \n") + f""", e AS (
        {" UNION ALL ".join(f"SELECT 'keyword' AS type, message_id FROM posts WHERE {_any([r])}" for r in POSITIVE)} UNION ALL {" UNION ALL ".join(f"SELECT 'negative_keyword', message_id FROM posts WHERE {_any([r])}" for r in NEGATIVE)}
        UNION ALL SELECT 'project_type', message_id FROM hits WHERE niche UNION ALL SELECT 'budget', message_id FROM ({_BUDGETS}) UNION ALL SELECT 'contact', message_id FROM ({_CONTACTS}))
        SELECT type, count(*) AS n, count(DISTINCT message_id) AS posts FROM e GROUP BY type""",
    "orders_built": "WITH " + _SIGNALS.replace("/ 86400e6 / 7", "/ 86400e6 / 30").replace("{budgets}", _BUDGETS).replace("{contacts}", _CONTACTS) + f""",
        made AS (SELECT *, sha256(message_id::VARCHAR) AS id, CASE WHEN contains(n, 'license') THEN 'license' WHEN contains(n, 'free') THEN 'free' WHEN contains(n, 'thing') THEN 'thing' END AS project_type FROM told
            WHERE label = 'order' AND round(conf, 4) >= 0.6 AND NOT conf BETWEEN 0.4 AND 0.6 AND raw >= 40 AND published_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY),
        g AS (SELECT *, count(*) OVER (PARTITION BY n) AS size, row_number() OVER (PARTITION BY n ORDER BY published_at, -raw, id) AS k FROM made)
        SELECT message_id, source_id, project_type, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 80) AS title, raw AS relevance_score, size AS group_size, k = 1 AS is_canonical FROM g""",
    "masked_texts": f"""WITH {_POSTS}, a AS (SELECT message_id, regexp_replace(n, '[{_MASKED}.+-]+@[{_MASKED}-]+(?:\\.[{_MASKED}-]+)+', ' email ', 'g') AS t FROM posts), b AS (SELECT message_id, regexp_replace(t, '@[a-zA-Z][{_MASKED}]{{4,31}}', ' username ', 'g') AS t FROM a),
        c AS (SELECT message_id, regexp_replace(t, 'https?://[^ ]+|t\\.me/[^ ]+', ' url ', 'g') AS t FROM b), e AS (SELECT message_id, regexp_replace(t, '\\+?\\p{{Nd}}[\\p{{Nd}}\\s()-]{{7,}}\\p{{Nd}}', ' phone ', 'g') AS t FROM c)
        SELECT message_id, sha256(trim(regexp_replace(t, ' +', ' ', 'g'))) AS masked_sha256 FROM e""",
    "source_links": r"""WITH l AS (SELECT page_id, regexp_extract(url, '://([^./]+)', 1) AS lab, url FROM pages), k AS (
      SELECT page_id, CASE page_id % 5 WHEN 2 THEN 'SOURCE_NOT_PUBLIC' END AS priv, lower(CASE page_id % 5 WHEN 0 THEN lab WHEN 1 THEN lab WHEN 2 THEN 'joinchat' WHEN 3 THEN '' ELSE lab || 'bot' END) AS name, lab FROM l), e AS (
      SELECT page_id, name, CASE WHEN priv IS NOT NULL THEN priv WHEN page_id % 5 = 1 AND (starts_with(lab, 'joinchat') OR starts_with(lab, '+') OR starts_with(lab, 'c')) THEN 'SOURCE_NOT_PUBLIC' WHEN NOT regexp_full_match(name, '[a-z][a-z0-9_]{4,31}') OR ends_with(name, 'bot') THEN 'INVALID_SOURCE_USERNAME' END AS error FROM k)
      SELECT page_id, CASE WHEN error IS NULL THEN name END AS username, error FROM e""",
    "order_feed_page": f"WITH {_FEED} SELECT order_id, published_at, relevance_score FROM feed ORDER BY published_at DESC, relevance_score DESC, order_id LIMIT 50 OFFSET 100",
    "order_filters": f"WITH {_FEED} SELECT order_id, budget_from::DOUBLE AS budget_from, budget_to::DOUBLE AS budget_to, status FROM feed WHERE published_at::DATE >= DATE '1995-01-01' AND (budget_from >= 100000 OR budget_to >= 100000) AND (budget_from <= 150000 OR budget_to <= 150000) AND project_type IN ('1-URGENT', '2-HIGH') AND relevance_score >= 20 AND status IN ('new', 'viewed') AND (contains(lower(title), 'high for 1') OR contains(lower(summary), 'high for 1'))",
    "order_export": f"WITH {_FEED} SELECT order_id::VARCHAR AS order_id, status, relevance_score::VARCHAR AS relevance_score, project_type, budget_from::VARCHAR AS budget_from, title, NULL::VARCHAR AS message_url FROM feed ORDER BY published_at DESC, feed.relevance_score DESC, feed.order_id LIMIT 1000",
    "stats_summary": f"WITH {_FEED}, l AS (SELECT CASE WHEN toxic = 1 THEN 'spam' WHEN quality = 1 THEN 'order' ELSE 'irrelevant' END AS label FROM labels) SELECT 'orders' AS metric, '' AS name, count(*) AS n FROM feed UNION ALL SELECT 'sources', '', count(*) FROM customer UNION ALL SELECT 'label', label, count(*) FROM l GROUP BY label UNION ALL SELECT 'status', status, count(*) FROM feed GROUP BY status",
    "status_transitions": f"""WITH {_FEED}, asked AS (SELECT CASE WHEN order_id % 10 = 9 THEN -order_id ELSE order_id END AS id, (['viewed', 'contacted', 'archived'])[(order_id % 3 + 1)::INT] AS nxt, CASE WHEN order_id % 7 = 0 THEN 9 ELSE version END AS v FROM feed),
      o AS (SELECT a.*, f.status, f.version, CASE WHEN f.order_id IS NULL THEN 'not_found' WHEN f.version <> a.v THEN 'version_conflict' WHEN (f.status = 'new' AND nxt IN ('viewed', 'contacted', 'irrelevant', 'archived')) OR (f.status = 'viewed' AND nxt IN ('contacted', 'irrelevant', 'archived')) OR (f.status = 'contacted' AND nxt IN ('archived', 'irrelevant')) THEN 'ok' ELSE 'invalid_transition' END AS outcome FROM asked a LEFT JOIN feed f ON f.order_id = a.id)
      SELECT outcome, CASE WHEN outcome = 'ok' THEN nxt ELSE status END AS new_status, count(*) AS n, sum(coalesce(CASE WHEN outcome = 'ok' THEN version + 1 ELSE version END, 0))::BIGINT AS versions FROM o GROUP BY 1, 2""",
    "stale_archive": f"WITH {_FEED}, a AS (SELECT *, published_at < TIMESTAMP '1997-01-01' AND status <> 'archived' AS old FROM feed) SELECT CASE WHEN old THEN 'archived' ELSE status END AS status, NOT old AS is_fresh, old AS archived_now, count(*) AS n FROM a GROUP BY 1, 2, 3",
    "canonical_orders": f"WITH {_FEED}, r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY published_at, relevance_score DESC, order_id) AS k, count(*) OVER (PARTITION BY source_id) AS size FROM feed) SELECT source_id, order_id AS canonical, size FROM r WHERE k = 1 AND size > 1",
    "subscription_matches": f"""WITH {_FEED}, s AS (SELECT c_custkey AS sid, c_custkey % 50 AS uid, c_custkey % 100 AS least, c_custkey % 20 = 0 AS typed FROM customer)
      SELECT order_id, uid AS user_id, min(sid) AS subscription_id FROM feed JOIN s ON relevance_score >= least AND (NOT typed OR project_type = '1-URGENT') AND (budget_from + budget_to) / 2 >= 300000 AND NOT contains(lower(title || ' ' || summary), 'for 7') GROUP BY 1, 2""",
    "source_activity": """WITH s AS (SELECT DISTINCT user_id AS source_id FROM events), r AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-23'),
      m AS (SELECT user_id, count(*) AS msg_count, max(ts) AS last, count(DISTINCT ts::DATE) AS active_days, count(*) FILTER (WHERE value > 50) AS order_candidates, count(*) FILTER (WHERE event_type = 'click') AS spam, count(*) FILTER (WHERE event_type = 'purchase' AND value >= 60) AS relevant_orders, count(*) FILTER (WHERE event_type = 'purchase' AND event_id % 4 = 0) AS dup FROM r GROUP BY 1),
      a AS (SELECT source_id, coalesce(msg_count, 0) AS msg_count, coalesce(active_days, 0) AS active_days, coalesce(order_candidates, 0) AS order_candidates, coalesce(spam, 0) AS spam, coalesce(relevant_orders, 0) AS relevant_orders, coalesce(dup, 0) AS dup, CASE WHEN last IS NOT NULL THEN greatest(0, (epoch_us(TIMESTAMP '2024-01-30') - epoch_us(last)) / 3600e6) END AS hours FROM s LEFT JOIN m ON source_id = user_id),
      z AS (SELECT *, round_even(greatest(0, least(1, 0.20::DOUBLE * least(msg_count / 200, 1) + 0.30::DOUBLE * least(order_candidates / 40, 1) + 0.15::DOUBLE * coalesce(greatest(0, 1 - hours / 168), 0) + 0.15::DOUBLE * least(active_days / 7, 1) + 0.20::DOUBLE * (relevant_orders / greatest(order_candidates, 1)) - 0.15::DOUBLE * least((spam + dup) / greatest(msg_count, 1), 1))) * 100, 0)::INT AS activity_score FROM a)
      SELECT source_id, msg_count, active_days, order_candidates, spam, relevant_orders, dup, activity_score, CASE WHEN activity_score >= 75 THEN 'high' WHEN activity_score >= 50 THEN 'active' WHEN activity_score >= 20 THEN 'low' ELSE 'inactive' END AS activity_status, CASE WHEN activity_score >= 75 OR (activity_score >= 50 AND source_id % 2 = 0) THEN 'realtime' ELSE 'poll' END AS poll_mode FROM z""",
    "runtime_gauges": f"""WITH s AS (SELECT c_acctbal > 0 AS enabled, CASE WHEN c_nationkey < 20 THEN 'ok' WHEN c_nationkey < 24 THEN 'floodwait' ELSE 'odd' END AS st, TIMESTAMP '2024-01-01' + to_minutes((c_custkey % 1000)::INT) AS t FROM customer),
      k(name) AS (VALUES ('ok'), ('not_public'), ('invalid_username'), ('floodwait'), ('disabled'))
      SELECT 'failed_tasks' AS metric, '' AS name, count(*)::DOUBLE AS value FROM events WHERE event_type = 'error' UNION ALL SELECT 'lag_seconds', '', (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(t))) / 1e6 FROM s WHERE enabled AND st = 'ok'
      UNION ALL SELECT 'sources', coalesce(k.name, c.st), coalesce(c.n, 0)::DOUBLE FROM k FULL JOIN (SELECT st, count(*) AS n FROM s WHERE enabled GROUP BY st) c ON k.name = c.st""",
    "latency_histogram": "SELECT b AS le, count(*) FILTER (WHERE value <= b) AS n FROM events, (SELECT unnest([1.0, 5.0, 10.0, 50.0, 100.0, 500.0, 'inf'::DOUBLE])::DOUBLE AS b) GROUP BY b",
    "rate_limited_deliveries": "SELECT event_id, count(*) OVER w AS recent, count(*) OVER w >= 2 AS limited FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 43200 PRECEDING AND 1 PRECEDING)",
    "similar_cooldown": "SELECT event_id AS order_id, user_id FROM events a WHERE event_type <> 'purchase' AND EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'purchase' AND a.user_id = b.user_id AND a.event_id % 20 = b.event_id % 20 AND a.event_id <> b.event_id AND b.ts >= TIMESTAMP '2024-01-10')",
    # the events lie in January, so each zone has one offset
    "quiet_hours": """WITH e AS (SELECT event_id, ts, CASE WHEN user_id % 2 = 0 THEN INTERVAL 3 HOUR ELSE INTERVAL (-5) HOUR END AS off FROM events), l AS (SELECT *, ts + off AS local FROM e),
        q AS (SELECT *, strftime(local, '%H:%M:%S') >= '22:00:00' OR strftime(local, '%H:%M:%S') < '07:30:00' AS quiet, date_trunc('day', local)::TIMESTAMP + INTERVAL 450 MINUTE AS morning FROM l)
        SELECT event_id, quiet, CASE WHEN quiet THEN strftime(CASE WHEN morning <= local THEN morning + INTERVAL 1 DAY ELSE morning END - off, '%Y-%m-%d %H:%M:%S') END AS until FROM q""",
    "streaming_dedup": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "retention_months": f"WITH {_FEED} SELECT date_trunc('month', published_at)::DATE::VARCHAR AS published_month, count(*) AS rows, date_trunc('month', published_at)::DATE < DATE '1995-10-01' AS expired FROM feed GROUP BY 1, 3",
    "merge_messages": f"""WITH a AS (SELECT doc_id, text, doc_id % 3 <> 0 AS old, doc_id % 3 <> 1 AS new, CASE WHEN doc_id % 5 = 0 THEN coalesce(text, '') || '!' ELSE text END AS t2, doc_id % 11 = 0 AS del FROM documents),
      b AS (SELECT *, CASE WHEN NOT old THEN 'inserted' WHEN NOT new THEN 'kept' WHEN t2 IS DISTINCT FROM text OR del THEN 'updated' ELSE 'unchanged' END AS action FROM a)
      SELECT action, count(*) AS n, count(*) FILTER (WHERE action IN ('kept', 'unchanged') AND del) AS deleted, sum(length(CASE WHEN action IN ('inserted', 'updated') THEN t2 ELSE text END))::BIGINT AS chars, count(*) FILTER (WHERE action IN ('inserted', 'updated')) AS collected_now FROM b GROUP BY 1""",
    "soft_deletes": "WITH a AS (SELECT source AS source_id, doc_id % 11 = 0 AS del, doc_id % 4 = 2 AS miss FROM documents) SELECT source_id, CASE WHEN miss AND NOT del THEN 'deleted' ELSE 'kept' END AS action, count(*) AS n, count(*) FILTER (WHERE miss OR del) AS deleted FROM a GROUP BY 1, 2",
    "high_water": "WITH a AS (SELECT source AS source_id, min(doc_id) + 300 AS seen, max(CASE WHEN doc_id % 2 = 0 AND source <> 'src1' THEN doc_id END) AS top FROM documents GROUP BY 1) SELECT source_id, greatest(seen, top) AS last_seen_message_id, top IS NOT NULL AS checked FROM a",
    "incremental_scan": f"""WITH a AS (SELECT source AS source_id, doc_id AS id, TIMESTAMP '2024-01-01' + to_hours((doc_id % 720)::INT) AS date, CASE WHEN source = 'src0' THEN 100 ELSE 0 END AS seen FROM documents),
      b AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY id) AS k FROM a WHERE id > seen AND (seen > 0 OR date >= TIMESTAMP '{AS_OF}' - INTERVAL 8 DAY)) SELECT source_id, id, date FROM b WHERE k <= {BATCH}""",
    "incremental_scan_all": f"""WITH a AS (SELECT source AS source_id, doc_id AS id, TIMESTAMP '2024-01-01' + to_hours((doc_id % 720)::INT) AS date, CASE WHEN source = 'src0' THEN 100 ELSE 0 END AS seen FROM documents)
      SELECT source_id, id, date FROM a WHERE id > seen AND (seen > 0 OR date >= TIMESTAMP '{AS_OF}' - INTERVAL 8 DAY)""",
    "shard_assignment": "SELECT list_reduce(list_prepend(0, [strpos('0123456789abcdef', x) - 1 FOR x IN string_split(sha256(source), '')]), lambda s, x: (s * 16 + x) % 7)::INT AS shard, source, count(*) AS posts FROM documents GROUP BY 1, 2",
    "constraint_violations": "SELECT 'text_present' AS rule, count(*) FILTER (WHERE text IS NULL) AS violations FROM documents UNION ALL SELECT 'chars_match', count(*) FILTER (WHERE length(text) <> n_chars) FROM documents UNION ALL SELECT 'known_lang', count(*) FILTER (WHERE lang NOT IN ('en', 'fr', 'de')) FROM documents UNION ALL SELECT 'short', count(*) FILTER (WHERE n_chars > 5000) FROM documents UNION ALL SELECT 'unique_id', count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'unique_text', count(*) FROM (SELECT text FROM documents GROUP BY 1 HAVING count(*) > 1)",
    "vector_topk": "WITH p AS (SELECT a.vec_id, b.vec_id AS other, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, other)::INT AS rank FROM p) SELECT vec_id, other, rank, round(s, 4) AS similarity FROM r WHERE rank <= 3",
    "semantic_pairs": "WITH p AS (SELECT a.vec_id, b.vec_id AS other, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id) SELECT vec_id, other, CASE WHEN s >= 0.9 THEN 'auto_merge' ELSE 'manual_review' END AS outcome FROM p WHERE s >= 0.82",
    "holdout_split": "WITH l AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS label, sha256(coalesce(text, '')) AS h FROM documents JOIN labels USING (doc_id)), g AS (SELECT label, h, row_number() OVER (PARTITION BY label ORDER BY h) AS r, count(*) OVER (PARTITION BY label) AS n FROM (SELECT DISTINCT label, h FROM l)) SELECT doc_id, l.label, r <= least(greatest(1, round_even(n * 0.3, 0)), n - 1) AS holdout FROM l JOIN g ON l.label = g.label AND l.h = g.h",
    "confusion_matrix": "SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS label, CASE WHEN toxic = 1 THEN 'bad' ELSE 'good' END AS predicted, count(*) AS n FROM labels GROUP BY 1, 2",
    "evaluation": "WITH p AS (SELECT CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS label, CASE WHEN toxic = 1 THEN 'bad' ELSE 'good' END AS predicted FROM labels), k(label) AS (VALUES ('good'), ('bad'), ('odd')), c AS (SELECT k.label, (SELECT count(*) FROM p WHERE p.label = k.label) AS support, (SELECT count(*) FROM p WHERE p.predicted = k.label) AS said, (SELECT count(*) FROM p WHERE p.label = k.label AND p.predicted = k.label) AS hit FROM k), r AS (SELECT label, coalesce(hit / nullif(said, 0), 0.0)::DOUBLE AS precision, coalesce(hit / nullif(support, 0), 0.0)::DOUBLE AS recall, support FROM c) SELECT label, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0)::DOUBLE AS f1, support FROM r",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = [
        "prefilter_by_source", "language_mix", "keyword_hits", "fuzzy_hits", "regex_rule_hits", "contact_entities", "budget_entities", "entity_types", "rules_labels", "orders_built", "exact_duplicates", "fingerprint_groups",
        "shard_assignment", "masked_texts", "hash_embeddings", "source_links", "order_feed_page", "order_filters", "order_export", "stats_summary", "status_transitions", "stale_archive", "canonical_orders", "subscription_matches", "subscription_matches_all",
        "source_activity", "runtime_gauges", "latency_histogram", "rate_limited_deliveries", "similar_cooldown", "quiet_hours", "streaming_dedup", "retention_months", "merge_messages", "soft_deletes", "high_water", "incremental_scan", "incremental_scan_all", "constraint_violations",
        "vector_topk", "semantic_pairs", "holdout_split", "confusion_matrix", "evaluation",
    ]
    return {n: globals()[n] for n in names}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if v}
