import hashlib
import json
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gleaner.functions import rules, text
from gleaner.operators import activity, dedup, notify, orders, posts, semantic
from gleaner.sources import merge

def now_():
    return F.lit("2024-07-16 12:00:00").cast("timestamp")



def test_relevance_formula(spark):
    s = dict.fromkeys(rules.SIGNALS, 1.0) | {"p_client": 0.9, "ad_signals": 0.0, "spam_signals": 0.0}
    got = spark.range(1).select(F.struct(*[F.lit(v).alias(k) for k, v in s.items()]).alias("s")).select(rules.relevance_score(F.col("s")).alias("r")).first()["r"]
    assert got == 99


POSTS = [
    ("order", "Нужен лендинг, бюджет 50к-80к руб, до 25.12, пишите @client_one"), ("order", "Ищу разработчика: сделать интернет-магазин, бюджет 100 000 руб, контакт @shop_owner"), ("spam", "Лучшее казино, подписывайтесь"), ("vacancy", "Ищем в команду разработчика, полная занятость"),
    ("resume", "Ищу работу, мой опыт три года"), ("partnership", "Предлагаю бартер, доля в проекте"), ("service_ad", "Делаю сайты недорого, портфолио в профиле"), ("discussion", "Подскажите, как лучше хостить"), ("irrelevant", "Доброе утро всем"), ("irrelevant", ""),
]


def classified(spark):
    rows = spark.createDataFrame([(str(i), f"s{i % 2}", t, datetime(2024, 7, 16, 10)) for i, (_, t) in enumerate(POSTS)], "message_id string, source_id string, text string, published_at timestamp")
    positive = [text.Rule("нужен лендинг", weight=5), text.Rule("ищу разработчика", weight=4)]
    negative = [text.Rule("делаю сайты", weight=5)]
    return posts.classify(posts.process_messages(rows, positive, negative, now_()), now_())


def test_labels_and_orders(spark):
    got = {r.message_id: r for r in classified(spark).select("message_id", "label", "manual_review", "relevance_score", "passed_prefilter", F.size("entities").alias("n")).collect()}
    assert [got[str(i)].label for i in range(len(POSTS))] == [label for label, _ in POSTS]
    assert got["0"].passed_prefilter and not got["6"].passed_prefilter and got["9"].n == 0 and got["0"].relevance_score >= 60
    made = {r.message_id: r for r in posts.build_orders(classified(spark), now_()).collect()}
    assert set(made) == {"0", "1"} and made["0"].budget_to == Decimal("80000.00") and made["0"].contacts == {"telegram_username": ["@client_one"]} and made["0"].project_type == "landing_page"
    current = posts.build_orders(classified(spark), now_()).withColumn("status", F.lit("viewed"))
    again = {r.message_id: r for r in posts.upsert_orders(current, posts.build_orders(classified(spark), now_()).where("message_id = '0'"), classified(spark).select("message_id")).collect()}
    assert set(again) == {"0"} and again["0"].version == 2 and again["0"].status == "viewed"


def order_rows(spark, rows):
    kind = "order_id string, source_id string, published_at timestamp, normalized_text string, title string, summary string, project_type string, contacts map<string,array<string>>, budget_from decimal(14,2), budget_to decimal(14,2), budget_currency string, budget_negotiable boolean, deadline date, deadline_text string, relevance_score int, content_hash string"
    base = {"source_id": "s", "published_at": datetime(2024, 7, 15), "normalized_text": "t", "title": "t", "summary": "s", "project_type": None, "contacts": None, "budget_from": None, "budget_to": None, "budget_currency": None, "budget_negotiable": False, "deadline": None, "deadline_text": None, "relevance_score": 70, "content_hash": "h"}
    names = [f.split()[0] for f in kind.split(", ")]
    return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], kind)


def test_fingerprint_is_canonical_json(spark):
    rows = order_rows(spark, [{"order_id": "a", "contacts": {"phone": ["B", "a"], "email": ["X@y"]}, "budget_from": Decimal("10"), "budget_currency": "RUB"}])
    want = {"text": "t", "contacts": {"email": ["x@y"], "phone": ["a", "b"]}, "budget": {"from": "10.00", "to": None, "currency": "RUB", "negotiable": False}, "project_type": None}
    assert dedup.fingerprint(rows).first()["duplicate_fingerprint"] == hashlib.sha256(json.dumps(want, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_duplicates_and_canonical(spark):
    late = datetime(2024, 7, 16)
    rows = order_rows(spark, [{"order_id": "b", "published_at": late}, {"order_id": "a"}, {"order_id": "c", "deadline_text": "x"}, {"order_id": "z", "normalized_text": "other"}, {"order_id": "old", "published_at": datetime(2024, 1, 1)}])
    got = {r.order_id: r for r in dedup.deduplicate_orders(rows, now_()).collect()}
    assert {k: r.canonical_order_id for k, r in got.items()} == {"a": "c", "b": "c", "c": "c", "z": None, "old": None} and got["a"].group_size == 3 and got["a"].method == "content_hash"
    assert dedup.duplicate_groups(dedup.deduplicate_orders(rows, now_())).first()["size"] == 3


@pytest.mark.parametrize(
    ("a", "b", "bad"),
    [({}, {}, False), ({"project_type": "x"}, {"project_type": "y"}, True), ({"budget_from": Decimal(60000)}, {"budget_from": Decimal(600000)}, True), ({"budget_from": Decimal(100)}, {"budget_from": Decimal(80)}, False),
     ({"contacts": {"phone": ["1"]}}, {"contacts": {"phone": ["2"]}}, True), ({"contacts": {"phone": ["A"]}}, {"contacts": {"phone": ["a"]}}, False), ({"deadline": datetime(2024, 7, 20).date()}, {"deadline": datetime(2024, 10, 20).date()}, True), ({"title": "Выполню работу"}, {}, True)],
)
def test_contradictions(spark, a, b, bad):
    left, right = order_rows(spark, [{"order_id": "a"} | a]), order_rows(spark, [{"order_id": "b"} | b])
    met = left.select(F.struct("*").alias("a"), F.lit(1).alias("k")).join(right.select(F.struct("*").alias("b"), F.lit(1).alias("k")), "k")
    assert met.select(semantic.contradiction("a", "b").alias("r")).first()["r"] is bad


def test_semantic_duplicates(spark):
    rows = order_rows(spark, [{"order_id": "a", "project_type": "x"}, {"order_id": "b"}, {"order_id": "c", "project_type": "y"}, {"order_id": "d", "project_type": "x", "published_at": datetime(2024, 6, 1)}])
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.93, 0.3676]), ("c", [0.0, 1.0]), ("d", [1.0, 0.0])], "order_id string, embedding array<double>")
    got = {r.order_id: (r.candidate_id, r.outcome) for r in semantic.semantic_duplicates(rows.join(vectors, "order_id").withColumn("canonical_order_id", F.lit(None).cast("string"))).collect()}
    assert got == {"a": ("b", "auto_merge"), "b": ("a", "auto_merge"), "c": ("b", "no_match"), "d": (None, "no_match")}


def test_hash_embedding_is_near_for_paraphrases(spark):
    t = spark.createDataFrame([("нужен лендинг для курса", "нужна посадочная для онлайн-курса")], "a string, b string")
    v = lambda c: semantic.hash_embedding(text.semantic_tokens(F.col(c), compose=False), 64)
    assert t.select(semantic.dot(v("a"), v("b")).alias("s")).first()["s"] >= 0.45
    raw = spark.range(1).select(semantic.vector_literal(F.array(F.lit(0.5), F.lit(-1.0))).alias("s"))
    assert raw.first()["s"] == "[0.50000000,-1.00000000]" and raw.select(semantic.parse_vector(F.col("s")).alias("v")).first()["v"] == [0.5, -1.0]


@pytest.mark.parametrize(("m", "want"), [((180, 35, 2.0, 7, 20, 3, 0), (85, "high", "realtime")), ((8, 1, 200.0, 2, 0, 1, 0), (4, "inactive", "poll"))])
def test_activity(spark, m, want):
    score = activity.activity_score(*[F.lit(x) for x in m])
    assert tuple(spark.range(1).select(score, activity.activity_status(score), activity.poll_mode(score, F.lit("channel"))).first()) == want


@pytest.mark.parametrize(("at", "a", "b", "zone", "until"), [("2024-07-16 23:30", "22:00", "07:00", "UTC", datetime(2024, 7, 17, 7)), ("2024-07-16 12:00", "22:00", "07:00", "UTC", None), ("2024-07-16 21:30", "00:00", "08:00", "Europe/Moscow", datetime(2024, 7, 17, 5)), ("2024-07-16 12:00", None, None, "UTC", None)])
def test_quiet_hours(spark, at, a, b, zone, until):
    args = [F.lit(at).cast("timestamp"), F.lit(a).cast("string"), F.lit(b).cast("string"), F.lit(zone)]
    quiet, end = spark.range(1).select(notify.in_quiet_hours(*args), notify.next_quiet_end(*args)).first()
    assert quiet is (until is not None) and end == until


SUB = {"subscription_id": "s1", "user_id": "u", "created_at": datetime(2024, 1, 1), "enabled": True, "min_relevance_score": None, "project_types": [], "budget_min": None, "budget_max": None, "currencies": [], "source_ids": [], "positive_keywords": [], "negative_keywords": [], "quiet_hours_start": None, "quiet_hours_end": None, "timezone": "UTC", "freshness_days": None, "max_notifications_per_period": None, "rate_limit_period_minutes": None, "similar_cooldown_minutes": None}
SUB_KIND = "subscription_id string, user_id string, created_at timestamp, enabled boolean, min_relevance_score int, project_types array<string>, budget_min decimal(14,2), budget_max decimal(14,2), currencies array<string>, source_ids array<string>, positive_keywords array<string>, negative_keywords array<string>, quiet_hours_start string, quiet_hours_end string, timezone string, freshness_days int, max_notifications_per_period int, rate_limit_period_minutes int, similar_cooldown_minutes int"


def subs(spark, *rows):
    return spark.createDataFrame([tuple((SUB | r)[f.split()[0]] for f in SUB_KIND.split(", ")) for r in rows], SUB_KIND)


@pytest.mark.parametrize(
    ("sub", "fits"),
    [({}, True), ({"enabled": False}, False), ({"min_relevance_score": 80}, False), ({"project_types": ["x"]}, False), ({"project_types": ["landing_page"]}, True), ({"currencies": ["rub"]}, True), ({"currencies": ["USD"]}, False), ({"budget_min": Decimal(90)}, False), ({"budget_max": Decimal(90)}, True),
     ({"source_ids": ["q"]}, False), ({"positive_keywords": ["Сайт"]}, True), ({"positive_keywords": ["бот"]}, False), ({"positive_keywords": ["сайт"], "negative_keywords": ["сайт"]}, False), ({"freshness_days": 1}, False)],
)
def test_subscription(spark, sub, fits):
    rows = order_rows(spark, [{"order_id": "a", "project_type": "landing_page", "title": "Нужен САЙТ", "budget_from": Decimal(50), "budget_to": Decimal(100), "budget_currency": "RUB", "published_at": datetime(2024, 7, 14)}])
    assert notify.match_subscriptions(rows, subs(spark, sub), now_()).count() == int(fits)


def test_notifications(spark):
    rows = dedup.fingerprint(order_rows(spark, [{"order_id": o, "normalized_text": t, "published_at": datetime(2024, 7, 15, i)} for i, (o, t) in enumerate([("a", "x"), ("b", "x"), ("c", "y"), ("d", "z"), ("sent", "w")])]))
    users = spark.createDataFrame([("u",), ("q",)], "user_id string")
    sent = rows.where("order_id = 'sent'").select("order_id", F.lit("u").alias("user_id"), F.lit("telegram").alias("channel"), F.lit("sent").alias("status"), F.lit("2024-07-16 11:30:00").cast("timestamp").alias("sent_at"), "duplicate_fingerprint")
    given = subs(spark, {"max_notifications_per_period": 3, "rate_limit_period_minutes": 60, "similar_cooldown_minutes": 600}, {"subscription_id": "s0", "user_id": "q", "quiet_hours_start": "11:00", "quiet_hours_end": "13:00"}, {"subscription_id": "s2", "user_id": "gone"})
    got = {(r.user_id, r.order_id): r.decision for r in notify.match_notifications(rows, given, users, sent, now_()).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "u"} == {"a": "send", "b": "similar_recently", "c": "send", "d": "rate_limited"}
    assert {v for k, v in got.items() if k[0] == "q"} == {"deferred"} and not any(k[0] == "gone" for k in got)


def test_validate_subscriptions(spark):
    given = subs(spark, {"currencies": [" usd ", ""]}, {"subscription_id": "s2", "quiet_hours_start": "22:00"}, {"subscription_id": "s3", "budget_min": Decimal(5), "budget_max": Decimal(1)}, {"subscription_id": "s4", "source_ids": ["x"]})
    got = {r.subscription_id: r for r in notify.validate_subscriptions(given).collect()}
    assert [got[k].error for k in ("s1", "s2", "s3", "s4")] == [None, "quiet_hours_pair", "budget_range", "source_ids"] and got["s1"].currencies == ["USD"]


def test_first_load_and_gaps(spark):
    day = lambda n: datetime(2024, 7, n)
    raw = spark.createDataFrame([("s", 1, day(5)), ("s", 2, day(15)), ("s", 3, day(16)), ("t", 4, day(1)), ("t", 6, day(1)), ("t", 8, day(1))], "source_id string, id long, date timestamp")
    sources = spark.createDataFrame([("s", 0), ("t", 5)], "source_id string, last_seen_message_id long")
    got = sorted((r.source_id, r.id) for r in merge.incremental_scan(raw, sources, now_()).collect())
    assert got == [("s", 2), ("s", 3), ("t", 6), ("t", 8)]


def test_merge_edits_and_reruns(spark):
    kind = "source_id string, tg_message_id long, text string, content_hash string, collected_at timestamp, deleted_at timestamp"
    old = datetime(2024, 7, 1)
    now = spark.createDataFrame([("s", 1, "a", "1", old, None), ("s", 2, "b", "2", old, None), ("s", 3, "c", "3", old, old)], kind)
    new = spark.createDataFrame([("s", 1, "a", "1", None, None), ("s", 2, "B", "9", None, None), ("s", 3, "c", "3", None, None), ("s", 4, "d", "4", None, None)], kind)
    out = merge.upsert_messages(now, new, now_())
    assert {r.tg_message_id: (r.action, r.text, r.deleted_at) for r in out.collect()} == {1: ("unchanged", "a", None), 2: ("updated", "B", None), 3: ("updated", "c", None), 4: ("inserted", "d", None)}
    assert {r.action for r in merge.upsert_messages(out.drop("action"), new, now_()).collect()} == {"unchanged"}
    gone = merge.soft_delete_missing(now, new.where("tg_message_id <> 1"), now_())
    assert {r.tg_message_id: r.action for r in gone.collect()} == {1: "deleted", 2: "kept", 3: "kept"}
    assert merge.merge_counts(out, gone).first().asDict() == {"source_id": "s", "saved": 1, "updated": 2, "deleted": 1, "enqueued": 4}


def test_rule_changes(spark):
    table = spark.createDataFrame([("1", "a", "ru", 1), ("2", "b", "ru", 1)], "rule_id string, phrase string, lang string, weight int")
    changes = spark.createDataFrame([("create", "3", "c", "ru", 2), ("update", "1", None, None, 5), ("delete", "2", None, None, None), ("update", "9", None, None, 1), ("create", "4", "c", "ru", 2), ("create", "5", "e", "ru", 99)], "op string, rule_id string, phrase string, lang string, weight int")
    out, told = merge.apply_changes(table, changes, "rule_id", ["phrase", "lang"], F.col("__after.weight").between(1, 10))
    assert {(r.op, r.rule_id): r.outcome for r in told.collect()} == {("create", "3"): "duplicate", ("update", "1"): "ok", ("delete", "2"): "ok", ("update", "9"): "not_found", ("create", "4"): "duplicate", ("create", "5"): "invalid"}
    assert {r.rule_id: (r.phrase, r.weight) for r in out.collect()} == {"1": ("a", 5)}


def test_seed_quarantine_and_partitions(spark, tmp_path):
    have = spark.createDataFrame([("a", "ru")], "phrase string, lang string")
    every, added = merge.insert_missing(have, spark.createDataFrame([("a", "ru"), ("b", "ru"), ("b", "ru")], "phrase string, lang string"), ["phrase", "lang"])
    assert every.count() == 2 and added.count() == 1
    good, letters = merge.quarantine(spark.createDataFrame([(1, None), (2, "bad"), (2, "bad")], "id long, error string"), "error", "task", "id")
    assert good.count() == 1 and [r.dedup_key for r in letters.collect()] == ["task:2"]
    rows = spark.createDataFrame([(1, datetime(2024, 1, 5)), (2, datetime(2024, 7, 5))], "id long, published_at timestamp")
    merge.write_partitioned(rows, str(tmp_path / "m"))
    merge.write_partitioned(rows.where("id = 2"), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2
    assert {(str(r.published_month), r.expired) for r in merge.expired_months(rows, now_()).collect()} == {("2024-01-01", True), ("2024-07-01", False)} and merge.keep_months(rows, now_()).count() == 1


def test_order_card_and_status(spark):
    rows = order_rows(spark, [{"order_id": "a", "budget_to": Decimal(100000), "budget_currency": "RUB", "contacts": {"email": ["e"], "phone": ["p"]}, "deadline": datetime(2024, 8, 1).date()}])
    card = orders.order_card(rows).first()
    assert (card.budget, card.contact, card.deadline) == ("до 100 000 RUB", "p", "2024-08-01")
    feed = spark.createDataFrame([("a", "new", 1), ("b", "archived", 1), ("c", "new", 2)], "order_id string, status string, version int")
    asked = spark.createDataFrame([("a", "viewed", 1), ("b", "new", 1), ("c", "viewed", 1), ("x", "viewed", 1)], "order_id string, next_status string, version int")
    assert {r.order_id: (r.outcome, r.new_version) for r in orders.change_status(feed, asked).collect()} == {"a": ("ok", 2), "b": ("invalid_transition", 1), "c": ("version_conflict", 2), "x": ("not_found", None)}
