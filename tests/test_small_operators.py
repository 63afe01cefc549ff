"""Listings, payloads, searches, labelled files and contact maps on small tables."""

import json
from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gleaner.functions import extract, text
from gleaner.operators import orders, posts, semantic
from gleaner.sources import merge


def test_listings(spark):
    rules = spark.createDataFrame([("b", "x", "ru"), ("a", "x", "uk"), ("a", "x", "ru"), ("c", "y", "ru")], "phrase string, category string, lang string")
    assert [(r.phrase, r.lang) for r in merge.list_rules(rules, "x").collect()] == [("a", "ru"), ("a", "uk"), ("b", "ru")]
    assert [r.phrase for r in merge.list_rules(rules).collect()] == ["a", "a", "b", "c"]
    subs = spark.createDataFrame([("s1", "u", datetime(2024, 1, 1)), ("s2", "u", datetime(2024, 1, 2)), ("s0", "u", datetime(2024, 1, 2)), ("s3", "v", datetime(2024, 1, 3))], "subscription_id string, user_id string, created_at timestamp")
    assert [r.subscription_id for r in merge.list_subscriptions(subs, "u").collect()] == ["s0", "s2", "s1"]
    assert merge.list_subscriptions(subs).first().subscription_id == "s3"


def test_payload_has_no_fingerprint(spark):
    row = spark.createDataFrame([("o", "f")], "order_id string, duplicate_fingerprint string")
    assert orders.order_payload(row).columns == ["order_id"]


def test_search_breaks_ties_by_key(spark):
    rows = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (4, [0.0, 0.0])], "k long, v array<float>")
    assert [(r.k, r.similarity) for r in semantic.search(rows, [1.0, 0.0], "k", "v", 3).collect()] == [(1, 1.0), (3, 1.0), (2, 0.0)]


def test_labelled_files(spark, tmp_path):
    path = tmp_path / "labelled.json"
    path.write_text(json.dumps([{"text": "Нужен  САЙТ", "label": "order"}, {"text": "x", "label": "spam"}], ensure_ascii=False))
    rows = merge.load_labelled(spark, str(path), ["order", "spam"], text.normalize_text).collect()
    assert [(r.normalized_text, r.label) for r in rows] == [("нужен сайт", "order"), ("x", "spam")]
    with pytest.raises(PySparkException):
        merge.load_labelled(spark, str(path), ["order"], text.normalize_text).collect()


def test_contacts_by_kind(spark):
    made = spark.createDataFrame([("mail a@b.ru or A@b.ru, @handle_one and +7 900 123-45-67",), ("nothing",)], "text string").withColumn("entities", extract.contacts(F.col("text")))
    first, second = (r.m for r in made.select(posts.contacts_map().alias("m")).collect())
    assert first["email"] == ["a@b.ru"] and len(first["phone"]) == 1 and second is None


def test_masked_texts(spark):
    row = spark.createDataFrame([("Пишите A.B@mail.ru, @some_user, https://x.y/z и +7 (900) 123-45-67!",)], "t string")
    assert row.select(text.mask_pii(F.col("t")).alias("m")).first().m == "пишите email , username , url и phone !"


def test_explanations_carry_codes(spark):
    rows = spark.createDataFrame([("нужен лендинг, бюджет 50 000 руб",), ("делаю сайты",), ("доброе утро",)], "text string").withColumn("published_at", F.lit("2024-07-16 10:00:00").cast("timestamp"))
    done = posts.classify(posts.process_messages(rows, [text.Rule("нужен лендинг")], [text.Rule("делаю сайты")], "2024-07-16 12:00:00"), "2024-07-16 12:00:00")
    told = [json.loads(r.explanation) for r in done.collect()]
    assert [t["label_reason"] for t in told] == ["order", "service_ad", "prefilter"] and {t["formula"] for t in told} == {posts.FORMULA}
    assert told[0]["matched_rules"]["project_types"] == ["landing_page"] and told[0]["matched_rules"]["keyword_hits"] == ["нужен лендинг"]


def test_audit_log_grows(spark, tmp_path):
    changed = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    for day in ("2024-01-01", "2024-01-02", "2024-01-02"):
        at = F.lit(f"{day} 10:00:00").cast("timestamp")
        merge.append_audit(merge.audit_rows(changed, "rule.update", "rule", "id", at, F.lit(f"run of {day}")), str(tmp_path / "audit"))
    log = spark.read.parquet(str(tmp_path / "audit"))
    assert log.count() == 6 and log.where("created_on = '2024-01-02'").select("correlation_id").distinct().first()[0] == "run of 2024-01-02"
    assert "correlation_id" not in merge.audit_rows(changed, "a", "b", "id", F.current_timestamp()).columns
