from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.operators import activity, ml
from gleaner.streaming import posts


def landed(spark, tmp_path, rows, kind):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def drain(stream, tmp_path, spark):
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_repeats_are_dropped_once(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [("s", 1, t), ("s", 1, t), ("s", 2, t), ("q", 1, t)]
    stream = landed(spark, tmp_path, rows, "source_id string, tg_message_id long, published_at timestamp")
    assert drain(posts.drop_repeats(stream, ["source_id", "tg_message_id"]), tmp_path, spark).count() == 3


def test_rate_limit_counts_only_what_passed(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [(1, i, t + timedelta(minutes=m)) for i, m in enumerate([0, 10, 20, 65, 200])] + [(2, 9, t)]
    stream = landed(spark, tmp_path, rows, "user_id long, event_id long, ts timestamp")
    got = {r.event_id: r.allowed for r in drain(posts.rate_limit(stream, 60, 2), tmp_path, spark).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 9: True}


def test_merging_batches_twice_changes_nothing(spark, tmp_path):
    stream = landed(spark, tmp_path, [(1, "a"), (2, "b")], "id long, t string")
    seen = []
    for _ in range(2):
        posts.merge_batches(stream, lambda df, n: seen.extend(r.id for r in df.collect()), str(tmp_path / "merge")).awaitTermination()
    assert sorted(seen) == [1, 2]


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(f"нужен сайт номер {i} для магазина", "order") for i in range(14)] + [(f"продаю услуги портфолио {i}", "service_ad") for i in range(10)]
    return spark.createDataFrame(rows, "normalized_text string, label string").withColumn("text_hash", text.content_hash(F.col("normalized_text")))


def test_split_keeps_texts_together_and_rounds_half_to_even(labelled):
    split = ml.holdout_split(labelled.unionByName(labelled))
    got = {r.label: r.n for r in split.where("holdout").groupBy("label").agg(F.count_distinct("text_hash").alias("n")).collect()}
    assert got == {"order": 4, "service_ad": 3} and split.groupBy("text_hash").agg(F.count_distinct("holdout").alias("n")).where("n > 1").count() == 0
    assert ml.dataset_checksum(labelled).first() == ml.dataset_checksum(labelled.orderBy(F.desc("text_hash"))).first()


def test_model_learns_saves_and_falls_back(spark, labelled, tmp_path):
    model = ml.train_classifier(labelled)
    told = ml.predict(model, labelled)
    assert told.where("label <> predicted").count() == 0
    ml.save_model(spark, model, str(tmp_path / "m"), ["order", "service_ad"], {}, "x")
    again = ml.load_model(spark, str(tmp_path / "m"), ["service_ad", "order"])
    with pytest.raises(ValueError):
        ml.load_model(spark, str(tmp_path / "m"), ["order"])
    ruled = labelled.select("normalized_text", F.lit("irrelevant").alias("label"), F.lit(0.5).cast("decimal(5,4)").alias("confidence"), F.lit(True).alias("manual_review"), F.lit(0).alias("relevance_score"))
    got = ml.predict_with_fallback(ruled, again, ["order"]).groupBy("method", "fallback").count().collect()
    assert {(r["method"], r["fallback"]) for r in got} <= {("ml", None), ("rules", "unknown_class"), ("rules", "low_confidence")} and any(r["method"] == "rules" for r in got)
    assert ml.predict_with_fallback(ruled, None, ["order"]).first()["fallback"] == "no_model"


def test_ngrams(spark):
    row = spark.createDataFrame([("a bc def",)], "t string").select(ml.word_ngrams(F.col("t")).alias("w"), ml.char_ngrams(F.col("t"), 3, 3).alias("c")).first()
    assert row.w == ["bc", "def", "bc def"] and row.c == [" a ", " bc", "bc ", " de", "def", "ef "]


def test_metrics(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "label string, predicted string")
    per = activity.evaluate(rows, ["a", "b", "c"])
    assert {r.label: (r.precision, r.recall, r.support) for r in per.collect()} == {"a": (1.0, 0.5, 2), "b": (0.5, 1.0, 1), "c": (0.0, 0.0, 0)}
    assert activity.summary_metrics(per, activity.confusion(rows)).first()["accuracy"] == pytest.approx(2 / 3)
