"""The trained classifier: its weights against plain sums, saving and loading, and the rules on the same held-out texts."""

import math
from collections import Counter

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.functions.rules import LABELS
from gleaner.operators import ml

THINGS = ["кофейни", "школы танцев", "автосервиса", "турфирмы", "пекарни", "клиники", "юриста"]
SAID = {
    "order": ["нужен лендинг для {x}, бюджет 50 000 руб", "ищу разработчика, сделать сайт {x}, срочно", "требуется интернет-магазин для {x}, пишите @client_box"],
    "service_ad": ["делаю сайты недорого, в том числе для {x}", "моё портфолио: сайты для {x}, возьму заказ"],
    "vacancy": ["вакансия для {x}: работа в штат, офис в центре", "на постоянку в отдел {x}, зарплата по итогам"],
    "resume": ["резюме: senior, вёл проекты {x}", "мой опыт: пять лет, сайты {x}"],
    "partnership": ["предлагаю бартер, услуги {x} за сайт", "доля в проекте {x} вместо оплаты"],
    "spam": ["казино и ставки у {x}, заходи", "криптосигнал от {x}, подписывайтесь"],
    "discussion": ["обсуждение: чем живут соцсети {x}", "вопрос о налогах для {x}"],
    "irrelevant": ["сегодня у {x} выходной", "доброе утро всем из {x}"],
}
POSITIVE = [text.Rule("нужен лендинг", weight=5), text.Rule("ищу разработчика", weight=4), text.Rule("требуется интернет-магазин", weight=5)]
NEGATIVE = [text.Rule("делаю сайты", weight=5), text.Rule("моё портфолио", weight=4)]


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(said.format(x=x), label) for label, every in SAID.items() for said in every for x in THINGS]
    plain = spark.createDataFrame(rows, "text string, label string").withColumn("normalized_text", text.normalize_text(F.col("text")))
    return plain.withColumn("text_hash", text.content_hash(F.col("normalized_text")))


def test_model_and_rules_on_the_same_texts(spark, labelled, tmp_path):
    model, told = ml.compared(labelled, LABELS, POSITIVE, NEGATIVE, "2024-07-16 12:00:00")
    rows = told.collect()
    accuracy = {m: sum(r.recall * r.support for r in rows if r.method == m) / sum(r.support for r in rows if r.method == m) for m in ("ml", "rules")}
    assert {(r.method, r.label) for r in rows} == {(m, x) for m in ("ml", "rules") for x in LABELS}
    assert len({sum(r.support for r in rows if r.method == m) for m in ("ml", "rules")}) == 1  # the same texts
    assert accuracy["ml"] >= 0.82 and accuracy["rules"] >= 0.82
    assert next(r.precision for r in rows if (r.method, r.label) == ("rules", "order")) >= 0.85
    ml.save_model(spark, model, str(tmp_path / "m"), LABELS, {}, "x")
    again = ml.load_model(spark, str(tmp_path / "m"), LABELS)
    assert isinstance(again, PipelineModel) and [type(s) for s in again.stages] == [type(s) for s in model.stages]
    some = labelled.where(F.col("text").contains("пекарни"))
    told, told_again = ({r.text: (r.predicted, round(r.p, 9)) for r in ml.predict(m, some).collect()} for m in (model, again))
    assert told == told_again and len(told) == sum(map(len, SAID.values()))


def test_weights_are_sublinear_and_smoothed(spark):
    texts = [["a", "a", "a", "b"], ["b", "c"], ["b"], []]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, words array<string>")
    counts = ml.CountVectorizer(inputCol="words", outputCol="n").fit(df)
    tf = ml.SublinearTF("n", "tf").transform(counts.transform(df))
    model = ml.SmoothIDF("tf", "w").fit(tf)
    got = {r.k: r.w.toArray() for r in model.transform(tf).collect()}
    seen = Counter(w for t in texts for w in set(t))
    for k, t in enumerate(texts):
        for i, w in enumerate(counts.vocabulary):
            n = t.count(w)
            assert got[k][i] == pytest.approx((1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + seen[w])) + 1) if n else 0.0)
