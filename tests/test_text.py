from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gleaner.functions import extract, text

def as_of():
    return F.lit("2024-07-16 12:00:00").cast("timestamp")



def run(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("r")).first()["r"]


def test_normalize(spark):
    assert run(spark, "СРОЧН  нуже́н\n сайт ☎", text.normalize_text) == "срочно нужен сайт"
    assert run(spark, "Café инет магазин", text.normalize_text) == "café интернет-магазин" and run(spark, None, text.normalize_text) == ""


@pytest.mark.parametrize(("t", "want"), [("нужен сайт", "ru"), ("потрібен сайт для магазину", "uk"), ("need a website", "en"), ("12345", "unknown"), ("", "unknown")])
def test_language(spark, t, want):
    assert run(spark, t, text.detect_language) == want


def test_phrases_respect_word_borders(spark):
    rule = [text.Rule("сайт")]
    hit = run(spark, "нужен сайт", lambda c: text.match_keywords(c, rule))
    assert [h.matched_text for h in hit] == ["сайт"] and run(spark, "микросайтинг", lambda c: text.match_keywords(c, rule)) == []


def test_regex_rules_and_their_check(spark):
    hits = run(spark, "нужны лендинг и нужно лендинг", lambda c: text.match_keywords(c, [text.Rule(r"нужн\w+\s+лендинг", is_regex=True)]))
    assert [h.matched_text for h in hits] == ["нужно лендинг"] or len(hits) == 1 or len(hits) == 2
    with pytest.raises(text.InvalidRule):
        text.match_keywords(F.lit("x"), [text.Rule("(", is_regex=True)])


def test_fuzzy(spark):
    hit = run(spark, "ищу разрабочик", lambda c: text.match_keywords(c, [text.Rule("разработчик")]))
    assert [(h.matched_text, h.is_fuzzy, h.distance) for h in hit] == [("разрабочик", True, 1)]
    assert run(spark, "сайд", lambda c: text.match_keywords(c, [text.Rule("сайт")])) == []


@pytest.mark.parametrize(("t", "want"), [("woocommerce и оплату", "ecommerce"), ("нужна интеграция api", "integration"), ("привет", None)])
def test_project_type(spark, t, want):
    got = run(spark, t, extract.project_type)
    assert (got[0].value_norm.project_type if got else None) == want


@pytest.mark.parametrize(
    ("t", "want"),
    [("бюджет 50к-80к ₽", (50000, 80000, "RUB", False)), ("до 100 000", (None, 100000, None, False)), ("500 usd", (500, 500, "USD", False)), ("бюджет договорной", (None, None, None, True)), ("5 разработчиков", (5, 5, "RUB", False)), ("просто текст", None)],
)
def test_budget(spark, t, want):
    got = run(spark, t, extract.budget)
    assert (tuple(got[0].value_norm[k] for k in ("amount_from", "amount_to", "currency", "negotiable")) if got else None) == want


@pytest.mark.parametrize(
    ("t", "want"),
    [("сделать за 5 дней", date(2024, 7, 21)), ("за 2 недели", date(2024, 7, 30)), ("до 25.12", date(2024, 12, 25)), ("до 01.02", date(2025, 2, 1)), ("до 01.02.23", date(2023, 2, 1)), ("к августу", date(2024, 8, 1)), ("к марту", date(2025, 3, 1)), ("до 31.02", None)],
)
def test_deadline(spark, t, want):
    got = run(spark, t, lambda c: extract.deadline(c, as_of()))
    assert len(got) == 1 and got[0].value_norm.deadline == want


def test_urgent(spark):
    got = run(spark, "срочно нужен сайт", lambda c: extract.deadline(c, as_of()))
    assert got[0].value_norm.urgent and got[0].confidence == Decimal("0.8000") and run(spark, "сайт", lambda c: extract.deadline(c, as_of())) == []


def test_contacts(spark):
    t = "пишите @Some_user или https://t.me/some_user, a.b@mail.ru +7 (900) 123-45-67 https://site.ru/x @some_user"
    got = [(e.value_norm.kind, e.value_norm.value) for e in run(spark, t, extract.contacts)]
    assert got == [("telegram_username", "@some_user"), ("email", "a.b@mail.ru"), ("phone", "+79001234567"), ("url", "https://site.ru/x")]
    assert [e.value_norm.kind for e in run(spark, "пишите в лс", extract.contacts)] == ["implicit"]


@pytest.mark.parametrize(
    ("link", "want"),
    [("@GoodName", ("goodname", None)), ("https://t.me/good_name/55", ("good_name", None)), ("t.me/joinchat/abc", (None, "SOURCE_NOT_PUBLIC")), ("https://t.me/+abc", (None, "SOURCE_NOT_PUBLIC")), ("https://t.me/c/123/4", (None, "SOURCE_NOT_PUBLIC")),
     ("abc", (None, "INVALID_SOURCE_USERNAME")), ("1abcdef", (None, "INVALID_SOURCE_USERNAME")), ("my-channel", (None, "INVALID_SOURCE_USERNAME")), ("https://example.com/name", (None, "INVALID_SOURCE_USERNAME")), ("somebot", (None, "INVALID_SOURCE_USERNAME")), ("  plain_name ", ("plain_name", None))],
)
def test_source_links(spark, link, want):
    assert tuple(run(spark, link, text.source_link)) == want


def test_masks_shards_titles(spark):
    assert run(spark, "Пишите a@b.ru или @someuser t.me/xyz +7 900 123 45 67", text.mask_pii) == "пишите email или username url phone"
    import hashlib

    assert run(spark, "источник", lambda c: text.shard_for(c, 7)) == int(hashlib.sha256("источник".encode()).hexdigest(), 16) % 7
    assert run(spark, " a \n b " + "c" * 600, text.build_summary) == ("a b " + "c" * 600)[:500] and run(spark, "", text.build_title) is None
