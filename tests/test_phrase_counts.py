"""Counts by phrase against the hits themselves; what is said once is matched once."""

import pytest
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.operators import dictionary

KIND = "position int, phrase string, weight int, category string"
RULES = ["landing", "Landing ", "landing", "land", "the landing", "the  Landing", "on-line", "on-line shop", "online", "shopping", "the", "c++ code", "#landing", "none here", None, "!!"]
TEXTS = ["the landing of a lending", "landings on-line", "on-lines on-line", "on-lines", "online-shopping shoping", "the  landing\tc++ code", "#landing-", "the the the", "", None, "c++  code on-line shop", "lannding landin landing"]


def tables(spark):
    posts = spark.createDataFrame(list(enumerate(TEXTS)), "id long, normalized_text string")
    return posts, spark.createDataFrame([(i, p, 1, "c") for i, p in enumerate(RULES)], KIND)


@pytest.mark.parametrize("in_place", [1 << 12, 0])
def test_counts_are_those_of_the_hits(spark, monkeypatch, in_place):
    monkeypatch.setattr(dictionary, "IN_PLACE", in_place)
    monkeypatch.setattr(dictionary, "BROADCAST", in_place)
    posts, rules = tables(spark)
    for fuzzy in (True, False):
        hits = [h for h in dictionary.dictionary_hits(posts, rules, "id", fuzzy=fuzzy).collect()]
        want = {}
        for h in hits:
            n = want.setdefault((h.position, h.phrase), [0, 0, 0])
            n[h.is_fuzzy] += 1
            n[2] += len(h.matched_text)
        got = {(r.position, r.phrase): [r.exact, r.fuzzy, r.letters] for r in dictionary.dictionary_counts(posts, rules, "id", fuzzy=fuzzy).collect()}
        assert got == want and want[0, "landing"][:2] == want[1, "Landing "][:2] and want[4, "the landing"] == want[5, "the  Landing"]
        compiled = [text.Rule(p or "!!", weight=1, category="c") for p in RULES[:-2]]
        same = text.keyword_hits(posts, compiled, fuzzy=fuzzy).select("id", "position", "matched_text", "is_fuzzy", "distance")
        assert sorted(map(tuple, same.collect())) == sorted((h.id, h.position, h.matched_text, h.is_fuzzy, h.distance) for h in hits)


def test_equal_phrases_are_one_and_longer_ones_ask_for_all_their_words(spark, monkeypatch):
    asked = []
    near = dictionary.near_words
    monkeypatch.setattr(dictionary, "near_words", lambda words, phrases: asked.append(phrases.count()) or near(words, phrases))
    rules = spark.createDataFrame([(i, "landing" if i % 2 else "the landing", 1, "c") for i in range(50)], KIND)
    posts = spark.createDataFrame([(0, "the lending"), (1, "the landing"), (2, "of the")], "id long, t string")
    got = dictionary.dictionary_counts(posts, rules, "id", "t")
    assert {(r.position % 2, r.exact, r.fuzzy, r.letters) for r in got.collect()} == {(0, 1, 0, 11), (1, 1, 1, 14)}
    assert got.count() == 50 and asked == [2]


def test_runs_of_letters_are_the_same_with_and_without_case(spark):
    every = spark.range(0x20, 0x30000).where("id not between 55296 and 57343 and id <> 65279").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    assert every.count() > 190000 and every.where("length(c) <> 1").count() == 0
    assert every.where(F.col("c").rlike(rf"(?iU)^{text.LETTER}$") != F.col("c").rlike(r"(?U)^\w$")).count() == 0
    assert every.where(F.col("c").rlike(text.MAY_COMPOSE) & ~F.col("c").rlike(r"[^\x00-\x{02FF}]")).count() == 0
