"""Dictionaries by joins: against the compiled form, and ten thousand rules against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gleaner.functions.text import InvalidRule, Rule, keyword_hits
from gleaner.operators.dictionary import deletions, dictionary_hits

LETTERS = "абвгдеёab"


def word(draw, low=1, high=9):
    return "".join(draw.choice(LETTERS) for _ in range(draw.randrange(low, high)))


def edited(draw, w):
    i = draw.randrange(len(w))
    return draw.choice([w[:i] + w[i + 1 :], w[:i] + "ж" + w[i:], w[:i] + "ж" + w[i + 1 :]])


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return 2
    if a == b:
        return 0
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return 1 if a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] else 2


def slow(texts, rules, fuzzy=True):
    out = []
    for k, t in texts:
        words = re.findall(r"[\w-]+", t)
        for i, r in enumerate(rules):
            plain = r.phrase.lower().strip()
            m = re.search(rf"(?<!\w){r'\s+'.join(map(re.escape, plain.split()))}(?!\w)", t)
            if m:
                out.append((k, i, r.phrase, m[0], r.weight, r.category, False, False, 0))
            elif fuzzy and " " not in plain and len(plain) >= 6:
                near = next(((w, one_edit(plain, w)) for w in words if len(w) >= 6 and one_edit(plain, w) < 2), None)
                if near:
                    out.append((k, i, r.phrase, near[0], r.weight, r.category, False, near[1] > 0, near[1]))
    return sorted(out, key=str)


def test_ten_thousand_rules(spark):
    draw = random.Random(1)
    vocabulary = [word(draw, 2, 10) for _ in range(4000)]
    singles = [draw.choice(vocabulary) for _ in range(6000)]
    rules = [Rule(w if i % 3 else edited(draw, w) or "x", weight=i % 7, category=draw.choice([None, "c"])) for i, w in enumerate(singles)]
    rules += [Rule(" ".join(draw.choice(vocabulary[:60]) for _ in range(draw.choice((2, 2, 3))))) for _ in range(4000)]
    texts = [(i, " ".join(draw.choice(vocabulary if draw.random() < 0.5 else vocabulary[:60]) + draw.choice(["", "", ",", "-x"]) for _ in range(draw.choice((1, 20, 200))))) for i in range(40)]
    got = dictionary_hits(spark.createDataFrame(texts, "id long, normalized_text string"), rules, "id")
    want = slow(texts, rules)
    assert len(rules) == 10_000 and len(want) > 3000 and any(w[7] for w in want)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_equals_the_compiled_form(spark):
    rules = [Rule("нужен сайт"), Rule("разработчик", weight=4), Rule("c++ разработка"), Rule("#срочно"), Rule(r"нужн\w+\s+лендинг", is_regex=True), Rule("₽₽₽"), Rule("node.js"), Rule("Сайт", category="x"), Rule("сайт"), Rule("интернет-магазин"), Rule("a_b")]
    texts = ["нужен сайт на node.js, c++ разработка", "микросайтинг разрабочик", "#срочно нужный лендинг нужна лендинг", "₽₽₽ интернет-магазины", "xnode.js nodexjs сайт-визитка нужен  сайт", "", None, "разработчик разработчики", "##срочно a_b a_bc", "интернет магазин интернет-магазин"]
    posts = spark.createDataFrame(list(enumerate(texts)), "id long, normalized_text string")
    for fuzzy in (True, False):
        want = keyword_hits(posts, rules, fuzzy=fuzzy).drop("normalized_text").select(dictionary_hits(posts, rules, "id", fuzzy=fuzzy).columns)
        assert sorted(map(tuple, dictionary_hits(posts, rules, "id", fuzzy=fuzzy).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert dictionary_hits(posts, [], "id").count() == 0 and dictionary_hits(posts.limit(0), rules, "id").count() == 0
    with pytest.raises(InvalidRule):
        dictionary_hits(posts, [Rule("(", is_regex=True)], "id")


def test_deletions(spark):
    got = spark.createDataFrame([("abb",), ("a",)], "w string").select(deletions(F.col("w")).alias("d")).collect()
    assert [sorted(r.d) for r in got] == [["ab", "abb", "bb"], ["", "a"]]


def test_a_pattern_runs_only_where_the_phrase_may_stand(spark, capsys):
    rules = [Rule("the last  one"), Rule("the first")]
    texts = spark.createDataFrame([(0, "the other"), (1, "in the last one"), (2, "the  last\tone"), (3, "the lastone")], "k long, t string")
    found = dictionary_hits(texts, rules, "k", "t", fuzzy=False)
    assert {(r.k, r.position, r.matched_text) for r in found.collect()} == {(1, 0, "the last one"), (2, 0, "the  last\tone")}
    found.explain(True)
    assert "contains" in capsys.readouterr().out.lower()
