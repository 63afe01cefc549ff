from collections import Counter

from pyspark.sql import functions as F

from gleaner.llm import language, queries
from gleaner.llm.common import held_out


def slow_grams(text):
    clean = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    if not clean.strip():
        return Counter()
    clean = " " + " ".join(clean.split()) + " "
    return Counter(clean[i : i + n] for n in (1, 2, 3) for i in range(len(clean) - n + 1) if clean[i : i + n] != " ")


def unpack(code):
    out = ""
    while code:
        out, code = chr(code & (1 << 21) - 1) + out, code >> 21
    return out


def test_grams_as_counted_slowly():
    for text in ["The  cat, the CAT.", "Été à 42", "12 34", "", None, "日本 x", "a" * 1000, "İß"]:
        codes, counts = language.grams(text)
        assert {unpack(int(c)): int(n) for c, n in zip(codes, counts, strict=True)} == dict(slow_grams(text))


def test_prediction_is_least_out_of_place(spark):
    train = [(1, "the cat and the dog of the house", "en"), (2, "le chat et le chien de la maison", "fr"), (3, None, "fr"), (4, "und", None), (None, "x", "de")]
    profiles = language.learn(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert set(profiles) == {"en", "fr"}
    rows = [(1, "the dog"), (2, "la maison et le chat"), (3, None), (4, "  "), (5, "123 !"), (None, "the"), (6, "the " * 20000), (1, "the dog")]
    got = language.predict(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int"), profiles).collect()
    for (key, text), r in zip(rows, got, strict=True):
        own = sorted(slow_grams(text).items(), key=lambda x: (-x[1], len(x[0]), x[0]))[: language.DEPTH]
        ranks = {n: {unpack(c): i for i, c in enumerate(p)} for n, p in profiles.items()}
        far = {n: sum(abs(ranks[n][g] - i) if g in ranks[n] else language.DEPTH for i, (g, _) in enumerate(own)) for n in ranks}
        want = min(sorted(far), key=far.get) if own else "und"
        assert (r.doc_id, r.lang_pred) == (key, want) and 0 <= r.score <= 1 and (not own or abs(r.score - (1 - far[want] / language.DEPTH / len(own))) < 1e-9)


def test_more_languages_than_a_block(spark):
    train = [(i, f"{chr(97 + i)}{chr(98 + i % 20)} " * 5, f"l{i:02d}") for i in range(20)]
    profiles = language.learn(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    rows = spark.createDataFrame([*[(i, t) for i, t, _ in train], (30, None), (31, "zz")], "doc_id long, text string")
    whole = [tuple(r) for r in language.predict(rows, profiles).collect()]
    assert len(profiles) == 20 and [w[1] for w in whole[:20]] == [x for _, _, x in train] and whole[20][1:] == ("und", 0.0)
    assert [tuple(r) for r in language.predict(rows, profiles, block=3).collect()] == whole


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op2_language(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "text"), "doc_id").where("text is not null and lang is not null")
    right, n, total = got.agg(F.avg(F.when(F.col("held_out"), (F.col("lang") == F.col("lang_pred")).cast("int"))), F.sum(F.col("held_out").cast("int")), F.count("*")).first()
    assert right > 0.95 and 0 < n < total
    assert got.where(F.col("held_out") != held_out(4, 2)).count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.learn(none) == {} and language.predict(none, {}).count() == 0
    assert language.predict(spark.createDataFrame([(1, "x")], "doc_id long, text string"), {}).first()["lang_pred"] == "und"
