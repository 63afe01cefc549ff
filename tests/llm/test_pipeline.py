import hashlib
import importlib

import pytest

import corpus_pipeline
from gleaner.llm import queries, secrets

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{D}/documents.parquet"), []
    for _, f in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(f(spark, docs, D).toPandas()) if f is not corpus_pipeline.encoded else f(spark, docs, D)
        out.append(docs.toPandas())
    return out


def test_each_stage_does_its_work(spark, stages):
    docs = spark.read.parquet(f"{D}/documents.parquet").toPandas()
    labels = spark.read.parquet(f"{D}/labels.parquet").toPandas()
    good, unique, clean, mix, ids = stages
    for s in (good, unique, clean, mix):
        assert list(s.columns) == list(docs.columns)
    told = labels.merge(docs[["doc_id"]]).assign(kept=lambda x: x.doc_id.isin(good.doc_id))
    assert (told.kept == (told.quality == 1)).mean() > 0.95 and 0 < len(unique) < len(good) < len(docs)
    assert not unique.text.duplicated().any() and set(good.text) >= set(unique.text)
    left = spark.createDataFrame(clean)
    assert secrets.summary(left).where("n_assign + n_access + n_hex > 0").count() == 0
    same = clean.merge(unique, on="doc_id")
    assert len(same) == len(clean) == len(unique) and ((same.text_x == same.text_y) | same.text_x.str.contains("<secret>")).all()
    taken = mix.doc_id.value_counts()
    assert taken.max() <= 3 and set(taken.index) <= set(clean.doc_id)
    assert sorted(ids.doc_id) == sorted(mix.doc_id)
    texts = dict(zip(mix.doc_id, mix.text, strict=True))
    assert all(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.n_tokens == len(r.ids) for r in ids.itertuples())


def test_registered():
    import __spark_entry__ as entry

    assert {f"op{n}_" for n in range(1, 11)} == {k.split("_")[0] + "_" for k in queries.queries()}
    assert entry.queries()["pipeline"] is corpus_pipeline.run


def test_odd_rows_go_through_every_stage(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "plain words in a row", "en", None, 20), (3, "plain words in a row", "en", None, 20), (None, "no key at all here", None, "b", 5), (4, "w " * 20000, "en", "b", 40000)]
    for kept in (rows, []):
        docs = spark.createDataFrame(kept, "doc_id long, text string, lang string, source string, n_chars long")
        for _, f in corpus_pipeline.STAGES[1:]:
            docs = f(spark, docs, D)
            docs.collect()


def test_nulls_ties_and_repeats_have_defined_results(spark):
    same = "one two three four five six seven eight"
    rows = [(1, same, "a"), (1, same, "a"), (2, same, "b"), (3, None, "a"), (4, "", "a"), (None, same, None), (6, "secret = abcdef99 tail", "a")]
    docs = spark.createDataFrame([(k, t, "en", s, len(t or "")) for k, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    key = lambda found: sorted(found, key=str)
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, D).collect()]
    assert key(kept) == key([1, 1, 3, 6, None])
    masked = {(r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.without_secrets(spark, docs, D).collect()}
    assert masked == {(1, same, 39), (2, same, 39), (3, None, None), (4, "", 0), (None, same, 39), (6, "<secret> tail", 13)}
    ids = [(r.doc_id, r.n_tokens > 0) for r in corpus_pipeline.encoded(spark, docs, D).collect()]
    assert key(ids) == key([(1, True), (1, True), (2, True), (3, False), (4, False), (None, True), (6, True)])


def test_entry_survives_without_this_subpackage(monkeypatch):
    import sys

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    module = importlib.import_module("__spark_entry__")
    assert module.llm is None and not any(k.startswith("op") for k in module.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
