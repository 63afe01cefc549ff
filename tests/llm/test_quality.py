import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import quality, queries


def test_votes_are_those_of_all_products():
    rng = np.random.default_rng(1)
    counts = rng.poisson(0.3, (60, quality.TERMS)).astype(np.float32)
    model = quality.Model(counts, (np.arange(60) % 2).astype(np.float32))
    queries_ = rng.poisson(0.3, (7, quality.TERMS)).astype(np.float32)
    got = model.score(queries_, neighbours=5)
    for q, s in zip(model.project(queries_), got, strict=True):
        near = sorted(((float(q @ v), y) for v, y in zip(model.vectors, model.labels, strict=True)), reverse=True)[:5]
        weights = [max(c, 0) ** 8 for c, _ in near]
        assert s == pytest.approx(sum(w * y for w, (_, y) in zip(weights, near, strict=True)) / sum(weights), rel=1e-4)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = queries.op7_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out")
    right = got.groupBy("quality").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("right")).collect()
    assert {r["quality"]: r["right"] > 0.9 for r in right} == {0: True, 1: True}


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "good words here"), (3, "good words here"), (None, "JUNK!! JUNK!!"), (4, "x " * 50000), (5, "İß"), (6, "\n\n")]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, score int, label string")
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (5, None, 0), (None, 1, 1), (9, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    assert len(model.labels) == 3
    got = quality.score(docs, model).collect()
    assert [r.doc_id for r in got] == [k for k, _ in rows] and all(0 <= r.score <= 1 for r in got) and got[2].score > 0.5 > got[5].score
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r.score >= 0.5 for r in got)
    nothing = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, nothing).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0
