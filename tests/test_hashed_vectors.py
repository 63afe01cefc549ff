"""Hashed vectors are made batch by batch and equal the column form."""

import pytest
from pyspark.sql import functions as F

from gleaner.operators import semantic


def test_hashed_vectors_shuffle_nothing_and_equal_the_column_form(spark):
    words = [["a", "b", "a"], [], None, ["x", None, "ü"], [f"w{i % 37}" for i in range(500)]]
    rows = spark.createDataFrame(list(enumerate(words)), "id long, t array<string>")
    made = semantic.hashed_vectors(rows, "id", "t", 16)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    want = {r.id: r.v for r in rows.where("size(t) > 0").select("id", semantic.hash_embedding(F.filter("t", lambda w: w.isNotNull()), 16).alias("v")).collect()}
    got = {r.id: r.vector for r in made.collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-12) for i in want)
