"""Pairs of chunks are dealt to as many tasks as there are pairs."""

import numpy as np

from gleaner.operators import semantic


def test_pairs_of_chunks_are_dealt_to_tasks_of_their_own(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "one", [float(x) for x in rng.normal(size=8)]) for i in range(200)]
    pairs = semantic.similar_pairs(spark.createDataFrame(rows, "id long, block string, v array<double>"), "id", "v", "block", most=3, chunk=20)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and ", 100), REPARTITION_BY_NUM" in plan
    assert pairs.count() == 600
