"""Changes of a key that have the same order: what they do decides, not where the log's rows lie."""

import random

import pytest

from gleaner.sources import changes

RULES, LOG = "id string, phrase string, weight int", "id string, at int, op string, phrase string, weight int"


def test_a_create_and_its_repeat_go_by_value(spark):
    for log in ([("a", 1, "create", "new", 2), ("a", 1, "create", "new", 11)], [("a", 1, "create", "new", 11), ("a", 1, "create", "new", 2)]):
        after, told = changes.apply_log(spark.createDataFrame([], RULES), spark.createDataFrame(log, LOG).coalesce(1), "id", "at", valid=lambda r: r["weight"] > 2)
        assert [tuple(r) for r in after.collect()] == [("a", "new", 11)]
        assert {r.weight: r.outcome for r in told.collect()} == {11: "ok", 2: "duplicate"}


@pytest.mark.parametrize("part", [20, 1 << 18])
def test_the_layout_of_the_log_decides_nothing(spark, part):
    draw = random.Random(7)
    table = [(f"k{i}", f"p{i}", i) for i in range(6)]
    log = [(f"k{draw.randrange(8)}", draw.randrange(5), draw.choice(["create", "update", "delete"]), draw.choice([None, "a", "b"]), draw.choice([None, 1, 12, 5])) for _ in range(150)]
    found = []
    for _ in range(2):
        draw.shuffle(log)
        after, told = changes.apply_log(spark.createDataFrame(table, RULES), spark.createDataFrame(log, LOG), "id", "at", unique=("phrase",), part=part)
        found.append((sorted(map(tuple, after.collect()), key=str), sorted(map(tuple, told.collect()), key=str)))
    assert found[0] == found[1]
