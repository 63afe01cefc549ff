"""Logs of changes against a plain loop, over one part and over many; unique columns; audit rows."""

import random

import pytest

from gleaner.sources import changes

RULES, LOG = "id string, phrase string, lang string, weight int", "id string, at int, op string, phrase string, weight int, note string"


def slow(table, log):
    rows, told = {k: {"phrase": p, "lang": x, "weight": w} for k, p, x, w in table}, []
    for k, at, op, phrase, weight, _ in sorted(log, key=lambda r: r[1]):
        state, new = rows.get(k), {n: v for n, v in (("phrase", phrase), ("weight", weight)) if v is not None}
        after = None if op == "delete" else {**{"phrase": None, "lang": None, "weight": None}, **(state or {}), **new}
        outcome = "ok"
        if op == "create" and state:
            outcome = "duplicate"
        elif op != "create" and not state:
            outcome = "not_found"
        elif after and (after["weight"] or 0) < 0:
            outcome = "invalid"
        elif after == state:
            outcome = "no_op"
        if outcome == "ok":
            rows.pop(k, None)
            if after:
                rows[k] = after
        told.append((k, at, outcome))
    return sorted((k, v["phrase"], v["lang"], v["weight"]) for k, v in rows.items()), sorted(told)


@pytest.mark.parametrize("part", [25, 1 << 18])
def test_as_applied_one_by_one(spark, part):
    draw = random.Random(3)
    table = [(f"k{i}", f"p{i}", draw.choice(["ru", None]), i) for i in range(30)] + [("hot", "p", "ru", 1)]
    log = []
    for at in range(400):
        key = "hot" if at % 3 == 0 else f"k{draw.randrange(45)}"
        log.append((key, at, draw.choice(["create", "update", "update", "update", "delete"]), draw.choice([None, "a", "b"]), draw.choice([None, -1, 5, 6]), "x"))
    draw.shuffle(log)
    after, told = changes.apply_log(spark.createDataFrame(table, RULES), spark.createDataFrame(log, LOG), "id", "at", valid=lambda r: (r.get("weight") or 0) >= 0, part=part)
    rows, outcomes = slow(table, log)
    assert sorted(map(tuple, after.collect())) == rows
    assert sorted((r.id, r["at"], r.outcome) for r in told.collect()) == outcomes
    assert {o for _, _, o in outcomes} == {"ok", "no_op", "not_found", "duplicate", "invalid"}


def test_unique_columns(spark):
    table = [("a", "x", "ru", 1), ("b", "y", "ru", 1), ("c", "z", "ru", 1)]
    log = [("a", 1, "update", "y", None, ""), ("b", 2, "update", "z", None, ""), ("n", 4, "create", "w", 1, ""), ("m", 3, "create", "w", 1, ""), ("c", 5, "update", None, 9, ""), (None, 6, "update", "q", None, "")]
    after, told = changes.apply_log(spark.createDataFrame(table, RULES), spark.createDataFrame(log, LOG), "id", "at", unique=("phrase",))
    assert {r.id: (r.phrase, r.weight) for r in after.collect()} == {"a": ("x", 1), "b": ("y", 1), "c": ("z", 9), "m": ("w", 1)}
    assert {r.id: r.outcome for r in told.collect()} == {"a": "conflict", "b": "conflict", "n": "conflict", "m": "ok", "c": "ok", None: "not_found"}
    audit = {(r.action, r.entity_id): r.payload for r in changes.change_audit(told, "keyword", "id").collect()}
    assert audit == {("keyword.create", "m"): '{"fields":["phrase","weight"]}', ("keyword.update", "c"): '{"fields":["weight"]}'}


def test_nothing_to_change(spark):
    table = spark.createDataFrame([("a", "x", "ru", 1)], RULES)
    after, told = changes.apply_log(table, spark.createDataFrame([], LOG), "id", "at", unique=("phrase",))
    assert after.count() == 1 and told.count() == 0
    after, told = changes.apply_log(table.limit(0), spark.createDataFrame([("a", 1, "delete", None, None, "")], LOG), "id", "at")
    assert after.count() == 0 and told.first().outcome == "not_found"
