"""Semantic duplicates: blocks against all pairs, random projections against the exact form, chains of merges."""

import datetime as dt
import math
import random
from decimal import Decimal

import numpy as np
import pytest

from gleaner.operators import semantic
from gleaner.settings import Settings

SCHEMA = "order_id string, published_at timestamp, project_type string, embedding array<float>, canonical_order_id string, duplicate_group_id string, group_size long, method string, contacts map<string,array<string>>, budget_from decimal(14,2), budget_to decimal(14,2), budget_currency string, budget_negotiable boolean, deadline date, deadline_text string, title string, summary string, relevance_score int"
START = dt.datetime(2024, 1, 1)


def order(key, hours, vector, kind=None, canonical=None, group=None, budget=None, relevance=0):
    return (key, START + dt.timedelta(hours=hours), kind, vector, canonical, group, 2 if group else None, "fingerprint" if group else None, None, budget and Decimal(budget), None, None, None, None, None, "t", None, relevance)


def near(x, y):
    return sum(p * q for p, q in zip(x, y)) / math.sqrt(sum(p * p for p in x)) / math.sqrt(sum(q * q for q in y))


@pytest.mark.parametrize("chunk", [5, 4096])
@pytest.mark.parametrize("earlier", [False, True])
def test_blocks_equal_all_pairs(spark, chunk, earlier):
    draw = random.Random(3)
    rows = []
    for i in range(150):
        canonical = draw.choice([None] * 6 + [f"o{i:03}", "o000"])
        rows.append(order(f"o{i:03}", draw.randrange(24 * 30), [float(draw.choice([-1, 0.5, 2, 0.25])) for _ in range(4)], draw.choice(["a", "a", "b", None]), canonical, canonical and "g"))
    odd = [order("x1", 5, None), order("x2", 5, [0.0] * 4), order("x3", 5, [math.nan] * 4), order("x4", 5, [1.0, 2.0])]
    settings = Settings(semantic_candidates=3)
    got = semantic.near_orders(spark.createDataFrame(rows + odd, SCHEMA), settings, earlier, chunk=chunk)
    want = []
    place = lambda r: (r[1], -(r[2] is not None), r[0])
    for a in rows:
        if a[4] is None:
            met = [(-near(a[3], b[3]), b[0]) for b in rows if b[0] != a[0] and b[4] in (None, b[0]) and abs(a[1] - b[1]) <= dt.timedelta(days=7) and (a[2] == b[2] or None in (a[2], b[2])) and (not earlier or place(b) < place(a))]
            want += [(a[0], k, round(-s, 9), n + 1) for n, (s, k) in enumerate(sorted(met)[:3])]
    assert sorted((r.order_id, r.candidate_id, round(r.similarity, 9), r["rank"]) for r in got.collect()) == sorted(want)


def test_random_projections_find_the_near_ones(spark):
    r = np.random.default_rng(1)
    rows = []
    for f in range(80):
        centre = r.normal(size=48)
        rows += [order(f"{f}-{i}", float(r.integers(0, 100)), (centre + r.normal(size=48) * 0.4).tolist()) for i in range(3)]
    rows += [order(f"hot{i}", 50, [1.0] * 48) for i in range(90)]  # copies: one bucket of every table
    frame = spark.createDataFrame(rows, SCHEMA)
    exact = {(x.order_id, x.candidate_id) for x in semantic.near_orders(frame).collect() if x.similarity >= 0.82 and not x.order_id.startswith("hot")}
    found = {(x.order_id, x.candidate_id): x.similarity for x in semantic.near_orders(frame, approximate=(32, 10, 1.0), chunk=64).collect()}
    recall = len(exact & set(found)) / len(exact)
    assert len(exact) > 250 and recall >= 0.9, recall
    assert len([k for k in found if k[0].startswith("hot")]) == 90 * 20
    assert semantic.near_orders(frame.limit(0), approximate=(4, 4, 1.0)).count() == 0


def test_chains_end_in_one_group(spark):
    v = lambda turn: [math.cos(turn), math.sin(turn)]
    step = 0.4  # cos 0.92: merges; two steps apart 0.70: no match
    rows = [order(f"c{i}", i, v(step * i)) for i in range(6)]
    rows += [order("g1", 0, v(3.0), canonical="g1", group="g"), order("g2", 1, v(3.0), canonical="g1", group="g"), order("late", 2, v(3.1)), order("later", 3, v(3.2))]
    rows += [order("rich", 4, v(-1.5), budget=100), order("poor", 5, v(-1.5), budget=10), order("alone", 900, v(0.0)), order("review", 6, v(-1.0)), order("none", 7, None)]
    out, audit = semantic.merge_semantic(spark.createDataFrame(rows, SCHEMA))
    got = {r.order_id: (r.canonical_order_id, r.duplicate_group_id, r.group_size, r.method, r.semantic_status) for r in out.collect()}
    assert len(got) == len(rows)
    assert got["c0"] == ("c0", "semantic:c0", 6, "semantic", "no_match")
    assert {got[f"c{i}"] for i in range(1, 6)} == {("c0", "semantic:c0", 6, "semantic", "auto_merge")}
    assert got["g1"] == got["g2"] == ("g1", "g", 4, "fingerprint", None)
    assert got["late"] == got["later"] == ("g1", "g", 4, "semantic", "auto_merge")
    assert got["rich"][0] is None and got["poor"][0] is None and got["poor"][4] == "no_match" and got["alone"][:2] == (None, None)
    assert got["review"] == (None, None, None, None, "manual_review") and got["none"] == (None,) * 5
    told = sorted((r.action, r.entity_id) for r in audit.collect())
    assert told == [*[("duplicate.semantic_auto_merge", k) for k in ("c1", "c2", "c3", "c4", "c5", "late", "later")], ("duplicate.semantic_review_candidate", "review")]


def test_long_chains_and_circles(spark):
    chain = spark.range(1, 5000).selectExpr("id as node", "id - 1 as to")
    assert semantic.followed(chain).where("root <> 0").count() == 0
    with pytest.raises(ValueError):
        semantic.followed(spark.createDataFrame([(1, 2), (2, 1)], "node long, to long"), rounds=5)
    assert semantic.followed(chain.limit(0)).count() == 0
