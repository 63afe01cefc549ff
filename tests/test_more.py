"""Each query of plans.more against its SQL on the smallest tables, and the edges that those tables lack."""

import os

import duckdb
import pytest

from gleaner.operators import dedup, notify, orders
from gleaner.plans import more
from gleaner.sources import scratch

TABLES = "/root/testdata/sf0.001"


def told(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=str)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the test tables")
@pytest.mark.parametrize("name", more.ORACLES)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("customer", "documents", "embeddings", "events", "labels", "orders", "part", "supplier"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{TABLES}/{table}.parquet'")
    made = more.queries()[name](spark, TABLES)
    want = con.execute(more.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(made.columns) == sorted(columns)
    assert told([tuple(r) for r in made.collect()], made.columns) == told(want.fetchall(), columns)


def test_unknown_time_zones_are_refused(spark):
    kinds = "timezone string, quiet_hours_start string, quiet_hours_end string, budget_min double, budget_max double, min_relevance_score int, " + ", ".join(f"{c} array<string>" for c in ("project_types", "currencies", "source_ids", "positive_keywords", "negative_keywords"))
    rows = [(z, None, None, None, None, 1, None, None, None, None, None) for z in ("Asia/Tokyo", "Foo/Bar", "UTC", "", None)]
    got = {r.timezone: r.error for r in notify.validate_subscriptions(spark.createDataFrame(rows, kinds)).collect()}
    assert got == {"Asia/Tokyo": None, "Foo/Bar": "timezone", "UTC": None, "": "timezone", None: None}


def test_a_favourite_is_added_once(spark):
    kinds = "user_id long, order_id long, created_at timestamp"
    old = spark.createDataFrame([(1, 1, None)], kinds)
    every, added = orders.add_favourites(old, spark.createDataFrame([(1, 1, None), (1, 2, None), (1, 2, None)], kinds))
    assert every.count() == 2 and [r.order_id for r in added.collect()] == [2]


def test_a_chosen_order_leads_its_group_alone(spark):
    rows = spark.createDataFrame([(1, 7, 1), (2, 7, 1), (3, 8, 3), (4, None, None)], "order_id long, duplicate_group_id long, canonical_order_id long")
    out, audit = dedup.set_canonical(rows, spark.createDataFrame([(2,), (4,), (9,)], "order_id long"))
    assert {r.order_id: r.canonical_order_id for r in out.collect()} == {1: 2, 2: 2, 3: 3, 4: None}
    assert [r.payload for r in audit.collect()] == ['{"from":1,"to":2}']


def test_dropped_tables_are_gone_and_others_stay(spark):
    a, b = scratch.stored(spark.range(5), "a"), scratch.stored(spark.range(3), "b")
    folders = [f.inputFiles()[0].rpartition("/")[0].removeprefix("file://") for f in (a, b)]
    scratch.dropped(a)
    assert not os.path.exists(folders[0]) and b.count() == 3
