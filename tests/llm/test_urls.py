import pytest
from pyspark.sql import functions as F

from gleaner.llm import urls

ROWS = [
    (1, "http://A.Example.NET/en/x?y=/de/", ("a.example.net", "/en/x", "example.net/en/", "allow")), (2, "https://net/", ("net", "/", "net/", "block")), (3, "https://a.net?x", ("a.net", "", None, "allow")),
    (4, None, ("", "", None, "allow")), (5, "no scheme /de/", ("", "", None, "allow")), (6, "x://example.com/de/a#b", ("example.com", "/de/a", "example.com/de/", "block")),
    (7, "x://notexample.com/de/a", ("notexample.com", "/de/a", None, "allow")), (8, "http://é.org/fr/http://b.net/", ("é.org", "/fr/http://b.net/", "org/fr/", "allow")), (9, "http://bad.com/utm_a", ("bad.com", "/utm_a", None, "block")),
    (9, "http://bad.com/utm_a", ("bad.com", "/utm_a", None, "block")), (None, "://", ("", "", None, "allow")), (10, "http://x.com/" + "a" * 50000, ("x.com", "/" + "a" * 50000, None, "allow")),
]


@pytest.mark.parametrize("shard_keys", [urls.SHARD_KEYS, 2])
def test_hosts_paths_rules_and_list(spark, shard_keys):
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u, _ in ROWS], "page_id long, url string, host string, listed string")
    got = urls.judge(pages, urls.RULES, urls.tracked(), shard_keys=shard_keys).collect()
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=str) == sorted(((k, *w) for k, _, w in ROWS), key=str)


@pytest.mark.parametrize("shard_keys", [urls.SHARD_KEYS, 1500])
def test_cascade_is_exact_over_its_universe(spark, shard_keys):
    universe = spark.range(20000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    cascade = urls.build(universe, shard_keys)
    assert len(cascade.levels) > 2 and cascade.shards == -(-20000 // shard_keys)
    told = cascade.marked(universe, "key", "told")
    assert told.count() == 20000 and told.where("told <> listed").count() == 0


def test_empty_table_and_empty_list(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(pages, urls.RULES, urls.tracked()).count() == 0
    one = spark.createDataFrame([("a", False)], "key string, listed boolean")
    assert urls.build(one).marked(one, "key", "told").where("told").count() == 0
