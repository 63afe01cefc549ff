"""Registered queries against brute force on small tables: no row and no part of a text is left out."""

import hashlib
import math

from gleaner.functions import text
from gleaner.plans import queries


def embedded(words, dimension=384):
    v = [0.0] * dimension
    for w in words:
        h = hashlib.sha256(text.ALIASES.get(w, w).encode()).hexdigest()
        v[int(h[:8], 16) % dimension] += 1.0 if int(h[9], 16) % 2 == 0 else -1.0
    norm = math.sqrt(sum(x * x for x in v)) or 1.0
    return [x / norm for x in v]


def test_hash_embeddings_read_whole_texts(spark, tmp_path):
    words = [f"word{i % 97}" for i in range(500)]
    texts = [" ".join(words), " ".join([*words[:-1], "магазин"]), "сайт", ""]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.message_id: [float(x) for x in r.vector.split(",")] for r in queries.queries()["hash_embeddings"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [0, 1, 2, 3] and got[0] != got[1]
    for i, t in enumerate(texts):
        want = embedded(t.split())
        assert len(got[i]) == 384 and all(abs(a - b) <= 1e-4 for a, b in zip(got[i], want, strict=True))


def test_incremental_scan_all_keeps_a_hot_source_whole(spark, tmp_path):
    rows = [(i, "t", "hot" if i % 3 else f"src{i % 4}") for i in range(720)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.source_id, r.id) for r in queries.queries()["incremental_scan_all"](spark, str(tmp_path)).collect()]
    first_hour = 720 - 24 * 8  # as_of is 720 hours after the first post; a first load takes 7 + 1 days
    want = [(s, i) for i, _, s in rows if (i > 100 if s == "src0" else i > 0 and i >= first_hour)]
    assert sorted(got) == sorted(want) and sum(s == "hot" for s, _ in got) > 20


def test_subscription_matches_all_asks_every_customer(spark, tmp_path):
    segments = ["BUILDING", "MACHINERY", "HOUSEHOLD", None]
    customers = [(k, k % 25, float(k * 37 % 9000 - 900), segments[k % 4]) for k in range(120)]
    kinds = ["1-URGENT", "2-HIGH", "5-LOW"]
    orders = [(k, k % 90, "OFP"[k % 3], k * 911.5 % 190000, f"1996-01-{k % 28 + 1:02d}", kinds[k % 3]) for k in range(200)]
    spark.createDataFrame(customers, "c_custkey long, c_nationkey long, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    want = {}
    for o, source, _, price, _, kind in orders:
        for c, _, balance, segment in customers:
            types = {"BUILDING": ["1-URGENT"], "MACHINERY": ["1-URGENT", "2-HIGH"]}.get(segment)
            fits = o % 101 >= c % 100 and (types is None or kind in types) and round(price * 1.5, 4) >= round(max(balance, 0) * 30, 2)
            if fits and "for 7" not in f"order {o} {kind.lower()} for {source}":
                want.setdefault((o, c % 50), c)
    got = [((r.order_id, r.user_id), r.subscription_id) for r in queries.queries()["subscription_matches_all"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want.items()) and any(c % 10 for c in want.values())
