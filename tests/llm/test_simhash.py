import random

import numpy as np
from pyspark.sql import functions as F

from gleaner.llm import simhash
from gleaner.llm.components import components


def brute(fps: list[int]) -> list[int]:
    """For each position the smallest position reachable over links of 3 bits or less."""
    root = list(range(len(fps)))
    a = np.array(fps, np.uint64)
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            least = min(root[j] for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= simhash.RADIUS))
            if least < root[i]:
                root[i], changed = least, True
    return root


def test_links_reach_the_components_of_all_pairs(spark):
    rng = random.Random(7)
    fps = set()
    for _ in range(40):
        fp = rng.getrandbits(64)
        for _ in range(6):
            fps.add(fp)
            for bit in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
                fp ^= 1 << bit
    fps = sorted(fps) + [0, (1 << 64) - 1]
    frame = spark.createDataFrame([(i, int(np.uint64(x).astype(np.int64))) for i, x in enumerate(fps)], "i long, fp long")
    linked = simhash.links(frame.select("fp"), bucket=5000)
    roots = components(linked)
    least = frame.join(roots, frame.fp == roots.u, "left").withColumn("root", F.coalesce("root", "fp"))
    named = least.join(least.groupBy("root").agg(F.min("i").alias("c")), "root").select("i", "c").collect()
    assert [c for _, c in sorted(map(tuple, named))] == brute(fps)


def test_documents(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(5, base), (3, base.upper()), (9, base + " tail"), (1, None), (2, ""), (8, "two words"), (7, "Two\t\x0bWords "), (7, "Two\t\x0bWords "), (None, None), (20, "lonely é"), (21, base.replace("word7 ", "")), (22, "x " * 5000)]
    docs = spark.createDataFrame([(k, t, 0, "f") for k, t in rows], "doc_id long, text string, key int, fp string")
    got = simhash.near_duplicates(docs).collect()
    fps = {(r.doc_id, r.fp) for r in got}
    want = [simhash.fingerprint(t, 3) for _, t in rows]
    assert fps == {(k, int(np.uint64(f).astype(np.int64))) for (k, _), f in zip(rows, want, strict=True)}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0]))
    roots = brute([want[i] for i in order])
    assert sorted(((r.doc_id, r.component) for r in got), key=str) == sorted(((rows[i][0], rows[order[c]][0]) for i, c in zip(order, roots, strict=True)), key=str)
    kept = simhash.keep_one(docs).collect()
    assert [r.doc_id for r in kept].count(7) == 2 and {r.doc_id for r in kept} == {rows[order[c]][0] for c in roots} | {None}


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fingerprint_is_xxh64_of_shingles_by_majority(spark):
    h = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0]
    assert np.uint64(simhash.fingerprint("A\nb  c", 3)).astype(np.int64) == h
