import random

import corpus_pipeline
from gleaner.llm import overlap

D = "/root/testdata/sf0.01"


def plain(text):
    words = text.encode().lower().split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def similarity(a, b):
    a, b = plain(a), plain(b)
    return len(a & b) / len(a | b)


def planted(seed=7):
    """Families of texts edited so that they lie on both sides of 0.8."""
    r, rows = random.Random(seed), []
    for _ in range(150):
        words = [f"w{r.randrange(5000)}" for _ in range(r.choice((40, 120, 400)))]
        rows.append(" ".join(words))
        for _ in range(2):
            copy = list(words)
            for _ in range(r.randrange(1, max(2, len(words) // 25))):
                copy[r.randrange(len(copy))] = f"x{r.randrange(10**6)}"
            rows.append(" ".join(copy))
    return rows


def test_stage_finds_near_copies_at_four_fifths(spark):
    texts = planted()
    pairs = [(i, j) for f in range(0, len(texts), 3) for i in range(f, f + 3) for j in range(i + 1, f + 3)]
    near = [p for p in pairs if similarity(texts[p[0]], texts[p[1]]) >= 0.8]
    assert 50 < len(near) < len(pairs)
    root = list(range(len(texts)))
    for i, j in near:
        a, b = sorted((root[i], root[j]))
        root = [a if x == b else x for x in root]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = {x.doc_id for x in corpus_pipeline.near_duplicates(spark, docs, D).collect()}
    assert kept == set(root)


def test_a_large_group_and_odd_rows(spark):
    r = random.Random(3)
    words = [f"w{r.randrange(5000)}" for _ in range(300)]
    rows = [(i, " ".join([*words[: i % 290], f"x{i}", *words[i % 290 + 1 :]])) for i in range(300)]
    rows += [(1000, ""), (1001, None), (1002, "two words"), (1003, "Two  words"), (1004, "other words"), (None, "two words"), (5, "an other text of key five here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((x.doc_id is None, x.doc_id or 0, x.text or "") for x in overlap.keep_one(docs).collect())
    assert [k[:2] for k in kept] == [(False, 0), (False, 5), (False, 5), (False, 1000), (False, 1002), (False, 1004), (True, 0)]


def boilerplate(families, shared, own, seed=11):
    """Texts that all share a passage; the two of a family share their own words too, but for a few."""
    r = random.Random(seed)
    common, rows = " ".join(f"c{r.randrange(5000)}" for _ in range(shared)), []
    for f in range(families):
        words = [f"w{r.randrange(10**7)}" for _ in range(own)]
        other = list(words)
        for _ in range(r.randrange(1, 4)):
            other[r.randrange(own)] = f"x{r.randrange(10**7)}"
        rows += [f"{common} {' '.join(words)}", f"{common} {' '.join(other)}"]
    return rows


def test_families_that_share_a_passage_with_all_others(spark):
    """330 of 390 words are shared by all 1200 texts, whose similarity across families is 0.73: one bucket of many classes."""
    texts = boilerplate(600, 330, 60)
    assert 0.7 < similarity(texts[0], texts[2]) < 0.8
    near = {i for i in range(0, len(texts), 2) if similarity(texts[i], texts[i + 1]) >= 0.8}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = {x.doc_id for x in overlap.keep_one(docs).collect()}
    gone = set(range(len(texts))) - kept
    assert gone <= {i + 1 for i in near}  # no family is joined to another
    assert len(near) > 500 and len(gone) >= 0.99 * len(near)


def test_rare_shingles_open_every_pair(spark):
    """The exact way alone: all pairs that overlap enough share one of the first shingles, whatever is common to all."""
    texts = boilerplate(30, 60, 30) + planted(9)[:90] + [" ".join(f"s{i}" for i in range(k)) for k in range(5, 40)]
    sets = {i: overlap.shingles(t) for i, t in enumerate(texts)}
    frame = spark.createDataFrame([(i, [int(x) for x in s.view("int64")]) for i, s in sets.items()], "fp long, shingles array<long>")
    rooted = spark.createDataFrame([(i, i) for i in sets], "fp long, root long")
    met = {(x.u, x.v) for x in overlap._pairs_outside(overlap.first_shingles(frame), rooted).collect()}
    want = {(i, j) for i in sets for j in sets if i < j and similarity(texts[i], texts[j]) >= 0.8}
    assert len(want) > 60 and want <= met and len(met) < 3 * len(want)
