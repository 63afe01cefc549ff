import hashlib
import math
import random

import numpy as np

from gleaner.llm import codes


def brute(rows, scale=4096):
    """rows: (id, vector, label); the contract, part by part and in plain lists."""
    kept = [(i, [math.floor(scale * c) for c in v], label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max(1, -(-max(len(v) for _, v, _ in kept) // 8))
    kept = [(i, v + [0] * (8 * width - len(v)), label) for i, v, label in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:16]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in first] for p in range(8)]
    near = lambda part, book: min((sum((a - b) ** 2 for a, b in zip(part, e)), n) for n, e in enumerate(book))
    for _ in range(6):
        for p, book in enumerate(books):
            of = [near(cut(v, p), book)[1] for _, v, _ in kept]
            for n in range(len(book)):
                mine = [cut(v, p) for (_, v, _), o in zip(kept, of) if o == n]
                if mine:
                    book[n] = [sum(x) // len(mine) for x in zip(*mine)]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    told = [(i, [near(cut(v, p), books[p]) for p in range(8)], label) for i, v, label in kept]
    by = {}
    for _, found, label in told:
        by[label] = by.get(label, 0) + sum(d for d, _ in found)
    key = lambda r: (r[0] is None, *map(str, r))
    return sorted([(i, "".join(f"{n:02x}" for _, n in found), sum(d for d, _ in found), by[label], sha) for i, found, label in told], key=key)


def compressed(spark, rows):
    frame = spark.createDataFrame([(i, v, label, "x", 7) for i, v, label in rows], "vec_id long, embedding array<double>, label int, code string, pos int")
    got = codes.compress(frame)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted(map(tuple, got.collect()), key=lambda r: (r[0] is None, *map(str, r)))


def test_as_told(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, -0.00001, 0.0, 0.25, rng.gauss(0, 1)]) for _ in range(16)], rng.choice([1, 2, None])) for i in range(120)]
    rows += [(200, None, 1), (201, [None] * 16, 1), (202, [float("nan")] * 16, 1), (203, [float("inf")] * 16, 2), (-4, [1.0, 2.0], 9), (-3, [], None), (None, rows[0][1], 3), (5, rows[5][1], 1), (5, rows[6][1], 1)]
    assert compressed(spark, rows) == brute(rows)


def test_few_and_copied_rows(spark):
    rows = [(i, [float(i % 3)] * 8, i % 2) for i in range(9)]
    assert compressed(spark, rows) == brute(rows)
    assert compressed(spark, rows[:1]) == brute(rows[:1])
    hot = [(i, [0.5] * 8, 1) for i in range(400)] + [(400 + i, [i / 7.0] * 8, 1) for i in range(30)]  # one vector, most of the rows
    assert compressed(spark, hot) == brute(hot)


def test_none(spark):
    assert compressed(spark, []) == []
    assert compressed(spark, [(1, None, 1)]) == []


def test_trie_shares_prefixes_and_finds_the_nearest(monkeypatch):
    rng = np.random.default_rng(1)
    parts = np.unique(rng.integers(-3, 4, (4000, 5)), axis=0)
    book = rng.integers(-3, 4, (16, 5))
    far = ((parts[:, None, :] - book[None]) ** 2).sum(2)
    for subtree in (1, 50, 10_000):
        monkeypatch.setattr(codes, "SUBTREE", subtree)
        best, least = codes.nearest(parts, book)
        assert (best == far.argmin(1)).all() and (least == far.min(1)).all()
    best, least = codes.nearest(parts[:0], book)
    assert len(best) == len(least) == 0
