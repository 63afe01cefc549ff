import hashlib
import random
from collections import Counter

import pytest

from gleaner.llm import repeats


def brute(rows, least):
    texts = [(t or "").encode() for _, t in rows]
    times = Counter(t[p : p + least] for t in texts for p in range(len(t) - least + 1))
    out = []
    for (k, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for p in range(len(t) - least + 1):
            if times[t[p : p + least]] > 1:
                gone[p : p + least] = b"\1" * least
        runs = sum(1 for i, x in enumerate(gone) if x and (not i or not gone[i - 1]))
        out.append((k, len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, x in zip(t, gone, strict=True) if not x)).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n))
    passages = [noise(n) for n in (60, 150, 199, 210, 260, 700)]
    rows = []
    for i in range(120):
        rows.append((i, noise(rng.randint(0, 300)) + rng.choice(passages) + noise(rng.randint(0, 200)) + rng.choice(passages)[rng.randint(0, 30) :]))
    copy = noise(900)
    rows += [(200, copy), (201, copy), (202, copy[:450] + "X" + copy[451:]), (203, None), (204, ""), (205, "short"), (206, "Der " * 700), (207, "Der " * 300), (208, "z" * 2000), (209, copy[:205]), (209, copy), (209, copy), (None, copy[100:500])]
    rows += [(300 + i, noise(100) + passages[-1] + noise(100)) for i in range(60)]
    return rows


@pytest.mark.parametrize(("least", "kgram", "leaves"), [(200, 32, 256), (200, 32, 4), (40, 8, 3)])
def test_same_as_all_windows_counted(spark, least, kgram, leaves):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, spans string")
    got = repeats.digests(docs, least=least, kgram=kgram, leaves=leaves).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, least)


def test_long_texts_in_parts(spark, monkeypatch):
    rng = random.Random(9)
    data = bytes(rng.choice(b"abcdefgh") for _ in range(5000))
    whole = list(repeats.pieces([data]))
    monkeypatch.setattr(repeats, "CHUNK", 512)
    parts = list(repeats.pieces([data, b"x", data[:300]]))
    windows = lambda found, i: [(s + w, h) for t, s, n, _, h in found if t == i for w in range(n)]
    assert windows(parts, 0) == windows(whole, 0) and [x for x, _ in windows(parts, 2)] == list(range(101))


def test_maximal_repeats_are_left_and_right_maximal():
    rng = random.Random(0)
    word = lambda n: bytes(rng.choice(b"ab") for _ in range(n))
    texts = [word(30) for _ in range(8)]
    least = 5
    leaves = [(t, len(t) - least + 1) for t in texts]
    got = {(n, tuple(sorted(o))) for n, o in repeats.maximal_repeats(leaves, least)}
    want = set()
    for length in range(least, 31):
        at = {}
        for i, t in enumerate(texts):
            for p in range(len(t) - length + 1):
                at.setdefault(t[p : p + length], []).append((i, p))
        for s, o in at.items():
            left = {texts[i][p - 1] if p else (i, -1) for i, p in o}
            right = {texts[i][p + length] if p + length < 30 else (i, -1) for i, p in o}
            if len(o) > 1 and len(left) > 1 and len(right) > 1:
                want.add((length, tuple(sorted(o))))
    assert got == want


def test_empty_table(spark):
    assert repeats.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
