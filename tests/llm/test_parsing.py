import hashlib
import random

import numpy as np
import pytest

from gleaner.llm import parsing


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_each_row_meets_its_next(spark):
    rng = random.Random(5)
    rows = [(i * 3, words(rng, rng.randint(0, 80))) for i in range(200)] + [(1000, None), (1001, ""), (1002, "x" * 5000), (1003, "é🙂é"), (1004, "a"), (1005, ""), (1004, "b"), (None, "null key"), (1006, words(rng, 20000))]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, bucket int, fingerprint string").repartition(7)
    got = sorted(map(tuple, parsing.compare_with_next(docs).collect()), key=str)
    order = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = []
    for (k, t), (_, n) in zip(order, order[1:] + order[:1], strict=True):
        e = parsing.edited(t, n)
        a, b, c = (parsing.sketches([x])[0] for x in (t, e, n))
        want.append((k, len(t), hashlib.sha256(e.encode()).hexdigest(), parsing.as_text(a), parsing.as_text(b), parsing.likeness(a, b), parsing.likeness(a, c)))
    assert got == sorted(want, key=str)


def test_equal_substrings_share_interior_phrases():
    rng = random.Random(1)
    inner = words(rng, 300)
    a, b, other = parsing.sketches([inner, words(rng, 7) + inner + words(rng, 9), words(rng, 300)])
    assert parsing.likeness(a, b) > 0.8 > 0.1 > parsing.likeness(a, other)
    for outer in ("", "q", "zz top "):
        names = np.frombuffer((outer + inner).encode("utf-32-le"), np.uint32).astype(np.uint64)
        first = np.zeros(len(names), bool)
        first[0] = True
        starts = {int(x) - len(outer) for x in parsing.phrases(names, first)}
        if not outer:
            alone = starts
        assert {x for x in alone if 20 < x < len(inner) - 20} == {x for x in starts if 20 < x < len(inner) - 20}


def test_a_text_is_parsed_alike_in_any_company():
    texts = ["", "a", "aaaa", "abab" * 50, "hello world", "", "x" * 1000, "hello world"]
    together = parsing.sketches(texts)
    assert all((s == parsing.sketches([t])[0]).all() for t, s in zip(texts, together, strict=True))
    assert parsing.as_text(together[0]) == "" and parsing.likeness(together[0], together[5]) == 1.0 and parsing.likeness(together[0], together[1]) == 0.0


def test_general_interface_and_small_tables(spark):
    kind = "doc_id long, text string"
    assert parsing.compare_with_next(spark.createDataFrame([], kind)).count() == 0
    one = parsing.compare_with_next(spark.createDataFrame([(4, "abcd")], kind)).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0
    assert parsing.fingerprints(spark.createDataFrame([(1, None), (2, "ab")], kind)).first()["fingerprint"] == ""


@pytest.mark.parametrize("bits", [8, 64])
def test_tossed_labels_differ_between_neighbours(bits):
    rng = np.random.default_rng(0)
    names = rng.integers(0, 1 << (bits - 1), 5000).astype(np.uint8 if bits == 8 else np.uint64)
    names = names[np.concatenate([[True], names[1:] != names[:-1]])]
    first = np.zeros(len(names), bool)
    first[0] = True
    for _ in range(3):
        names = parsing.toss(names, first)
        assert (names[1:] != names[:-1]).all()
    assert names.max() < 8


FULL = (1 << 64) - 1
ODD = 0x9E3779B97F4A7C15


def plainly_mixed(x):
    x = ((x ^ x >> 31) * ODD) & FULL
    x = ((x ^ x >> 29) * 0xBF58476D1CE4E5B9) & FULL
    return x ^ x >> 32


def plainly_tossed(labels):
    """Twice the place of the lowest bit in which a label differs from the one before, plus that bit; the first differs in bit 0."""
    out = [labels[0] & 1] if labels else []
    for before, own in zip(labels, labels[1:]):
        place = 0
        while (before >> place & 1) == (own >> place & 1):
            place += 1
        out.append(2 * place + (own >> place & 1))
    return out


def plainly_parsed(names):
    """The names of the next level, one name at a time."""
    runs = []  # [name, how often]
    for n in names:
        if runs and runs[-1][0] == n:
            runs[-1][1] += 1
        else:
            runs.append([n, 1])
    labels = [n for n, _ in runs]
    for _ in range(3):
        labels = plainly_tossed(labels)
    phrases = []
    for i, (n, often) in enumerate(runs):
        peak = 0 < i < len(runs) - 1 and labels[i - 1] < labels[i] > labels[i + 1]
        if i == 0 or peak or often > 1 or runs[i - 1][1] > 1:
            phrases.append([])
        phrases[-1] += [n] * often
    return [plainly_mixed(sum(plainly_mixed((n + (j + 1) * ODD) & FULL) for j, n in enumerate(p)) & FULL) for p in phrases]


def plain_sketch(text):
    bands, names = (16, 32, 64), [ord(c) for c in text]
    slots = [[0xFFFFFFFF] * b for b in bands]
    for level in range(1, 7):
        names = plainly_parsed(names)
        band = slots[min(level, 3) - 1]
        for n in names:
            v = plainly_mixed((n + level * ODD) & FULL)
            at = (v >> 40) % len(band)
            band[at] = min(band[at], v & 0xFFFFFFFF, 0xFFFFFFFE)
    return sum(slots, [])


def test_as_parsed_name_by_name():
    rng = random.Random(8)
    texts = ["", "a", "ab", "aa", "aab", "abb", "abc", "x" * 300, "ab" * 100, "é🙂é" * 9, *[words(rng, n) for n in (1, 2, 3, 10, 50, 300)], *["".join(rng.choice("ab") for _ in range(rng.randrange(1, 200))) for _ in range(40)]]
    for text, sketch in zip(texts, parsing.sketches(texts), strict=True):
        assert sketch.tolist() == plain_sketch(text), text[:50]
