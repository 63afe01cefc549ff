"""Document fingerprints by locally consistent parsing.

A text is a string of names (code points at first).  Deterministic coin tossing labels each name by where it
first differs from its left neighbour, three times over, until few labels are left; names whose label is
greater than both neighbours' start a phrase.  Runs of one name are phrases of their own.  A phrase is named by
a hash of the names in it, and the string of phrase names is parsed again, level by level.  Where a phrase
starts depends only on a few names around it, so equal substrings share all phrases but those near their ends,
whatever their offset.

The fingerprint is a sketch of the phrase names in bands: level 1, level 2, and all from level 3 up.  A band
has a fixed number of slots and keeps for each slot the least mixed name that falls in it.  Likeness of two
fingerprints is the share of slots that agree, of those filled in either, in the highest band with enough of
them.  Equal texts have equal fingerprints.

Many texts are parsed in one pass over arrays, with their borders held apart, so the parse of a text never
depends on what stands beside it.

Defined results: null counts as empty; the empty text's fingerprint is empty; two empty texts are alike (1.0),
an empty and another text are not (0.0); rows with the same key are ordered by text; with one row it is its
own next document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import small_batches, text_or_empty

#: Slots of each band; the last holds all higher levels.  A band counts in likeness from so many filled slots.
BANDS, ENOUGH, LEVELS = (16, 32, 64), 10, 6
#: Buckets of the key for each shuffle partition.
BUCKETS = 8
BATCH_POINTS = 1 << 19
MULTIPLY = np.uint64(0x9E3779B97F4A7C15)  # an odd constant for mixing
EMPTY = np.uint32(0xFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit names."""
    x = (x ^ (x >> np.uint64(31))) * MULTIPLY
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def toss(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """New labels: twice the place of the lowest bit in which a name differs from its left neighbour, plus that bit of its own.  Neighbours differ, and so do their labels."""
    left = np.empty_like(names)
    left[1:] = names[:-1]
    left[first] = ~names[first]  # a text's first name differs from nothing in bit 0
    apart = names ^ left
    low = apart & (~apart + apart.dtype.type(1))
    place = np.bitwise_count(low - low.dtype.type(1))
    bit = (names & low) != 0
    return (place * np.uint8(2) + bit).astype(np.uint8)


def phrases(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where phrases start.  first: True where a text starts."""
    joins = np.zeros(len(names), bool)
    joins[1:] = (names[1:] == names[:-1]) & ~first[1:]
    heads = np.flatnonzero(~joins)  # each run counts as one name, so that neighbours differ
    run = np.diff(np.append(heads, len(names))) > 1
    begins = first[heads]
    labels = names[heads]
    for _ in range(3):
        labels = toss(labels, begins)
    left, right = np.full_like(labels, 255), np.full_like(labels, 255)
    left[1:], right[:-1] = labels[:-1], labels[1:]
    left[begins] = 255
    right[:-1][begins[1:]] = 255
    starts = (labels > left) & (labels > right) | begins | run
    starts[1:] |= run[:-1]
    return heads[starts]


def parse(names: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The names of the phrases that start at these places: a sum of each phrase's names, mixed with their places in it."""
    place = np.arange(len(names), dtype=np.int64) - np.repeat(at, np.diff(np.append(at, len(names))))
    return mixed(np.add.reduceat(mixed(names + (place + 1).astype(np.uint64) * MULTIPLY), at))


def sketches(texts: list[str]) -> list[np.ndarray]:
    """For each text the slots of its bands, as 32-bit numbers; EMPTY where no name fell in a slot."""
    out = np.full((len(texts), sum(BANDS)), EMPTY, np.uint32)
    lengths = np.array([len(t) for t in texts], np.int64)
    if not lengths.sum():
        return list(out)
    names = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    first = np.zeros(len(names), bool)
    first[np.cumsum(lengths[lengths > 0]) - lengths[lengths > 0]] = True
    for level in range(1, LEVELS + 1):
        at = phrases(names, first)
        names, owner, first = parse(names, at), owner[at], first[at]
        _fill(out, owner, names, level)
    return list(out)


def _fill(out: np.ndarray, owner: np.ndarray, names: np.ndarray, level: int) -> None:
    """Least value of each slot; levels above the last band go into it."""
    band = min(level, len(BANDS)) - 1
    value = mixed(names + np.uint64(level * int(MULTIPLY) & (1 << 64) - 1))
    slot = ((value >> np.uint64(40)) % np.uint64(BANDS[band])).astype(np.int64) + sum(BANDS[:band])
    np.minimum.at(out, (owner, slot), np.minimum(value.astype(np.uint32), EMPTY - np.uint32(1)))


def as_text(sketch: np.ndarray) -> str:
    return "" if (sketch == EMPTY).all() else sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of slots that agree, of those filled in either, in the highest band that has enough of them."""
    either = (a != EMPTY) | (b != EMPTY)
    if not either.any():
        return 1.0
    end = len(either)
    for size in reversed(BANDS):
        begin = end - size
        if (n := int(either[begin:end].sum())) >= min(ENOUGH, size) or not begin:
            return float((a == b)[begin:end][either[begin:end]].sum() / max(1, n))
        end = begin
    return 0.0


def edited(text: str, following: str) -> str:
    """The last half replaced by as many of the first code points of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def batched(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    held, points = [], 0
    for r in rows:
        held.append(r)
        points += len(r[1]) + 64
        if points >= BATCH_POINTS:
            yield held
            held, points = [], 0
    if held:
        yield held


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint) for each row of docs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batched(r for b in batches for r in zip(b["key"], b["text"], strict=True)):
            yield pd.DataFrame({"key": [k for k, _ in part], "fingerprint": [as_text(s) for s in sketches([t for _, t in part])]})

    rows = docs.select(F.col(key).cast("string").alias("key"), text_or_empty(text).alias("text"))
    return rows.mapInPandas(run, "key string, fingerprint string").select(F.col("key").cast(dict(docs.dtypes)[key]).alias(key), "fingerprint")


OUT = "key string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compared(rows: list[tuple[str, str, str]]) -> pd.DataFrame:
    """rows of (key, text, next text), in which a text is often the next of the row before."""
    texts: dict[str, int] = {}
    at = [[texts.setdefault(t, len(texts)) for t in (own, edited(own, following), following)] for _, own, following in rows]
    order = list(texts)
    sketch = [s for part in batched(("", t) for t in order) for s in sketches([t for _, t in part])]
    shas = [hashlib.sha256(order[e].encode("utf-8", "surrogatepass")).hexdigest() for _, e, _ in at]
    return pd.DataFrame({
        "key": [k for k, _, _ in rows], "n_chars": [len(t) for _, t, _ in rows], "edited_sha256": shas,
        "fingerprint": [as_text(sketch[a]) for a, _, _ in at], "edited_fingerprint": [as_text(sketch[b]) for _, b, _ in at],
        "near_edited": [likeness(sketch[a], sketch[b]) for a, b, _ in at], "near_next": [likeness(sketch[a], sketch[c]) for a, _, c in at],
    })


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row its fingerprint, that of its edited text and the likeness to it and to the next document.  The key is a number.

    Texts are dealt once, by buckets that are ranges of the key; in a sorted bucket each row's next is the row
    after it.  For a bucket's last row the first row of the bucket after it is dealt along: as many rows as
    buckets.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("text")).withColumn("x", F.coalesce(F.col("k").cast("double"), F.lit(float("-inf"))))
    n = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    marks = rows.where("k is not null").agg(F.percentile_approx("x", [i / n for i in range(1, n)], 50 * n)).first()[0] or []
    rows = Bucketizer(splits=[float("-inf"), *sorted({0.0, *(m for m in marks if abs(m) < float("inf"))}), float("inf")], inputCol="x", outputCol="bucket").transform(rows).drop("x")

    heads = rows.groupBy("bucket").agg(F.min(F.coalesce("k", F.lit(0))).alias("least"), F.max(F.col("k").isNull()).alias("null_first"))
    heads = heads.withColumn("least", F.when(~F.col("null_first"), F.col("least"))).drop("null_first")
    in_order = Window.orderBy("bucket")
    heads = heads.withColumn("before", F.coalesce(F.lag("bucket").over(in_order), F.max("bucket").over(Window.partitionBy())))
    texts = rows.select("k", "text").join(F.broadcast(heads.select("least", "before")), F.col("k").eqNullSafe(F.col("least")))  # a row for each bucket
    after = texts.groupBy("before", "k").agg(F.min("text").alias("text")).select(F.col("before").alias("bucket"), F.lit(1).alias("after"), "k", "text")
    dealt = rows.select("bucket", F.lit(0).alias("after"), "k", "text").unionByName(after)
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket").sortWithinPartitions("bucket", "after", F.asc_nulls_first("k"), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pairs() -> Iterator[tuple[str, str, str]]:
            held = None
            for b in batches:
                for bucket, is_after, k, t in zip(b["bucket"], b["after"], b["k"], b["text"], strict=True):
                    if held is not None and held[0] == bucket:
                        yield held[1], held[2], t
                    held = None if is_after else (bucket, k, t)

        for part in batched(pairs()):
            yield compared(part)

    found = dealt.select("bucket", "after", F.col("k").cast("string").alias("k"), "text").mapInPandas(run, OUT)
    return found.select(F.col("key").cast(dict(docs.dtypes)[key]).alias(key), *[c.split()[0] for c in OUT.split(", ")[1:]])
