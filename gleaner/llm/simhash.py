"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints at distance 3 or less meet at a variant that is at most 1 bit from one of them and at
most 2 bits from the other.  So every distinct fingerprint emits all variants within half the radius, the
variants are shuffled, and fingerprints that meet at one are linked.  Two facts halve the larger ball twice:
of 3 differing bits two are in one 32-bit half (992 masks instead of 2016), and one of the two fingerprints
has an even number of ones (only even ones emit two-bit variants).  No fewer two-bit masks would do.

That is 561 variants a fingerprint on average, so they travel packed: a row holds the variants of a batch that
fall in one bucket, 10 bytes each (the variant and the number of its mask, from which the fingerprint follows).
Buckets are ranges of a hash of the variant, as many as keep each at about BUCKET variants, whatever the table's
size; a bucket is sorted by variant, so equal variants stand together.

All members of a group of equal variants lie within 1 or 2 bits of it, so a group has at most 2081 members.  A
group gives a star, not all of its pairs: the least inner member links to every other member, which loses no
component, as inner and outer members are within 1 + 2 bits.  Every link is verified by its true distance.

Defined results: null and empty texts have fingerprint zero, linked like any other; repeated rows each give a
row; documents with a null key count in groups but never name one (component null if no other member).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import small_batches, stash, unstash
from gleaner.llm.components import components

RADIUS = 3
HALVES = 32
#: Variants in a bucket, about, and fingerprints whose variants are made at a time.
BUCKET, FEW = 1 << 20, 4096
#: Buckets that one task sorts, one after the other.
TOGETHER = 8
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def ball(bits: int, radius: int) -> list[int]:
    """The masks of up to `radius` of so many bits, fewest bits first."""
    return [sum(1 << b for b in chosen) for n in range(radius + 1) for chosen in combinations(range(bits), n)]


#: What all fingerprints emit (one bit at most), then what even ones add (two bits of one half).
_INNER = ball(64, 1)
_OUTER = [one << side for side in (0, HALVES) for one in ball(HALVES, 2)[1 + HALVES :]]
MASKS = np.array(_INNER + _OUTER, np.uint64)


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, width: int) -> int:
    """SimHash of the word shingles of a text, as an unsigned number; ASCII letters lower-cased, ASCII white space between words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    stops = (ends - 1)[min(width, len(words)) - 1 :].tolist()
    starts = [0, *ends[: len(stops) - 1].tolist()]
    return majority(np.fromiter((xxhash.xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, len(stops)))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(key, fp long) for each row; fp holds the 64 bits as a signed number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "fp": np.array([fingerprint(t, width) for t in b["text"]], np.uint64).view(np.int64)})

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"))
    kind = dict(docs.dtypes)[key]
    return rows.mapInPandas(run, "key string, fp long").select(F.col("key").cast(kind).alias("key"), "fp")


def variants(fps: DataFrame, buckets: int) -> DataFrame:
    """(bucket, variants, masks): all variants of all fingerprints, packed for each batch and bucket; see the module."""
    inner = len(_INNER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = b.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(every), FEW):
                some = every[i : i + FEW]
                even = some[np.bitwise_count(some) % 2 == 0]
                made = np.concatenate([(some[:, None] ^ MASKS[None, :inner]).ravel(), (even[:, None] ^ MASKS[None, inner:]).ravel()])
                mask = np.concatenate([np.tile(np.arange(inner, dtype=np.int16), len(some)), np.tile(np.arange(inner, len(MASKS), dtype=np.int16), len(even))])
                to = (((made * _SPREAD) >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
                order = np.argsort(to, kind="stable")
                made, mask, to = made[order], mask[order], to[order]
                first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
                stops = np.append(first[1:], len(to))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(to[first].astype(np.int64)),
                        pa.array([made[a:e].tobytes() for a, e in zip(first, stops, strict=True)], pa.binary()),
                        pa.array([mask[a:e].tobytes() for a, e in zip(first, stops, strict=True)], pa.binary()),
                    ],
                    ["bucket", "variants", "masks"],
                )

    return fps.select("fp").mapInArrow(run, "bucket long, variants binary, masks binary")


def met(variants_: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified star links (u, v) between the fingerprints that share a variant."""
    order = np.argsort(variants_)
    at = variants_[order]
    same = at[1:] == at[:-1]
    shared = np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))
    if not len(shared):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, at = order[shared], at[shared]
    fp, inner = (at ^ MASKS[masks[order]]).view(np.int64), masks[order] < len(_INNER)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    sizes = np.diff(np.append(first, len(at)))
    least = np.minimum.reduceat(np.where(inner, fp, np.iinfo(np.int64).max), first)
    u = np.repeat(least, sizes)
    fit = np.repeat(np.logical_or.reduceat(inner, first), sizes) & (u != fp) & (np.bitwise_count((u ^ fp).view(np.uint64)) <= RADIUS)
    return u[fit], fp[fit]


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Verified star edges (u, v) between distinct fingerprints within 3 bits; their components are those of all such pairs."""
    buckets = max(1, ceil(fps.count() * (len(_INNER) + len(_OUTER) / 2) / bucket))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = met(np.frombuffer(b"".join(pdf["variants"]), np.uint64), np.frombuffer(b"".join(pdf["masks"]), np.int16))
        return pd.DataFrame({"u": u, "v": v}).drop_duplicates()

    # a task gets about TOGETHER buckets, whatever the session's number of shuffle partitions
    dealt = variants(fps, buckets).repartition(ceil(buckets / TOGETHER), "bucket")
    return dealt.groupBy("bucket").applyInPandas(meet, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(key, fp, component): component is the smallest key among the documents reachable over links of 3 bits or less."""
    marked = stash(fingerprints(docs, key, text, width), "fingerprints")
    classes = stash(marked.groupBy("fp").agg(F.min("key").alias("least")), "classes")
    roots = components(links(classes))
    named = classes.join(roots.withColumnRenamed("u", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    found = stash(named.join(least, "root").select("fp", "component"), "named")
    unstash(classes, roots)
    return marked.join(found, "fp").select(F.col("key").alias(key), "fp", "component")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """docs with one document of each component, that of the smallest key.  Rows with a null key stay, as do repeats of a kept key."""
    found = near_duplicates(docs, key, text, width).where(F.col(key) == F.col("component")).select(F.col(key).alias("kept_key")).distinct()
    rows = docs.where(F.col(key).isNotNull())
    return rows.join(found, rows[key] == found["kept_key"], "left_semi").unionByName(docs.where(F.col(key).isNull()))


def hex16(column: str) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))
