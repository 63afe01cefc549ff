"""Hard negatives: for each anchor and positive the best rows of other labels whose score lies in a window under the positive's.

All windows of an anchor overlap, so they are not answered one by one.  The positives' scores are the windows' upper
limits; they split the scores into disjoint slots, slot j from just over limit j + 1 up to limit j.  A task scores a block
of anchors against a block of rows and keeps, for each anchor and slot, the best k (the combiner); the best of each slot
over all tasks follow by rank.  A descending merge over the slots of an anchor then gives each limit's answer: the best k
of slot j and of the answer of limit j + 1.  As a window's rows are the best under its upper limit that also reach its
lower one, the lower limit is applied last.

Anchors and rows meet in cells: anchors are dealt into groups and rows into chunks of bounded size by hash, and each group
meets each chunk in one cell.  Anchors seek positives in chunks of their own label's bucket only.  A hot label or one that
all rows share gives more chunks, never a larger one; the work is anchors times rows, as the result is exact.

Defined results: rows with a null id, a null label, a null vector or null or non-finite components take no part.  Shorter
vectors count as padded with zeros.  A row is never its own positive; rows that repeat an id count each for itself, and
each anchor row gives rows of its own.  Windows under a negative limit are empty.  Ties in score go to the smaller id.
Scores are exact while they fit 64 bits.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import finite, stash

#: Most rows of a chunk and most anchors of a group, about; anchors scored at a time.
CHUNK, GROUP, AT_ONCE = 4096, 4096, 256


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of whole numbers: by floating point where that is exact, else by 64-bit integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def best(scores: np.ndarray, ids: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the places at the k best by (score descending, id ascending)."""
    if len(at) > k:
        kth = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= kth]
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _whole(vectors: DataFrame, key: str, vector: str, label: str, is_anchor: Column, scale: int) -> tuple[DataFrame, int]:
    """(row, id, label, v, anchor): rows that take part, v padded to one width."""
    x = F.col(vector).cast("array<double>")
    told = vectors.where(finite(vector) & F.col(key).isNotNull() & F.col(label).isNotNull())
    rows = told.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.transform(x, lambda c: F.floor(c * scale)).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = stash(rows.withColumn("row", F.monotonically_increasing_id()), "whole")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    padded = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("v")))
    return rows.withColumn("v", padded), width


def _dealt(rows: DataFrame, buckets: Column, most: int, into: str) -> tuple[DataFrame, DataFrame]:
    """rows with `bucket` and `into` (a number under `parts`, drawn by the row's hash), and (bucket, parts): about `most` rows a part."""
    rows = rows.withColumn("bucket", buckets)
    parts = stash(rows.groupBy("bucket").agg(F.ceil(F.count("*") / most).alias("parts")), "buckets")
    drawn = F.pmod(F.xxhash64("row", F.lit(into)), "parts")
    return rows.join(parts, "bucket").withColumn(into, drawn).drop("parts"), parts


def _cells(anchors: DataFrame, rows: DataFrame, buckets: Column, scored, schema: str) -> DataFrame:
    """What scored(anchors, rows) gives for each pair of an anchor group and a row chunk of the same bucket."""
    anchors = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])  # both sides come from one frame: columns of their own
    a, groups = _dealt(anchors, buckets, GROUP, "group")
    r, chunks = _dealt(rows, buckets, CHUNK, "chunk")
    count_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = a.join(chunks, "bucket").withColumn("chunk", count_to("parts")).drop("parts")
    r = r.join(groups, "bucket").withColumn("group", count_to("parts")).drop("parts")
    cell = ["bucket", "group", "chunk"]
    return a.groupBy(*cell).cogroup(r.groupBy(*cell)).applyInArrow(scored, schema)


def _vectors(t: pa.Table, width: int) -> np.ndarray:
    return t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _same_label(anchors: pa.Table, rows: pa.Table, width: int, k: int) -> pa.Table:
    """(row, anchor_id, id, score): the k best others of each anchor's label in this chunk."""
    ids, of, label = (rows[c].to_numpy() for c in ("id", "row", "label"))
    a_ids, a_of, a_label = (anchors[c].to_numpy() for c in ("id", "row", "label"))
    a, v, out = _vectors(anchors, width), _vectors(rows, width), []
    for lo in range(0, len(a), AT_ONCE):
        for i, scores in enumerate(product(a[lo : lo + AT_ONCE], v), lo):
            at = best(scores, ids, np.flatnonzero((label == a_label[i]) & (of != a_of[i])), k)
            out.append((np.full(len(at), i), ids[at], scores[at]))
    at, found, scores = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
    return pa.table({"row": a_of[at], "anchor_id": a_ids[at], "id": found, "score": scores})


def _by_slot(anchors: pa.Table, rows: pa.Table, width: int, k: int, share: tuple[int, int]) -> pa.Table:
    """(row, slot, id, score): the k best rows of other labels in this chunk for each slot of each anchor."""
    ids, label, v = rows["id"].to_numpy(), rows["label"].to_numpy(), _vectors(rows, width)
    a_of, a_label, a = anchors["row"].to_numpy(), anchors["label"].to_numpy(), _vectors(anchors, width)
    limits, out = anchors["limits"].to_pylist(), []
    for lo in range(0, len(a), AT_ONCE):
        for i, scores in enumerate(product(a[lo : lo + AT_ONCE], v), lo):
            rising = np.array(limits[i][::-1], np.int64)  # rising[0] is the last slot's limit
            lowest = -(-share[0] * int(rising[0]) // share[1])  # under every window
            at = np.flatnonzero((label != a_label[i]) & (scores <= rising[-1]) & (scores >= lowest))
            slot = len(rising) - 1 - np.searchsorted(rising, scores[at])
            for s in np.unique(slot):
                top = best(scores, ids, at[slot == s], k)
                out.append((np.full(len(top), a_of[i]), np.full(len(top), s), ids[top], scores[top]))
    of, slot, found, scores = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4
    return pa.table({"row": of, "slot": slot.astype(np.int32), "id": found, "score": scores})


def _top(found: DataFrame, k: int, *per: str) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*per).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def windows(slots: Column, positives: Column, k: int, share: tuple[int, int]) -> Column:
    """For each positive the best k of its slot and all under it that reach its lower limit.

    slots: array of (slot, rank, id, score) with up to k of each slot; positives: array of (limit, id), limits falling.
    """
    one = lambda j: F.array_sort(F.filter(slots, lambda e: e["slot"] == j), lambda x, y: x["rank"] - y["rank"])
    falling = F.reverse(F.sequence(F.lit(0), F.size(positives) - 1))
    # answers are put before those of the lower limits, so that the one at hand is the first
    merged = F.aggregate(falling, F.array(F.slice(slots, 1, 0)), lambda done, j: F.concat(F.array(F.slice(F.concat(one(j), F.get(done, F.lit(0))), 1, k)), done))
    reached = lambda answer, p: F.filter(answer, lambda e: F.lit(share[1]) * e["score"] >= F.lit(share[0]) * p["limit"])
    return F.transform(positives, lambda p, j: F.struct(p["id"].alias("positive_id"), p["limit"].alias("positive_score"), reached(F.get(merged, j), p).alias("found")))


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100), key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each positive of each anchor its hardest negatives.

    share[0] * positive_score <= share[1] * negative_score <= share[1] * positive_score holds for each.
    """
    rows, width = _whole(vectors.select(key, label, vector), key, vector, label, is_anchor, scale)
    anchors, plain = rows.where("anchor").drop("anchor"), rows.drop("anchor")
    by_label = F.pmod(F.xxhash64("label"), F.lit(1 << 20))
    near = _cells(anchors, plain, by_label, partial(_same_label, width=width, k=positives), "row long, anchor_id long, id long, score long")
    falling = F.array_sort(F.collect_list(F.struct("rank", F.col("score").alias("limit"), "id")))
    asked = stash(_top(near, positives, "row").groupBy("row", "anchor_id").agg(falling.alias("every")), "positives")
    asked = asked.withColumn("every", F.filter("every", lambda p: p["limit"] >= 0)).where(F.size("every") > 0)  # under a negative limit nothing fits
    limited = anchors.join(asked.select("row", F.col("every.limit").alias("limits")), "row")
    slots = _cells(limited, plain, F.lit(0), partial(_by_slot, width=width, k=negatives, share=share), "row long, slot int, id long, score long")
    told = _top(slots, negatives, "row", "slot").groupBy("row").agg(F.collect_list(F.struct("slot", "rank", "id", "score")).alias("slots"))
    each = told.join(asked, "row").select("anchor_id", F.explode(windows(F.col("slots"), F.col("every"), negatives, share)).alias("p"))
    out = each.select("anchor_id", "p.positive_id", "p.positive_score", F.posexplode("p.found").alias("at", "n"))
    return out.select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", F.col("n.score").alias("negative_score"))


ORACLE = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id))::INT AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) <= 5
"""
