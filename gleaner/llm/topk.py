"""Exact top-k search by integer inner product, with block-at-a-time pruning.

Candidates are laid out in blocks of similar vectors (by their largest components) and blocks in shards.  Each
block has a forward index (its vectors) and for each dimension its least and greatest value.  A query's bound
on a block is the sum over dimensions of the larger product; blocks are scored in falling order of their
bounds until no bound reaches the query's k-th score so far (a bound equal to it is scored: ties go to smaller
ids).  Queries start from the k-th score they reach in their own shard, so most pruning is known before any
other vector is read.

Queries come in blocks too.  A query block meets a shard as one row of a join; pairs of a query block and a
shard that cannot matter, by the least and greatest of both, are dropped before the join ships any vectors.

How much is pruned depends on the vectors.  Where they lie in groups most blocks are skipped; on vectors without any
order in many dimensions (the test tables') no layout of blocks prunes, and nearly all pairs are scored: see README.  The best k of each pair are
merged per query with a window that keeps k rows per task.

Defined results: vectors that are null or hold null or non-finite components take no part; shorter vectors
count as padded with zeros; ids are compared as numbers, a row never answers the query of its own row but rows
that repeat an id answer each other; null ids take no part.  Scores are exact while |components| < 2^22 after scaling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import stash

BLOCK, SHARD, QUERIES = 64, 4096, 256


def quantised(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, v array<long>): floor(scale x component); only vectors that take part."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    fit = "id is not null and x is not null and size(x) > 0 and forall(x, c -> c is not null and not isnan(c) and abs(c) < double('Infinity'))"
    return rows.where(fit).select("id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def matrix(lists: list, width: int) -> np.ndarray:
    if all(len(v) == width for v in lists):
        return np.stack([np.asarray(v, np.float64) for v in lists]) if lists else np.zeros((0, width))
    out = np.zeros((len(lists), width))
    for i, v in enumerate(lists):
        out[i, : len(v)] = v
    return out


def bounds(queries: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """queries x blocks: no vector of the block can score more."""
    return np.maximum(queries, 0) @ most.T + np.minimum(queries, 0) @ least.T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by (score descending, id ascending)."""
    if len(scores) > k:
        kth = -np.partition(-scores, k - 1)[k - 1]
        at = np.flatnonzero(scores >= kth)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


class Shard:
    """Blocks of candidates, with the ids and row numbers of their vectors."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.rows, self.vectors = ids, rows, vectors
        starts = np.arange(0, len(ids), BLOCK)
        self.least, self.most = np.minimum.reduceat(vectors, starts), np.maximum.reduceat(vectors, starts)

    def reached(self, queries: np.ndarray, floors: np.ndarray) -> float:
        """Share of (query, block) pairs whose bound reaches the query's floor, so which must be scored."""
        return float((bounds(queries, self.least, self.most) >= floors[:, None]).mean())

    def search(self, queries: np.ndarray, rows: np.ndarray, floors: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query its best (ids, scores) here, as far as they reach floors."""
        limit = bounds(queries, self.least, self.most)
        kept = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        floors = floors.copy()
        for b in np.argsort(-limit.max(0), kind="stable"):
            active = np.flatnonzero(limit[:, b] >= floors)
            if not len(active):
                continue
            part = slice(b * BLOCK, (b + 1) * BLOCK)
            scores = queries[active] @ self.vectors[part].T
            scores[rows[active][:, None] == self.rows[part][None, :]] = -np.inf  # the query's own row
            reached = (scores >= floors[active][:, None]) & (scores > -np.inf)
            for i in np.flatnonzero(reached.any(1)):
                q, s, hit = active[i], scores[i], np.flatnonzero(reached[i])
                if len(hit):
                    ids, all_scores = np.concatenate([kept[q][0], self.ids[part][hit]]), np.concatenate([kept[q][1], s[hit]])
                    top = best(all_scores, ids, k)
                    kept[q] = ids[top], all_scores[top]
                    if len(top) == k:
                        floors[q] = max(floors[q], all_scores[top[-1]])
        return kept


def _packed(rows: DataFrame, group: str, width: int) -> DataFrame:
    """One row for each group: ids, row numbers and vectors as bytes, and the least and greatest of each dimension.  Groups are bounded by the caller."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["place", "id", "row"])
        v = matrix(list(pdf["v"]), width)
        return pd.DataFrame({"group": [pdf["group"].iloc[0]], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "rows": [pdf["row"].to_numpy(np.int64).tobytes()], "vectors": [v.astype(np.int32).tobytes()], "least": [v.min(0).tobytes()], "most": [v.max(0).tobytes()]})

    return rows.select(F.col(group).alias("group"), "place", "id", "row", "v").groupBy("group").applyInPandas(pack, "group long, ids binary, rows binary, vectors binary, least binary, most binary")


def _read(raw: bytes, kind: type, width: int = 0) -> np.ndarray:
    out = np.frombuffer(raw, kind)
    return out.reshape(-1, width) if width else out


def numbered(rows: DataFrame) -> DataFrame:
    """rows with `nth`, counting up from 0 in order of (place, id, row), without sorting in one task.

    Places and salts make 16,384 cells at most; each is numbered after those before it by a prefix sum over the
    cells' counts.  The salt splits the rows of a place, so that no place is one task's work.
    """
    cells = rows.groupBy("place", "salt").agg(F.count("*").alias("n"))
    before = cells.withColumn("base", F.sum("n").over(Window.orderBy("place", "salt")) - F.col("n")).drop("n")
    within = Window.partitionBy("place", "salt").orderBy("id", "row")
    return rows.withColumn("at", F.row_number().over(within) - 1).join(before, ["place", "salt"]).withColumn("nth", F.col("base") + F.col("at")).drop("base", "at", "salt")


def search(vectors: DataFrame, is_query: str, k: int, key: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best for every row of vectors for which the SQL condition is_query on `id` holds."""
    rows = quantised(vectors, key, vector, scale).withColumn("row", F.monotonically_increasing_id())
    # cells of similar vectors: where the largest and about where the least component is; salted so that no cell is large
    first, second = F.array_position("v", F.array_max("v")), F.array_position("v", F.array_min("v"))
    rows = stash(rows.withColumn("place", (F.pmod(first, F.lit(64)) * 8 + F.pmod(F.floor(second / 8), F.lit(8))).cast("long")).withColumn("salt", F.pmod(F.xxhash64("id", "row"), F.lit(32))), "vectors")
    stats = rows.agg(F.max(F.size("v")).alias("width"), F.count("*").alias("n")).first()
    if not stats["n"]:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = stats["width"]
    placed = stash(numbered(rows), "placed")
    shards = stash(_packed(placed.withColumn("shard", F.floor(F.col("nth") / SHARD)), "shard", width), "shards")
    asked = placed.where(is_query)
    asked = asked.withColumn("home", F.floor(F.col("nth") / SHARD))
    # consecutive places share a query block, and so do their homes; a block has about QUERIES of every stride rows
    share = max(1, round(stats["n"] / max(1, asked.count())))
    queries = stash(_packed(asked.withColumn("block", F.floor(F.col("nth") / (QUERIES * share))), "block", width), "queries")

    def unpack(r, prefix: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _read(r[f"{prefix}ids"], np.int64), _read(r[f"{prefix}rows"], np.int64), _read(r[f"{prefix}vectors"], np.int32, width).astype(np.float64)

    def at_home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.to_dict("records"):
                _, q_rows, q = unpack(r, "q_")
                found = Shard(*unpack(r, "")).search(q, q_rows, np.full(len(q), -np.inf), k)
                own = np.array([s[-1] if len(s) == k else -np.inf for _, s in found])
                yield pd.DataFrame({"block": [r["block"]], "floors": [own.tobytes()], "floor": [own.min()]})

    q = queries.select(F.col("group").alias("block"), F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"), F.col("vectors").alias("q_vectors"))
    home = (F.col("block") * (QUERIES * share) / SHARD).cast("long")
    floors = stash(q.withColumn("group", home).join(shards, "group").mapInPandas(at_home, "block long, floors binary, floor double"), "floors")

    # pairs of a query block and a shard, told from the least and greatest of both, before any vector moves
    n_shards = -(-stats["n"] // SHARD)
    edges = queries.select(F.col("group").alias("block"), F.col("least").alias("q_least"), F.col("most").alias("q_most")).join(floors, "block")
    pairs = edges.select("block", "q_least", "q_most", "floor").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)).cast("array<bigint>")))

    def can_matter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            corners = [[np.frombuffer(x, np.float64) for x in b[c]] for c in ("q_least", "q_most", "least", "most")]
            limit = [np.maximum.reduce([ql * l, ql * m, qm * l, qm * m]).sum() for ql, qm, l, m in zip(*corners, strict=True)]
            yield b.loc[np.array(limit, np.float64) >= b["floor"].to_numpy(), ["block", "group"]]

    pairs = stash(pairs.join(shards.select("group", "least", "most"), "group").mapInPandas(can_matter, "block long, group long"), "pairs")

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.to_dict("records"):
                q_ids, q_rows, q_vectors = unpack(r, "q_")
                found = Shard(*unpack(r, "")).search(q_vectors, q_rows, _read(r["floors"], np.float64), k)
                n = [len(s) for _, s in found]
                yield pd.DataFrame({"query_id": np.repeat(q_ids, n), "query_row": np.repeat(q_rows, n), "vec_id": np.concatenate([i for i, _ in found]), "score": np.concatenate([s for _, s in found]).astype(np.int64)})

    met = pairs.join(q, "block").join(floors.drop("floor"), "block").join(shards.select("group", "ids", "rows", "vectors"), "group").mapInPandas(meet, "query_id long, query_row long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
