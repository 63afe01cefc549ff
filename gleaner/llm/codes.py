"""Compressing vectors into part codes, with codebooks learnt over a lexicographic trie of the distinct parts.

Components become whole numbers, floor(scale x component), and each vector is cut into PARTS equal parts.  Distinct parts
of a position, with how often each stands, are dealt by range, so that a task holds neighbours in lexicographic order.
They are the leaves of a trie: a node at depth d is a prefix of d components.  A task descends it depth first and carries,
for the prefix it stands on, the distances from every codebook entry accumulated so far; a child adds one component's
squared differences, so a common prefix is paid for once.  A subtree of up to SUBTREE leaves is finished in one go,
depth by depth.  Leaves take the nearest entry and add their weighted components to its sums.  Only these sums, one row
for each position and entry, reach the driver after a round; the parts stay where they are.

Codes are then assigned to the vectors themselves, batch by batch over the trie of the batch's distinct parts, with the
last codebooks; so no vector is joined to its parts.

Defined results: vectors that are null or hold null or non-finite components are dropped.  Shorter vectors count as
padded with zeros, and all are padded to a multiple of PARTS.  Codebooks start from the rows of the smallest ids, null
ids last, repeats of an id by their vectors; with fewer rows than entries there are as many entries as rows.  Repeated
rows weigh as often as they stand.  Sums and distances are exact while |scale x component| stays under 2^27.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import finite, stash

PARTS, ENTRIES, ROUNDS, SUBTREE = 8, 16, 6, 2048


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of parts, which are distinct and in lexicographic order, the nearest entry (ties to the lower) and its squared distance."""
    best, least = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    width, path = parts.shape[1], [(0, len(parts), 0, np.zeros(len(book), np.int64))] if len(parts) else []
    while path:  # (first leaf, last leaf, depth, distances accumulated over the prefix)
        lo, hi, depth, far = path.pop()
        if hi - lo <= SUBTREE or depth == width:
            leaves = _finished(parts[lo:hi], depth, far, book)
            best[lo:hi] = leaves.argmin(1)
            least[lo:hi] = leaves.min(1)
            continue
        at = parts[lo:hi, depth]
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        children = far + (at[starts, None] - book[None, :, depth]) ** 2
        ends = np.r_[starts[1:], hi - lo]
        path += [(lo + a, lo + b, depth + 1, child) for a, b, child in zip(starts[::-1], ends[::-1], children[::-1], strict=True)]
    return best, least


def _finished(parts: np.ndarray, depth: int, far: np.ndarray, book: np.ndarray) -> np.ndarray:
    """leaves x entries: distances of a whole subtree whose prefix of that depth has the distances far."""
    node, far = np.zeros(len(parts), np.int64), far[None, :]
    for d in range(depth, parts.shape[1]):
        at = parts[:, d]
        first = np.r_[True, (node[1:] != node[:-1]) | (at[1:] != at[:-1])]
        far = far[node[first]] + (at[first, None] - book[None, :, d]) ** 2
        node = np.cumsum(first) - 1
    return far[node]


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def whole(vectors: DataFrame, vector: str, scale: int) -> tuple[DataFrame, int]:
    """vectors that take part, with `v` (their components as whole numbers, padded), and the width of a part; 0 if there are none."""
    x = F.col(vector).cast("array<double>")
    kept = vectors.where(finite(vector))
    longest = kept.agg(F.max(F.size(vector))).first()[0]
    if longest is None:
        return kept.withColumn("v", F.array().cast("array<bigint>")), 0
    width = max(1, -(-longest // PARTS))
    zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(PARTS * width) - F.size(x))
    return kept.withColumn("v", F.concat(F.transform(x, lambda c: F.floor(c * scale)), zeros)), width


def parts_of(rows: DataFrame, width: int) -> DataFrame:
    """(pos, part, weight): the distinct parts of each position, in lexicographic order within and across partitions."""
    cut = F.array(*[F.slice("v", 1 + i * width, width) for i in range(PARTS)])
    counted = rows.select(F.posexplode(cut).alias("pos", "part")).groupBy("pos", "part").agg(F.count("*").alias("weight"))
    return counted.repartitionByRange("pos", "part").sortWithinPartitions("pos", "part")


def first_books(rows: DataFrame, key: str, width: int) -> list[np.ndarray]:
    first = rows.select(key, "v").orderBy(F.col(key).asc_nulls_last(), "v").limit(ENTRIES).collect()
    entries = np.array([r["v"] for r in first], np.int64)
    return [entries[:, i * width : (i + 1) * width].copy() for i in range(PARTS)]


def improved(parts: DataFrame, books: list[np.ndarray], width: int) -> list[np.ndarray]:
    """The codebooks after one round: each entry is the mean of the parts nearest to it, rounded down."""
    size = len(books[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((PARTS, size, width + 1), np.int64)  # the last column counts
        for batch in batches:
            pos, weight = batch["pos"].to_numpy(), batch["weight"].to_numpy()
            every = _matrix(batch["part"], width)
            for p in np.unique(pos):
                here = np.flatnonzero(pos == p)
                entry, _ = nearest(every[here], books[p])
                weighted = np.c_[every[here], np.ones(len(here), np.int64)] * weight[here, None]
                np.add.at(total[p], entry, weighted)
        p, entry = np.nonzero(total[:, :, -1])
        yield pa.RecordBatch.from_pydict({"pos": pa.array(p, pa.int32()), "entry": pa.array(entry, pa.int32()), "sums": pa.array(list(total[p, entry]), pa.list_(pa.int64()))})

    added = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width + 1)]
    books = [b.copy() for b in books]
    for r in parts.mapInArrow(sums, "pos int, entry int, sums array<long>").groupBy("pos", "entry").agg(*added).collect():
        books[r["pos"]][r["entry"]] = [r[f"s{i}"] // r[f"s{width}"] for i in range(width)]
    return books


def learn(rows: DataFrame, key: str, width: int) -> list[np.ndarray]:
    """A codebook (entries x width) for each position after ROUNDS rounds, over all rows."""
    parts, books = stash(parts_of(rows, width), "parts"), first_books(rows, key, width)
    for _ in range(ROUNDS):
        books = improved(parts, books, width)
    return books


def assigned(rows: DataFrame, books: list[np.ndarray], width: int, *kept: str) -> DataFrame:
    """The columns kept, with `code` and `error` of each row."""
    plain = rows.select(*kept, "v")
    hexed = np.array([f"{i:02x}" for i in range(len(books[0]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch["v"], PARTS * width)
            codes, error = np.full(len(v), "", object), np.zeros(len(v), np.int64)
            for p, book in enumerate(books):
                part = v[:, p * width : (p + 1) * width]
                order = np.lexsort(part.T[::-1])
                sorted_ = part[order]
                new = np.r_[True, (sorted_[1:] != sorted_[:-1]).any(1)] if len(v) else np.zeros(0, bool)
                entry, far = nearest(sorted_[new], book)
                leaf = np.empty(len(v), np.int64)
                leaf[order] = np.cumsum(new) - 1
                codes, error = codes + hexed[entry[leaf]].astype(object), error + far[leaf]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in kept], pa.array(codes, pa.string()), pa.array(error, pa.int64())], [*kept, "code", "error"])

    return plain.mapInArrow(run, f"{plain.drop('v').schema.simpleString()[7:-1]}, code string, error long")


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components as decimals, by position, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 4096) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256) for each row that takes part."""
    rows, width = whole(vectors.select(key, vector, label), vector, scale)
    out = [F.col("id").alias(key), "code", "error", "label_error"]
    renamed = rows.select(F.col(key).alias("id"), F.col(label).alias("label"), "v")
    if not width:
        return renamed.select("id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")).select(*out, F.lit(digest([])).alias("codebooks_sha256"))
    books = learn(renamed, "id", width)
    coded = stash(assigned(renamed, books, width, "id", "label"), "codes")
    # a stored table of one row a label: Spark broadcasts it while its size allows, else splits the hot labels of the join
    by_label = stash(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "of")
    return coded.join(by_label, _same("label", "of")).select(*out, F.lit(digest(books)).alias("codebooks_sha256"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _oracle() -> str:
    """The same in SQL, its rounds written out one after the other."""
    steps = [
        """kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, [floor(4096 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
        """parts AS MATERIALIZED (
  SELECT row, p AS pos, v[(p * len(v) // 8 + 1):((p + 1) * len(v) // 8)] AS part FROM kept, range(8) t(p))""",
        "book0 AS MATERIALIZED (SELECT pos, row - 1 AS entry, part AS mean FROM parts WHERE row <= 16)",
    ]
    near = """near{n} AS MATERIALIZED (
  SELECT row, pos, any_value(part) AS part, min_by(entry, far * 16 + entry) AS entry, min(far) AS far
  FROM (SELECT row, parts.pos AS pos, part, entry, list_sum([(x - mean[i]) * (x - mean[i]) FOR x, i IN part])::BIGINT AS far FROM parts JOIN book{n} b ON parts.pos = b.pos)
  GROUP BY row, pos)"""
    for n in range(ROUNDS):
        steps += [
            near.format(n=n),
            f"""sums{n} AS (
  SELECT pos, entry, i, floor(sum(part[i])::HUGEINT / count(*))::BIGINT AS x FROM near{n}, range(1, 9999) t(i) WHERE i <= len(part) GROUP BY pos, entry, i)""",
            f"""means{n} AS (SELECT pos, entry, list(x ORDER BY i) AS mean FROM sums{n} GROUP BY pos, entry)""",
            f"""book{n + 1} AS MATERIALIZED (SELECT b.pos, b.entry, coalesce(m.mean, b.mean) AS mean FROM book{n} b LEFT JOIN means{n} m ON b.pos = m.pos AND b.entry = m.entry)""",
        ]
    steps += [
        near.format(n=ROUNDS),
        f"coded AS (SELECT row, string_agg(printf('%02x', entry), '' ORDER BY pos) AS code, sum(far)::BIGINT AS error FROM near{ROUNDS} GROUP BY row)",
        f"digest AS (SELECT sha256(string_agg(array_to_string(mean, ','), ',' ORDER BY pos, entry)) AS codebooks_sha256 FROM book{ROUNDS})",
        "told AS (SELECT vec_id, label, code, error FROM coded JOIN kept USING (row))",
    ]
    return f"WITH {', '.join(steps)}\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM told, digest"


ORACLE = _oracle()
