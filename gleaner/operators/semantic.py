"""Semantic duplicates: embeddings, blocked vector joins, contradictions between orders."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.operators.dedup import completeness, normalize_contacts
from gleaner.settings import DEFAULT, Settings
from gleaner.sources.scratch import dropped, stored

#: Words of performers and spam that bar a semantic merge.
NEGATIVE_MARKERS = r"(?U)\b(выполню|портфолио|резюме|ищу работу|казино|ставки)\b"

#: Vectors of a block that are scored against as many others at a time.
CHUNK = 1024
#: Most tasks that pairs of chunks are dealt to, one pair each until then.
MOST_TASKS = 20_000


def _tasks(cells: int | None) -> int:
    return max(1, min(cells or 0, MOST_TASKS))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for a zero vector."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def hash_embedding(tokens: Column, dimension: int) -> Column:
    """Signed counts of hashed tokens, of unit length; a text without tokens has the zero vector.  Native: no Python."""
    slot = lambda t: F.pmod(F.conv(F.substring(F.sha2(t.cast("binary"), 256), 1, 8), 16, 10).cast("long"), F.lit(dimension).cast("long")).cast("int")
    sign = lambda t: F.when(F.conv(F.substring(F.sha2(t.cast("binary"), 256), 10, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    placed = F.transform(tokens, lambda t: F.struct(slot(t).alias("slot"), sign(t).alias("sign")))
    total = lambda all_, i: F.aggregate(F.filter(all_, lambda p: p["slot"] == i), F.lit(0.0), lambda s, p: s + p["sign"])
    # slots are summed by ranges, so that a long text is not read once for each slot
    step = math.isqrt(dimension - 1) + 1
    ranges = F.sequence(F.lit(0), F.lit(dimension - 1), F.lit(step))
    part = lambda all_, g: F.array(F.filter(all_, lambda p: (p["slot"] >= g) & (p["slot"] < g + step)))
    sums = lambda all_, g: F.transform(part(all_, g), lambda few: F.transform(F.sequence(g, F.least(g + step, F.lit(dimension)) - 1), lambda i: total(few, i)))[0]
    # one-element arrays bind what stands before, so that it is computed once
    raw = F.transform(F.array(placed), lambda all_: F.flatten(F.transform(ranges, lambda g: sums(all_, g))))
    return F.transform(raw, lambda v: F.transform(F.array(F.nullif(F.sqrt(dot(v, v)), F.lit(0.0))), lambda norm: F.transform(v, lambda x: F.coalesce(x / norm, x)))[0])[0]


def order_embedding_text(compose: bool = True) -> Column:
    parts = [F.nullif(F.col(c), F.lit("")) for c in ("project_type", "title", "summary", "deadline_text")]
    return text.mask_pii(F.concat_ws(" ", *parts), compose)


def hashed_vectors(rows: DataFrame, key: str, tokens: str, dimension: int) -> DataFrame:
    """(key, vector): what hash_embedding gives for the array column tokens, for texts of any length; rows without tokens are left out.

    A batch's distinct tokens are hashed once, and all tokens are counted by (row, slot) at once; no row leaves its task.
    """

    def hashed(token: str) -> tuple[int, float]:
        h = hashlib.sha256(token.encode("utf-8", "surrogatepass")).hexdigest()
        return int(h[:8], 16) % dimension, 1.0 if int(h[9], 16) % 2 == 0 else -1.0  # the tenth digit is even for one of two

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(at, CHUNK)
                lists = batch.column(1)
                n, sizes = len(lists), np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                words = lists.flatten().dictionary_encode()
                told = np.array([hashed(w) for w in words.dictionary.to_pylist()]).reshape(-1, 2)[words.indices.to_numpy(zero_copy_only=False)]
                places = np.repeat(np.arange(n), sizes) * dimension + told[:, 0].astype(np.int64)
                sums = np.bincount(places, told[:, 1], n * dimension).reshape(n, dimension)
                norm = np.sqrt((sums * sums).sum(axis=1))
                vectors = (sums / np.where(norm > 0, norm, 1.0)[:, None])[sizes > 0]
                offsets = pa.array(np.arange(len(vectors) + 1) * dimension, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(sizes > 0)), pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))], [key, "vector"])

    kind = f"`{key}` {dict(rows.dtypes)[key]}, vector array<double>"
    return rows.select(key, F.filter(tokens, lambda t: t.isNotNull()).alias("tokens")).mapInArrow(run, kind)


def embed_orders(orders: DataFrame, embed: Callable[[pd.Series], pd.Series] | None = None, dimension: int = 384) -> DataFrame:
    """Fill null embeddings; embed maps texts to vectors, batch by batch (default: hashed tokens).  A vector of another length gives null.

    By default the orders are stored once with a number for each row, as their vectors are made apart and joined to them.
    """
    if embed is not None:
        made = F.pandas_udf(embed, "array<float>")(order_embedding_text()).cast("array<float>")
        return orders.withColumn("embedding", F.coalesce("embedding", F.get(F.filter(F.array(made), lambda v: F.size(v) == dimension), F.lit(0))))
    rows = stored(orders.withColumn("__row", F.monotonically_increasing_id()), "orders")
    words = rows.where("embedding is null").select("__row", text.semantic_tokens(order_embedding_text()).alias("tokens"))
    made = hashed_vectors(words, "__row", "tokens", dimension).select("__row", F.col("vector").cast("array<float>").alias("__v"))
    zero = F.array_repeat(F.lit(0.0), dimension).cast("array<float>")
    return rows.join(made, "__row", "left").withColumn("embedding", F.coalesce("embedding", "__v", zero)).select(*orders.columns)


def backfill_counts(orders: DataFrame, dimension: int = 384) -> DataFrame:
    """One row of what embed_orders would do, before it does: (scanned, to_embed, without_tokens, kept, misfit).

    misfit counts vectors of another length, which are kept as they are.
    """
    missing = F.col("embedding").isNull()
    empty = F.size(text.semantic_tokens(order_embedding_text())) == 0
    count = lambda test, name: F.count_if(test).alias(name)
    return orders.agg(F.count("*").alias("scanned"), count(missing, "to_embed"), count(missing & empty, "without_tokens"), count(~missing, "kept"), count(~missing & (F.size("embedding") != dimension), "misfit"))


def embedding_backlog(orders: DataFrame, batch: int | None = None) -> DataFrame:
    """Canonical orders without an embedding, newest first; all of them, or a batch."""
    canonical = F.col("canonical_order_id").isNull() | (F.col("canonical_order_id") == F.col("order_id"))
    out = orders.where(F.col("embedding").isNull() & canonical).orderBy(F.desc("published_at"), "order_id")
    return out if batch is None else out.limit(batch)


def parse_vector(value: Column) -> Column:
    inner = F.regexp_replace(F.trim(value), r"^\[+|\]+$", "")
    return F.when(inner == "", F.array().cast("array<float>")).otherwise(F.split(inner, ",").cast("array<float>"))


def vector_literal(vector: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: F.format_string("%.8f", x.cast("double"))), ","), F.lit("]"))


def representative_budget(low: Column, high: Column) -> Column:
    """The mean of both ends, or the one that is there; a single zero counts as missing."""
    zero = F.lit(0).cast("decimal(14,2)")
    return F.when(low.isNotNull() & high.isNotNull(), (low + high) / 2).otherwise(F.coalesce(F.nullif(low, zero), F.nullif(high, zero)))


def contradiction(a: str, b: str) -> Column:
    """Whether orders under the prefixes a and b cannot be the same: type, contacts, budget over 35 % apart, deadlines over 30 days apart, or performer's words."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    differs = lambda c: (F.length(x(c)) > 0) & (F.length(y(c)) > 0) & (x(c) != y(c))
    entries = lambda c: F.array_sort(F.map_entries(normalize_contacts(c)))
    people = (F.size(x("contacts")) > 0) & (F.size(y("contacts")) > 0) & (entries(x("contacts")) != entries(y("contacts")))
    left, right = representative_budget(x("budget_from"), x("budget_to")), representative_budget(y("budget_from"), y("budget_to"))
    larger = F.greatest(left, right)
    money = (larger != 0) & ((larger - F.least(left, right)) / F.nullif(larger, F.lit(0).cast("decimal(14,2)")) > 0.35) & left.isNotNull() & right.isNotNull()
    days = F.abs(F.datediff(x("deadline"), y("deadline"))) > 30
    words = lambda s: F.lower(F.concat_ws(" ", F.coalesce(s("title"), F.lit("")), F.coalesce(s("summary"), F.lit("")))).rlike(NEGATIVE_MARKERS)
    tests = [differs("project_type"), people, differs("budget_currency"), money, days, words(x), words(y)]
    out = F.lit(False)
    for t in tests:
        out = out | F.coalesce(t, F.lit(False))
    return out


def _compared(key: str, least: float | None, most: int | None) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """Scores one chunk against another; sums run in the order of `dot`, so equal vectors have equal scores in any chunk."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({key: a["__key"][:0], "other": a["__key"][:0], "similarity": np.zeros(0)})]
        if len(a) and len(b):
            b = b.sort_values("__key", kind="stable")  # among equal scores the least key comes first
            w, norms, others = np.stack(b["__v"]).T.copy(), b["__norm"].to_numpy(), b["__key"].to_numpy()
            for at in range(0, len(a), 64):
                part = a.iloc[at : at + 64]
                v, keys = np.stack(part["__v"]), part["__key"].to_numpy()
                scores = np.zeros((len(part), len(b)))
                for i in range(w.shape[0]):
                    scores += v[:, i, None] * w[i]
                scores /= part["__norm"].to_numpy()[:, None] * norms
                scores[(keys[:, None] == others) | ~(scores >= (-np.inf if least is None else least))] = -np.inf
                columns = np.argsort(-scores, axis=1, kind="stable")[:, :most] if most else np.broadcast_to(np.arange(len(b)), scores.shape)
                rows = np.broadcast_to(np.arange(len(part))[:, None], columns.shape)
                fits = scores[rows, columns] > -np.inf
                rows, columns = rows[fits], columns[fits]
                found.append(pd.DataFrame({key: keys[rows], "other": others[columns], "similarity": scores[rows, columns]}))
        return pd.concat(found[1:] or found)

    return run


def similar_pairs(vectors: DataFrame, key: str, vector: str, block: str, least: float | None = None, most: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """(key, other, similarity): pairs within a block, optionally of at least a similarity, or the `most` nearest of each.

    A block is an equality key (say type and week); nothing is compared across blocks.  A block is dealt into chunks of
    about `chunk` vectors, and a task scores two chunks at a time, so a hot block is no one task's work; of `most` only
    so many candidates leave a pair of chunks.  Rows with a null key or block take no part, nor do vectors that are null,
    zero or hold null or non-finite components; vectors of different lengths are not compared.
    """
    kind = dict(vectors.dtypes)[key]
    rows = vectors.select(F.col(block).alias("__block"), F.col(key).alias("__key"), F.col(vector).cast("array<double>").alias("__v"))
    rows = rows.where("__block is not null and __key is not null").withColumn("__norm", F.sqrt(dot(F.col("__v"), F.col("__v")))).where((F.col("__norm") > 0) & (F.col("__norm") < float("inf")))
    rows, blocks = rows.withColumn("__size", F.size("__v")), ["__block", "__size"]
    sizes = stored(rows.groupBy(blocks).agg(F.ceil(F.count("*") / chunk).alias("__chunks")), "blocks")
    tasks = _tasks(sizes.agg(F.sum(F.col("__chunks") * F.col("__chunks"))).first()[0])
    dealt = rows.join(sizes, blocks).withColumn("__own", F.pmod(F.xxhash64("__key"), F.col("__chunks"))).withColumn("__met", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__chunks") - 1)))
    # columns are named anew on each side, as both come from one table
    anew = lambda **names: dealt.select(*[F.col(c).alias(n) for n, c in names.items()])
    cell = ["b", "n", "i", "j"]
    side = lambda i, j: anew(b=blocks[0], n=blocks[1], i=i, j=j, __key="__key", __v="__v", __norm="__norm").repartition(tasks, *cell).groupBy(*cell)
    pairs = side("__own", "__met").cogroup(side("__met", "__own")).applyInPandas(_compared(key, least, most), f"`{key}` {kind}, other {kind}, similarity double")
    if most is not None:
        near = Window.partitionBy(key).orderBy(F.desc("similarity"), "other")
        pairs = pairs.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= most)
    return pairs


def search(vectors: DataFrame, query: list[float], key: str, vector: str, n: int = 5) -> DataFrame:
    """The n vectors nearest to one query, rounded to four decimals; ties by key."""
    given = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(key, F.round(cosine(F.col(vector), given), 4).alias("similarity")).orderBy(F.desc("similarity"), key).limit(n)


def _meeting(left: DataFrame, right: DataFrame, chunk: int, scored: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What scored(left rows, right rows) gives for each pair of a left and a right chunk of one `block`.

    Both sides are dealt by the hash of `__key` into chunks of about `chunk` rows, so a hot block is many tasks' work.
    """
    anew = lambda rows: rows.select(*[F.col(c).alias(c) for c in rows.columns])  # noqa: E731  both sides may come from one table
    parts = lambda rows, name: rows.groupBy("block").agg(F.ceil(F.count("*") / chunk).alias(name))
    sizes = stored(parts(left, "lefts").join(parts(anew(right), "rights"), "block"), "blocks")

    def dealt(rows: DataFrame, own: str, others: str, at: str, met: str) -> DataFrame:
        told = anew(rows).join(sizes, "block").withColumn(at, F.pmod(F.xxhash64("__key"), own)).withColumn(met, F.explode(F.sequence(F.lit(0).cast("long"), F.col(others) - 1)))
        return told.drop("lefts", "rights")

    cell = ["block", "i", "j"]
    tasks = _tasks(sizes.agg(F.sum(F.col("lefts") * F.col("rights"))).first()[0])
    side = lambda rows: rows.repartition(tasks, *cell).groupBy(*cell)
    return side(dealt(left, "lefts", "rights", "i", "j")).cogroup(side(dealt(right, "rights", "lefts", "j", "i"))).applyInPandas(scored, schema)


def _nearest(most: int, window: int, earlier: bool) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """For each left row its nearest `most` right rows within so many microseconds, ties to the lesser key; of earlier place only, if asked."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"order_id": a["__key"][:0], "candidate_id": a["__key"][:0], "similarity": np.zeros(0)})]
        if len(a) and len(b):
            b = b.sort_values("__key", kind="stable")
            width = max(map(len, [*a["__v"], *b["__v"]]))
            fits = lambda rows: rows[[len(v) == width for v in rows["__v"]]]
            if len(fits(a)) < len(a) or len(fits(b)) < len(b):  # vectors of different lengths are not compared
                sizes = {len(v) for v in a["__v"]} & {len(v) for v in b["__v"]}
                of = lambda rows, n: rows[[len(v) == n for v in rows["__v"]]]
                return pd.concat([*found, *[run(of(a, n), of(b, n)) for n in sizes]])
            _, place = np.unique(np.r_[a["__place"].to_numpy(object), b["__place"].to_numpy(object)], return_inverse=True)
            w, others, at, norms = np.stack(b["__v"]).astype(np.float64).T.copy(), b["__key"].to_numpy(), b["__at"].to_numpy(), b["__norm"].to_numpy()
            for lo in range(0, len(a), 64):
                part = a.iloc[lo : lo + 64]
                v, keys, scores = np.stack(part["__v"]).astype(np.float64), part["__key"].to_numpy(), np.zeros((len(part), len(b)))
                for i in range(width):  # in the order of `dot`, so that equal vectors score alike in any chunk
                    scores += v[:, i, None] * w[i]
                scores /= part["__norm"].to_numpy()[:, None] * norms
                ok = (keys[:, None] != others) & (np.abs(part["__at"].to_numpy()[:, None] - at) <= window)
                if earlier:
                    ok &= place[lo : lo + len(part), None] > place[None, len(a) :]
                scores[~ok] = -np.inf
                columns = np.argsort(-scores, axis=1, kind="stable")[:, :most]
                rows = np.broadcast_to(np.arange(len(part))[:, None], columns.shape)
                hit = scores[rows, columns] > -np.inf
                rows, columns = rows[hit], columns[hit]
                found.append(pd.DataFrame({"order_id": keys[rows], "candidate_id": others[columns], "similarity": scores[rows, columns]}))
        return pd.concat(found[1:] or found)

    return run


def projections(rows: DataFrame, vector: str, tables: int, depth: int, width: float, seed: int = 42) -> DataFrame:
    """rows with `hashes`: a value for each table, in which vectors of unit length meet the likelier the nearer they are.

    Random projections in buckets of a width, from 0 on: those of unit vectors lie within 1 of 0, so a width of 1 or more
    tells the two sides of a random plane apart, which two vectors share with probability 1 - angle / pi.  A table's value
    is that of `depth` projections together: at a cosine of 0.82, 32 tables of 10 meet with probability 0.98.
    """
    unit = array_to_vector(F.transform(F.col(vector).cast("array<double>"), lambda x: x / F.col("__norm")))
    rows = rows.withColumn("__unit", unit)
    first = rows.select(F.size(vector).alias("n")).first()
    if first is None:
        return rows.withColumn("hashes", F.array().cast("array<bigint>")).drop("__unit")
    lsh = BucketedRandomProjectionLSH(inputCol="__unit", outputCol="__hashes", bucketLength=width, numHashTables=tables * depth, seed=seed).fit(rows)
    told = lsh.transform(rows).withColumn("__hashes", F.transform("__hashes", lambda h: vector_to_array(h)[0].cast("long")))
    return told.withColumn("hashes", F.array(*[F.xxhash64(F.slice("__hashes", 1 + i * depth, depth)) for i in range(tables)])).drop("__unit", "__hashes")


def near_orders(orders: DataFrame, settings: Settings = DEFAULT, earlier: bool = False, approximate: tuple[int, int, float] | None = None, chunk: int = 4 * CHUNK) -> DataFrame:
    """(order_id, candidate_id, similarity, rank): the nearest `semantic_candidates` of each order that is in no group.

    Candidates are orders of no group and groups' canonical ones, of the same or no project type, within the window; of
    an earlier place in the canonical order only, if asked.  A pair meets in one block of time and type: an order asks in
    its own window-long bucket of time and those beside it, for its type and for none (without a type, for all), and a
    candidate stands in its own.  Blocks are scored chunk by chunk, so nothing is joined pair by pair, and only each
    order's best leave a pair of chunks.  approximate=(tables, depth, width) lets only those meet whose random
    projections agree in a table, and scores these exactly.  Vectors that are null, zero or not finite take no part.
    """
    days, most = settings.semantic_window_days, settings.semantic_candidates
    place = F.concat(F.lpad((F.unix_micros("published_at") + F.lit(1 << 61)).cast("string"), 20, "0"), (9 - completeness()).cast("string"), F.lpad((10**6 - F.coalesce("relevance_score", F.lit(0))).cast("string"), 7, "0"), F.col("order_id").cast("string"))
    v = F.col("embedding")
    rows = orders.select(
        F.col("order_id").alias("__key"), v.alias("__v"), F.sqrt(dot(v, v)).alias("__norm"), F.unix_micros("published_at").alias("__at"), F.col("project_type").alias("__type"), place.alias("__place"),
        F.floor(F.unix_seconds("published_at") / (86400 * days)).alias("__bucket"), F.col("canonical_order_id").isNull().alias("__single"), (F.col("canonical_order_id") == F.col("order_id")).alias("__first"),
    ).where("__key is not null and __bucket is not null and __norm > 0 and __norm < double('Infinity') and (__single or __first)")
    if approximate:
        rows = projections(rows, "__v", *approximate)
    rows = stored(rows, "vectors")
    typed, named = F.col("__type").isNotNull(), F.concat(F.lit("is "), F.col("__type"))
    block = lambda buckets, types: F.explode(F.flatten(F.transform(buckets, lambda b: F.transform(types, lambda t: F.concat_ws("|", b.cast("string"), t)))))
    asked = F.array(*[F.col("__bucket") + i for i in ((-1, 0) if earlier else (-1, 0, 1))])
    left = rows.where("__single").withColumn("block", block(asked, F.when(typed, F.array(named, F.lit("none"))).otherwise(F.array(F.lit("all")))))
    right = rows.withColumn("block", block(F.array("__bucket"), F.array(F.when(typed, named).otherwise(F.lit("none")), F.lit("all"))))
    if approximate:
        each = lambda side: side.select("*", F.posexplode("hashes").alias("__table", "__hash")).withColumn("block", F.concat_ws("|", "block", "__table", "__hash")).drop("__table", "__hash", "hashes")
        left, right = each(left), each(right)
    slim = lambda side: side.select("block", "__key", "__v", "__norm", "__at", "__place")
    kind = dict(orders.dtypes)["order_id"]
    pairs = _meeting(slim(left), slim(right), chunk, _nearest(most, 86_400_000_000 * days, earlier), f"order_id {kind}, candidate_id {kind}, similarity double")
    if approximate:
        pairs = pairs.dropDuplicates(["order_id", "candidate_id"])
    near = Window.partitionBy("order_id").orderBy(F.desc("similarity"), "candidate_id")
    return pairs.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= most)


#: What `contradiction` reads.
FACTS = ("project_type", "contacts", "budget_from", "budget_to", "budget_currency", "deadline", "title", "summary")


def semantic_duplicates(orders: DataFrame, settings: Settings = DEFAULT, earlier: bool = False, approximate: tuple[int, int, float] | None = None) -> DataFrame:
    """(order_id, candidate_id, similarity, outcome) for orders that are in no group and have an embedding.

    Compatibility is asked of the nearest `semantic_candidates` only (see near_orders).  outcome: auto_merge,
    manual_review or no_match.
    """
    missing = {c: F.lit(0) for c in ("relevance_score",) if c not in orders.columns} | {c: F.lit(None).cast("string") for c in ("deadline_text",) if c not in orders.columns} | {c: F.lit(False) for c in ("budget_negotiable",) if c not in orders.columns}
    orders = orders.withColumns(missing)
    near = near_orders(orders, settings, earlier, approximate)
    facts = orders.select("order_id", F.struct(*FACTS).alias("facts"))
    side = lambda key, name: facts.select(F.col("order_id").alias(key), F.col("facts").alias(name))
    fitting = near.join(side("order_id", "a"), "order_id").join(side("candidate_id", "b"), "candidate_id").where(~contradiction("a", "b"))
    best = fitting.groupBy("order_id").agg(F.min_by(F.struct("candidate_id", "similarity"), "rank").alias("best"))
    asked = orders.where("embedding is not null and canonical_order_id is null").select("order_id")
    out = asked.join(best, "order_id", "left").select("order_id", "best.candidate_id", "best.similarity")
    told = F.when(F.col("similarity") >= settings.semantic_merge, "auto_merge").when(F.col("similarity") >= settings.semantic_review, "manual_review").otherwise("no_match")
    return out.withColumn("outcome", told)


def followed(pointers: DataFrame, rounds: int = 40) -> DataFrame:
    """pointers(node, to) -> (node, root): where following them ends.  Each round halves what is left of every chain.

    Pointers must not go in circles; a chain of up to 2^rounds is followed to its end, a longer one or a circle raises.
    """
    now = stored(pointers.select("node", F.col("to").alias("root")), "pointers")
    for _ in range(rounds):
        ahead = now.select(F.col("node").alias("root"), F.col("root").alias("ahead"))
        after = stored(now.join(ahead, "root", "left").select("node", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "pointers")
        dropped(now)
        now = after.drop("moved")
        if not after.where("moved").limit(1).count():
            return now
    raise ValueError("pointers go in circles")


def merge_semantic(orders: DataFrame, settings: Settings = DEFAULT, approximate: tuple[int, int, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """Orders after semantic merging, and an audit row for each merge and each pair to be reviewed.

    orders is what deduplicate_orders gives, with embeddings.  Each order that is in no group points to its best fitting
    earlier one (in the order by which canonical orders are chosen) if that reaches `semantic_merge`.  Pointers go back
    only, so there are no circles; where they end is the canonical order of all that lead there, with its exact group if it
    has one.  Adds semantic_status and semantic_similarity (null for orders that were not asked).
    """
    found = stored(semantic_duplicates(orders, settings, True, approximate), "semantic")
    merges = found.where("outcome = 'auto_merge'")
    roots = followed(merges.select(F.col("order_id").alias("node"), F.col("candidate_id").alias("to")))
    heads = roots.select(F.col("root").alias("order_id")).distinct().join(orders.select("order_id", F.col("duplicate_group_id").alias("g"), F.coalesce("group_size", F.lit(1)).alias("n")), "order_id")
    sizes = roots.groupBy(F.col("root").alias("order_id")).agg(F.count("*").alias("more"))
    heads = stored(heads.join(sizes, "order_id").select(F.col("order_id").alias("root"), F.coalesce("g", F.concat(F.lit("semantic:"), F.col("order_id").cast("string"))).alias("g"), (F.col("n") + F.col("more")).alias("size")), "heads")
    told = roots.unionByName(heads.select(F.col("root").alias("node"), "root")).join(heads, "root").select(F.col("node").alias("order_id"), "root", "g", "size")
    out = orders.join(told, "order_id", "left").join(found.select("order_id", F.col("outcome").alias("semantic_status"), F.col("similarity").alias("semantic_similarity")), "order_id", "left")
    # the other members of an exact group that others joined
    grown = heads.select(F.col("g").alias("duplicate_group_id"), F.col("size").alias("grown"))
    out = out.withColumn("duplicate_group_id", F.coalesce("duplicate_group_id", "g")).withColumn("canonical_order_id", F.coalesce("canonical_order_id", "root"))
    out = out.withColumn("method", F.coalesce("method", F.when(F.col("root").isNotNull(), "semantic"))).join(grown, "duplicate_group_id", "left").withColumn("group_size", F.coalesce("grown", "group_size"))
    action = F.when(F.col("outcome") == "auto_merge", "duplicate.semantic_auto_merge").otherwise("duplicate.semantic_review_candidate")
    payload = F.to_json(F.struct(F.col("candidate_id").cast("string").alias("candidate_order_id"), F.round("similarity", 4).alias("similarity")))
    audit = found.where("outcome <> 'no_match'").select(action.alias("action"), F.lit("order").alias("entity"), F.col("order_id").cast("string").alias("entity_id"), payload.alias("payload"))
    return out.select(*orders.columns, "semantic_status", "semantic_similarity"), audit
