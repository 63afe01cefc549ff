"""Near copies on five-word shingles: SimHash ball hashing finds the candidates, true overlap of 0.8 or more decides.

A 64-bit fingerprint cannot serve here: two texts whose sets of five-word shingles have a Jaccard similarity of 0.8
differ in 0.15 of the bits of their SimHash, so in 10 of 64.  So each text gets several independent short SimHash
fingerprints, PARTS of BITS bits, each told apart by two anchors (the least shingles under two orders of that part), and
each distinct one emits all variants within half the radius of 2 bits.  Texts meet where anchors and variant are equal:

1. Documents of equal shingle sets are one class, named by a hash of the set, so copies cost nothing further.
2. A pair at exactly 0.8 shares both anchors with probability 0.64 and is then within 2 of 12 bits with 0.73, so it
   meets in one of 10 parts with 1 - (1 - 0.47)^10 = 0.998; a pair at 0.85 with 0.9998.  Unlike texts share no anchors,
   whatever the corpus's size, and those that share a passage are told apart by the fingerprint.
3. Each class is held against the least class that it meets anywhere; most groups are joined by that.  Then, in each
   bucket (anchors and variant) that still holds several components, all pairs across them are compared if it has up to
   SMALL classes.  Candidates whose whole SimHashes (2 x 64 bits) differ in over FAR bits make no pair: at 0.8 that is
   four standard deviations away.
4. Classes of larger buckets that are still open, so texts that share much with very many others, are opened by their
   rarest shingles, and exactly: with the shingles of each set in one order, by how often shingles of their slot occur among these classes, two
   sets that overlap enough share a shingle before either has too few left (9 x min(left) >= 4 x (sizes together)).  What
   all share stands last and opens nothing, unless the texts are near copies indeed; of these, each is first held against
   the one that stands nearest to the core at any of its shingles, and of the pairs across components that remain, only
   those with a class outside the shingle's commonest component are made.  There is no draw and no repetition.
5. Every pair is verified by the true overlap of its shingle sets, in whole numbers.

Components of verified pairs are the groups.  Texts without words are one class.  A text of fewer words than a
shingle is one shingle.  Documents with a null key are in no group.  Repeated rows, ties and clashing columns do no
harm: only the key and the text are read, and the smallest key stands for a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import small_batches, stash, unstash
from gleaner.llm.components import components
from gleaner.llm.simhash import ball, majority

WIDTH, PARTS, BITS, RADIUS = 5, 10, 12, 2
#: Similarity asked for, as a fraction of whole numbers.
LEAST = (4, 5)
#: Most of 128 bits that texts at that similarity differ in (19.4 on average, with a standard deviation of 4.1).
FAR = 38
#: Buckets of up to so many classes are compared pair by pair; larger ones are opened by rare shingles.
SMALL = 32
#: Most counters of shingles that every task knows, a byte each, and how many of them travel to the driver in a row.
SLOTS, PACKED = 1 << 22, 1 << 14
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(42).integers(1, 1 << 63, 2 * PARTS + 1, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text; words as in simhash.fingerprint."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes, width = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), min(WIDTH, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = out * _ODD + hashes[i : i + n]
    return np.unique(_mixed(out))


def class_of(found: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 42)).astype(np.int64)) if len(found) else 0


def anchors(found: np.ndarray) -> np.ndarray:
    """For each part the least shingles under its two orders, mixed into one number; none for a text without words."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.array([_mixed(found ^ seed).min() for seed in _SEEDS[: 2 * PARTS]], np.uint64)
    return (least[:PARTS] * _ODD + least[PARTS:]).view(np.int64)


def sketches(found: np.ndarray) -> tuple[int, int]:
    """Two independent SimHashes of the set, as signed numbers."""
    return tuple(int(np.uint64(majority(h)).astype(np.int64)) for h in (found, _mixed(found ^ _SEEDS[2 * PARTS])))


def marks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, fp, a, b, anchors) for each row with a key; fp names the class, a and b are its SimHashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [shingles(t) for t in rows["text"]]
            both = np.array([sketches(f) for f in found], np.int64).reshape(-1, 2)
            yield pd.DataFrame({"key": rows["key"], "fp": np.array([class_of(f) for f in found], np.int64), "a": both[:, 0], "b": both[:, 1], "anchors": [anchors(f) for f in found]})

    small_batches(docs.sparkSession)
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInPandas(run, "key string, fp long, a long, b long, anchors array<long>").withColumn("key", F.col("key").cast(dict(docs.dtypes)[key]))


def placed(classes: DataFrame) -> DataFrame:
    """(fp, part, anchor, bits, cell) for each class and part; a cell is one distinct short fingerprint under its anchors."""
    # part i has the bits from 12 x (i mod 5) on of one of the two SimHashes
    per = 64 // BITS
    bits = [F.shiftrightunsigned("a" if i < per else "b", BITS * (i % per)).bitwiseAND(F.lit((1 << BITS) - 1)) for i in range(PARTS)]
    told = F.array(*[F.struct(F.lit(i).alias("part"), F.get("anchors", F.lit(i)).alias("anchor"), x.alias("bits")) for i, x in enumerate(bits)])
    each = classes.where(F.size("anchors") > 0).select("fp", F.explode(told).alias("t")).select("fp", "t.*")
    return each.withColumn("cell", F.xxhash64("part", "anchor", "bits"))


def variants(cells: DataFrame) -> DataFrame:
    """(bucket, cell, lo, hi): all variants within half the radius of each distinct short fingerprint, under its anchors."""
    masks = F.array(*[F.lit(m).cast("long") for m in ball(BITS, RADIUS // 2)])
    made = cells.select("part", "anchor", "bits", "cell", "lo", "hi", F.explode(masks).alias("mask"))
    return made.select(F.xxhash64("part", "anchor", F.col("bits").bitwiseXOR(F.col("mask"))).alias("bucket"), "cell", "lo", "hi")


def sets_of(docs: DataFrame, named: DataFrame, key: str, text: str) -> DataFrame:
    """(fp, shingles) of the classes in named(fp, least): each from a row of that key whose text is of the class."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [shingles(t) for t in b["text"]]
            fits = [class_of(f) == fp for f, fp in zip(found, b["fp"], strict=True)]
            yield pd.DataFrame({"fp": b["fp"], "shingles": [f.view(np.int64) for f in found]})[fits]

    rows = docs.select(F.col(key).alias("least"), F.col(text).cast("string").alias("text")).join(named, "least").select("fp", "text")
    return rows.mapInPandas(run, "fp long, shingles array<long>").dropDuplicates(["fp"])


def _apart(x: str, y: str) -> str:
    return f"bit_count({x}.a ^ {y}.a) + bit_count({x}.b ^ {y}.b)"


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose shingle sets overlap enough."""
    top, of = LEAST
    a, b = F.size("a"), F.size("b")
    both = pairs.join(sets.select(F.col("fp").alias("v"), F.col("shingles").alias("b")), "v").join(sets.select(F.col("fp").alias("u"), F.col("shingles").alias("a")), "u")
    shared = F.size(F.array_intersect("a", "b"))
    return both.where((F.least(a, b) * of >= F.greatest(a, b) * top) & (shared * (top + of) >= (a + b) * top)).select("u", "v")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct()


def _crossing(told: DataFrame, others: str, x: str = "c") -> DataFrame:
    """Pairs of c with those of an array that have another root and lie near enough; the array is thinned out before it makes rows."""
    near = F.expr(f"filter({others}, y -> y.root <> {x}.root and {_apart(x, 'y')} <= {FAR})")
    return _ordered(told.select(F.col(f"{x}.fp").alias("u"), F.explode(near).alias("y")).select("u", F.col("y.fp").alias("v")))


def _open(balls: DataFrame, members: DataFrame, rooted: DataFrame) -> DataFrame:
    """(bucket, fp, n) of the buckets of balls(bucket, cell) that hold several components; asked by cells, so only open buckets are spelt out."""
    cells = members.join(rooted.select("fp", "root"), "fp").groupBy("cell").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    several = balls.join(cells, "cell").groupBy("bucket").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi")
    return balls.join(several.select("bucket", "n"), "bucket").join(members, "cell").select("bucket", "fp", "n")


def _pairs_inside(members: DataFrame, rooted: DataFrame) -> DataFrame:
    """All pairs across components in the small buckets of members(bucket, fp, n)."""
    told = members.where(F.col("n") <= SMALL).join(rooted, "fp").select("bucket", F.struct("fp", "root", "a", "b").alias("c"))
    small = told.groupBy("bucket").agg(F.collect_list("c").alias("every"))
    return _crossing(small.select("every", F.explode("every").alias("c")), "every")


def _hard(members: DataFrame, rooted: DataFrame) -> DataFrame:
    """(fp) of the classes in large buckets of members(bucket, fp, n) that hold several components."""
    told = members.where(F.col("n") > SMALL).join(rooted.select("fp", "root"), "fp").select("bucket", "fp", "root")
    several = told.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket")
    return told.join(several, "bucket").select("fp").distinct()


def counters(sets: DataFrame) -> np.ndarray:
    """How many shingles of all sets(fp, shingles) fall into each slot, in eighths of a power of two; 0 where at most one does.

    A shingle's slot is its last bits, and it occurs no more often than that.  About two slots for each occurrence,
    SLOTS at most whatever the input.  The counts are packed in tasks, so the driver gets a byte for each slot.
    """
    total = sets.agg(F.sum(F.size("shingles"))).first()[0] or 0
    slots = min(SLOTS, 1 << max(10, (2 * total).bit_length()))
    size = min(slots, PACKED)

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(size, np.uint8)
        out[rows["slot"].to_numpy(np.int64) % size] = rows["level"]
        return pd.DataFrame({"pack": rows["pack"].iloc[:1], "levels": [out.tobytes()]})

    each = sets.select(F.explode("shingles").alias("shingle")).groupBy(F.col("shingle").bitwiseAND(F.lit(slots - 1)).cast("int").alias("slot"))
    level = F.least(F.floor(8 * F.log2("n")), F.lit(255)).cast("int").alias("level")
    told = each.agg(F.count("*").alias("n")).where("n > 1").select((F.col("slot") / size).cast("int").alias("pack"), "slot", level)
    out = np.zeros((slots // size, size), np.uint8)
    for row in told.groupBy("pack").applyInPandas(packed, "pack int, levels binary").collect():  # slots / size rows at most
        out[row["pack"]] = np.frombuffer(row["levels"], np.uint8)
    return out.reshape(-1)


def first_shingles(sets: DataFrame) -> DataFrame:
    """(shingle, fp, size, left): of each set(fp, shingles) the shingles, the rarest first, as far as another set that overlaps enough may share none before.

    left counts the shingle at hand and those after it; it is never under LEAST of the size.  Any order does that is the same
    in all sets; shingles are ordered by the counts of their slots, which every task knows, so none is joined or shuffled
    but those that open.  A shingle alone in its slot is no other set's and opens nothing: those stand first, so it is
    enough to know how many a set has of them.
    """
    top, of = LEAST
    often = counters(sets)

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size, left, first = [], [], []
            for found in b["shingles"]:
                times = often[found & (len(often) - 1)]
                shared = times > 0
                n, least = int(shared.sum()), -(-len(found) * top // of)  # so many must be left to overlap with a fitting set
                ranked = found[shared][np.lexsort((found[shared], times[shared]))]
                size.append(len(found))
                left.append(n)
                first.append(ranked[: max(0, n - least + 1)])
            yield pd.DataFrame({"fp": b["fp"], "size": size, "n": left, "first": first})

    told = sets.select("fp", "shingles").mapInPandas(opened, "fp long, size int, n int, first array<long>")
    each = told.select("fp", "size", "n", F.posexplode("first").alias("pos", "shingle"))
    return each.select("shingle", "fp", "size", (F.col("n") - F.col("pos")).alias("left"))


def _fits(x: str, y: str) -> str:
    """Whether sets of such sizes can overlap enough if the shingle at hand is the first that they share."""
    top, of = LEAST
    sizes = f"least({x}.size, {y}.size) * {of} >= greatest({x}.size, {y}.size) * {top}"
    return f"{x}.root <> {y}.root and {sizes} and least({x}.left, {y}.left) * {top + of} >= ({x}.size + {y}.size) * {top}"


def _with_roots(entries: DataFrame, rooted: DataFrame) -> DataFrame:
    return entries.join(rooted.select("fp", "root"), "fp").select("shingle", F.struct("fp", "root", "size", "left").alias("c"))


def _pairs_with_core(entries: DataFrame, rooted: DataFrame) -> DataFrame:
    """At each shingle that several components have, pairs with the class in which it stands first: that with the fewest shingles of its own."""
    told = _with_roots(entries, rooted)
    first = F.min_by("c", F.struct(F.col("c.size") - F.col("c.left"), "c.fp")).alias("core")
    core = told.groupBy("shingle").agg(first, F.min("c.root").alias("lo"), F.max("c.root").alias("hi")).where("lo < hi").select("shingle", "core")
    return _ordered(told.join(core, "shingle").where(_fits("c", "core")).select(F.col("c.fp").alias("u"), F.col("core.fp").alias("v")))


def _pairs_outside(entries: DataFrame, rooted: DataFrame) -> DataFrame:
    """At each shingle, pairs across components; one of a pair is not of the component that holds most of the shingle's classes."""
    told = _with_roots(entries, rooted)
    sizes = told.groupBy("shingle", "c.root").agg(F.count("*").alias("n"))
    most = sizes.groupBy("shingle").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1").select("shingle", "most")
    minor = told.join(most, "shingle").where("c.root <> most").select("shingle", F.col("c").alias("m"))
    return _ordered(minor.join(told, "shingle").where(_fits("m", "c")).select(F.col("m.fp").alias("u"), F.col("c.fp").alias("v")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(fp, least, component) for each class: its least key and that of its component."""
    marked = marks(docs, key, text)
    classes = stash(marked.groupBy("fp").agg(F.min("key").alias("least"), F.first("a").alias("a"), F.first("b").alias("b"), F.first("anchors").alias("anchors")), "classes")
    cells = placed(classes).groupBy("part", "anchor", "bits", "cell").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"))
    cells = stash(cells, "cells")
    every = variants(cells)
    shared = every.groupBy("bucket").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("bucket", "lo")
    balls = stash(every.select("bucket", "cell").join(shared, "bucket"), "balls")
    members = stash(placed(classes).select("fp", "cell").join(balls.groupBy("cell").agg(F.min("lo").alias("lo")), "cell"), "members")
    stars = stash(members.groupBy("fp").agg(F.min("lo").alias("lo")), "stars")
    sets = stash(sets_of(docs, classes.select("fp", "least").join(stars.select("fp"), "fp", "left_semi"), key, text), "sets")

    rooted = classes.select("fp", F.col("fp").alias("root"), "a", "b")
    rooted = _merged(rooted, verified(_ordered(stars.select(F.col("lo").alias("u"), F.col("fp").alias("v"))), sets))
    inside = stash(_open(balls.select("bucket", "cell"), members.select("fp", "cell"), rooted), "open")
    unstash(cells, balls, members, stars)
    rooted = _merged(rooted, verified(_pairs_inside(inside, rooted), sets))
    hard = stash(_hard(inside, rooted), "hard")
    if not hard.isEmpty():
        entries = stash(first_shingles(sets.join(hard, "fp", "left_semi")), "first")
        for pairs in (_pairs_with_core, _pairs_outside):
            rooted = _merged(rooted, verified(pairs(entries, rooted), sets))
        unstash(entries)
    unstash(inside, sets, hard)
    named = classes.select("fp", "least").join(rooted.select("fp", "root"), "fp")
    return named.join(named.groupBy("root").agg(F.min("least").alias("component")), "root").select("fp", "least", "component")


def _merged(rooted: DataFrame, found: DataFrame) -> DataFrame:
    """rooted(fp, root, a, b) with the components that the links (u, v) found join made one."""
    found = stash(found, "links")
    if found.isEmpty():
        unstash(found)
        return rooted
    root = lambda side: rooted.select(F.col("fp").alias(side), F.col("root").alias(f"r{side}"))
    ends = found.join(root("u"), "u").join(root("v"), "v").select(F.col("ru").alias("u"), F.col("rv").alias("v"))
    new = components(ends).select(F.col("u").alias("root"), F.col("root").alias("new"))
    out = stash(rooted.join(new, "root", "left").select("fp", F.coalesce("new", "root").alias("root"), "a", "b"), "rooted")
    unstash(found, new)
    return out


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each group, that of the smallest key.  Rows with a null key stay, as do repeats of a kept key."""
    found = near_duplicates(docs, key, text).select(F.col("component").alias("kept_key")).distinct()
    rows = docs.where(F.col(key).isNotNull())
    return rows.join(found, rows[key] == found["kept_key"], "left_semi").unionByName(docs.where(F.col(key).isNull()))
