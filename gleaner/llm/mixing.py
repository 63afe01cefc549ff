"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Targets: sources share all words by weight; a target stops at `most` times its source's size, and the excess is
reshared by weight until none is above (water filling).  Within a source the expected number of copies of a
document is its target spread in proportion to an importance that grows with the document's length (the
number of binary digits of its size), again by water filling with at most `most` copies each.

The whole part of the expected copies is certain.  The fractional part is an inclusion probability p, unequal
between documents: each draws U from a hash of its key and ranks by ((1-p)/p) / ((1-U)/U), its random odds over
its inclusion odds, and the lowest ranks are taken as long as the words left for the source allow; then one more
document closes the gap, if any is nearer to its size than nothing is.  The cut is found by histograms of the ranks, so no source is ever sorted in one
task: only the documents in the one bin of 65,536 that holds the cut are ordered.

One row for each source goes through one task to be numbered and filled, after partial aggregation.

Defined results: null and empty texts have size 0 and take 0; null is a source of its own, ordered last; ties
of rank go to the smaller key, then size; repeated rows draw alike and each count.  A table without words has
targets of 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import WORD, stash

BINS = 65_536


def water_fill(parts: DataFrame, group: list[str], weight: str, cap: str, total: str, out: str) -> DataFrame:
    """Add out = least(cap, level x weight) with one level for each group, so that out sums to the group's total or all are at their cap.  weight > 0."""
    key = F.col(cap) / F.col(weight)
    up = Window.partitionBy(*group).orderBy(key, weight, cap)
    whole = Window.partitionBy(*group)
    before = F.coalesce(F.sum(cap).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(weight).over(up.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.col(total) - before) / rest
    found = parts.withColumn("__key", key).withColumn("__level", level)
    first = F.min(F.when(F.col("__level") < F.col("__key"), F.struct("__key", "__level"))).over(whole)["__level"]
    return found.withColumn(out, F.coalesce(F.least(F.col(cap).cast("double"), first * F.col(weight)), F.col(cap).cast("double"))).drop("__key", "__level")


def uniform(key: Column) -> Column:
    """A number between 0 and 1 drawn from the key's text: 52 bits of its MD5."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(2.0**52)


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, size): words of each document."""
    return docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, source_size, target) for each source; weights repeat over the sources by code point, null last."""
    in_order = Window.orderBy(F.asc_nulls_last("source"))
    by_source = (
        sized.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(in_order) - 1) % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    )
    return water_fill(by_source, [], "weight", "cap", "total", "target").select("source", "source_size", "target")


def _same_source(left: DataFrame, right: DataFrame, *more: str, how: str = "inner") -> DataFrame:
    """Join on source, null being a source, and more."""
    renamed = right.withColumnRenamed("source", "__source")
    on = left["source"].eqNullSafe(renamed["__source"])
    for c in more:
        renamed = renamed.withColumnRenamed(c, f"__{c}")
        on = on & (left[c] == renamed[f"__{c}"])
    return left.join(renamed, on, how).drop("__source", *(f"__{c}" for c in more))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(key, size, source_size, target, copies, taken) for each row of docs; see the module."""
    sized = stash(sizes(docs, key, text, source).withColumn("class", F.length(F.bin("size"))), "sizes")
    by_source = targets(sized, weights, most)

    classes = sized.where("size > 0").groupBy("source", "class").agg(F.sum("size").alias("words"))
    classes = _same_source(classes, by_source).withColumn("weight", F.col("words") * F.col("class")).withColumn("cap", F.col("words") * most)
    classes = (
        water_fill(classes, ["source"], "weight", "cap", "target", "alloc")
        .withColumn("expected", F.col("alloc") / F.col("words"))
        .withColumn("whole", F.least(F.floor("expected"), F.lit(most)))
        .withColumn("p", F.col("expected") - F.col("whole"))
        .select("source", "class", "words", "whole", "p")
    )
    left = classes.groupBy("source").agg(F.sum(F.col("p") * F.col("words")).alias("left"))

    drawn = _same_source(sized, classes.select("source", "class", "whole", "p"), "class", how="left")
    odds = (1 - F.col("p")) / F.col("p") * (F.col("u") / (1 - F.col("u")))
    drawn = drawn.withColumn("u", uniform(F.col("key"))).withColumn("q", F.when(F.col("p") > 0, odds)).withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * BINS))

    up = Window.partitionBy("source").orderBy("bin")
    bins = drawn.where("q is not null").groupBy("source", "bin").agg(F.sum("size").alias("n")).withColumn("before", F.sum("n").over(up) - F.col("n"))
    cut = _same_source(bins, left).where("before < left").groupBy("source").agg(F.max(F.struct("bin", "before", "left")).alias("cut"))
    cut = cut.select("source", F.col("cut.bin").alias("cut_bin"), F.col("cut.before").alias("cut_before"), F.col("cut.left").alias("left"))

    marked = _same_source(drawn, cut, how="left")
    clear = F.col("q").isNotNull() & (F.col("bin") < F.col("cut_bin"))
    edge = F.col("q").isNotNull() & (F.col("bin") == F.col("cut_bin"))
    in_rank = Window.partitionBy("source").orderBy("q", "key", "size")
    at_edge = marked.where(edge).withColumn("before", F.col("cut_before") + F.sum("size").over(in_rank.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    columns = ["key", "source", "size", "q", F.coalesce("whole", F.lit(0)).cast("int").alias("whole")]
    out = marked.where(~F.coalesce(edge, F.lit(False))).select(*columns, F.coalesce(clear, F.lit(False)).alias("extra")).unionByName(at_edge.select(*columns, (F.col("before") + F.col("size") <= F.col("left")).alias("extra")))
    out = stash(out, "chosen")

    gaps = out.groupBy("source").agg(F.sum(F.when(F.col("extra"), F.col("size")).otherwise(0)).alias("got"))
    gaps = _same_source(gaps, left).select("source", (F.col("left") - F.col("got")).alias("gap"))
    apart = F.abs(F.col("size") - F.col("gap"))
    closing = _same_source(out.where("q is not null and not extra"), gaps).where(apart < F.col("gap")).groupBy("source").agg(F.min(F.struct(apart.alias("apart"), "q", "key", "size")).alias("c"))
    closing = closing.select("source", F.col("c.q").alias("close_q"), F.col("c.key").alias("close_key"), F.col("c.size").alias("close_size"))
    out = _same_source(out, closing, how="left")
    last = F.coalesce(~F.col("extra") & (F.col("q") == F.col("close_q")) & F.col("key").eqNullSafe(F.col("close_key")) & (F.col("size") == F.col("close_size")), F.lit(False))
    one = F.row_number().over(Window.partitionBy("source", "key").orderBy("q")) == 1  # of repeated rows, the first
    out = out.where(~last).select("key", "source", "size", "whole", "extra").unionByName(out.where(last).select("key", "source", "size", "whole", one.alias("extra")))
    copies = F.col("whole") + F.col("extra").cast("int")
    return _same_source(out, by_source).select(F.col("key").alias(key), "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


def take(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """docs with each row as often as the mix takes it; rows without words are in no target and stay out.  Rows that repeat a key are taken alike."""
    taken = mix(docs, key, **options).groupBy(F.col(key).alias("__key")).agg(F.max("copies").alias("__copies")).where("__copies > 0")
    met = docs.join(taken, docs[key].eqNullSafe(taken["__key"]))
    return met.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*docs.columns)


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight, source_size * 3 AS cap, sum(source_size) OVER ()::BIGINT AS total FROM src),
levels AS (
  SELECT *, cap / weight AS k,
    (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, weight, cap ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE) / sum(weight) OVER (ORDER BY cap / weight, weight, cap ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS lev
  FROM weighted),
targets AS (
  SELECT source, source_size, coalesce(least(cap::DOUBLE, (arg_min(lev, k) FILTER (WHERE lev < k) OVER ()) * weight), cap::DOUBLE) AS target FROM levels),
cls AS (
  SELECT s.source, length(bin(s.size)) AS class, sum(s.size)::BIGINT AS words, any_value(t.target) AS target FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source WHERE s.size > 0 GROUP BY s.source, length(bin(s.size))),
clev AS (
  SELECT *, words * class AS weight, words * 3 AS cap, (words * 3) / (words * class) AS k,
    (target - coalesce(sum(words * 3) OVER (PARTITION BY source ORDER BY (words * 3) / (words * class), words * class, words * 3 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE) / sum(words * class) OVER (PARTITION BY source ORDER BY (words * 3) / (words * class), words * class, words * 3 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS lev
  FROM cls),
expected AS (
  SELECT *, coalesce(least(cap::DOUBLE, (arg_min(lev, k) FILTER (WHERE lev < k) OVER (PARTITION BY source)) * weight), cap::DOUBLE) / words AS e FROM clev),
classes AS (SELECT source, class, words, least(floor(e), 3)::INT AS whole, e - least(floor(e), 3) AS p FROM expected),
rest AS (SELECT source, sum(p * words ORDER BY class) AS rest FROM classes GROUP BY source),
drawn AS (
  SELECT s.*, c.whole, c.p, (('0x' || substr(md5(s.doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM sized s LEFT JOIN classes c ON s.source IS NOT DISTINCT FROM c.source AND length(bin(s.size)) = c.class),
ranked AS (SELECT *, CASE WHEN p > 0 THEN (1 - p) / p * (u / (1 - u)) END AS q FROM drawn),
summed AS (
  SELECT r.*, t.source_size, t.target, w.rest, sum(size) FILTER (WHERE q IS NOT NULL) OVER (PARTITION BY r.source ORDER BY q NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS bef
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source LEFT JOIN rest w ON r.source IS NOT DISTINCT FROM w.source),
chosen AS (SELECT *, q IS NOT NULL AND bef + size <= rest AS extra FROM summed),
gaps AS (SELECT source, any_value(rest) - sum(CASE WHEN extra THEN size ELSE 0 END) AS gap FROM chosen GROUP BY source),
near AS (
  SELECT c.doc_id, row_number() OVER (PARTITION BY c.source ORDER BY abs(c.size - g.gap), q, c.doc_id, c.size) AS n
  FROM chosen c JOIN gaps g ON c.source IS NOT DISTINCT FROM g.source WHERE q IS NOT NULL AND NOT extra AND abs(c.size - g.gap) < g.gap)
SELECT c.doc_id, size, source_size, target, size * (coalesce(whole, 0) + CASE WHEN extra OR n.n IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS taken
FROM chosen c LEFT JOIN near n ON n.doc_id = c.doc_id AND n.n = 1
"""
