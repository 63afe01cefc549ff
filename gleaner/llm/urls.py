"""URL filters: host and path rules, and exact membership by a Bloom filter cascade, with DataFrame functions only.

The cascade knows the corpus's complete key universe.  Level 1 encodes the listed keys; level 2 encodes those
other keys of the universe that level 1 lets through; level 3 the listed keys that level 2 lets through; and so
on until a level lets nothing wrong through.  Reading the levels in turn then gives exact membership for every
key of the universe, without the keys: what is read is bit arrays.

The universe is dealt into shards by a hash of the key, about SHARD_KEYS keys each, and every shard has a cascade of
its own: one row with an array of 64-bit words for each level, 64 KB at most for the first and far less for the rest.
A row of the corpus meets its shard's row.  So no constant of the plan and nothing on the driver grows with the list,
and a table of any size goes one way; Spark broadcasts the shards where they are few.  A key outside the universe may
be told wrongly, as with any Bloom filter; build the cascade from the keys that it will be asked for.

Defined results: null or a url without `://` has empty host and path; an empty host is a key like any other;
repeated rows each give a row; of rules that fit, the one with the longest text wins.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import stash

BITS_A_KEY, HASHES = 8, 5
#: Keys of the universe in a shard, about.
SHARD_KEYS = 1 << 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: str) -> Column:
    at = F.instr(F.col(url), "://")
    return F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")


def host(url: str = "url") -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path(url: str = "url") -> Column:
    """What stands after the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(rules: list[tuple[str, str, str]], host_: str = "host", path_: str = "path") -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (verdict, host, path) that fits; nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col(host_) == h) | F.col(host_).endswith(f".{h}")) & F.col(path_).startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _shard(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("shard")), F.lit(shards)).cast("int")


def _places(key: Column, level: int, bits: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), bits) for i in range(HASHES)]


def _has(key: Column, words: Column, level: int) -> Column:
    """Whether a bit array (64-bit words) lets the key through; one without words lets nothing through."""
    bits = (F.size(words) * 64).cast("long")
    found = F.lit(True)
    for at in _places(key, level, bits):
        found = found & (F.getbit(F.get(words, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1)
    return F.when(F.coalesce(F.size(words), F.lit(0)) > 0, found).otherwise(False)


def _encode(keys: DataFrame, level: int) -> DataFrame:
    """(shard, words) for the shards that keys(shard, key) has: each shard's bit array of this level, BITS_A_KEY bits for each of its keys."""
    sizes = keys.groupBy("shard").agg(F.ceil(F.count("*") * BITS_A_KEY / 64).cast("int").alias("n"))
    at = keys.join(sizes, "shard").select("shard", F.explode(F.array(*_places(F.col("key"), level, (F.col("n") * 64).cast("long")))).alias("at"))
    ones = at.select("shard", F.floor(F.col("at") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("ones"))
    zeros = sizes.select("shard", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("word"), F.lit(0).cast("long").alias("ones"))
    words = ones.unionByName(zeros).groupBy("shard", "word").agg(F.bit_or("ones").alias("ones"))
    return words.groupBy("shard").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "ones"))), lambda w: w["ones"]).alias("words"))


class Cascade:
    """levels(shard, words) in order, over so many shards; see marked()."""

    def __init__(self, shards: int) -> None:
        self.shards, self.levels = shards, []

    def marked(self, rows: DataFrame, key: str, out: str = "listed") -> DataFrame:
        """rows with a column that tells whether a key of the universe is listed: each row meets its shard's levels."""
        every = rows.sparkSession.range(self.shards).select(F.col("id").cast("int").alias("__shard"))
        for n, level in enumerate(self.levels):
            every = every.join(level.select(F.col("shard").alias("__shard"), F.col("words").alias(f"__{n}")), "__shard", "left")
        told = F.lit(len(self.levels) % 2 == 1)
        for n in reversed(range(len(self.levels))):
            told = F.when(_has(F.col(key), F.col(f"__{n}"), n), told).otherwise(F.lit(n % 2 == 1))
        met = rows.withColumn("__shard", _shard(F.col(key), self.shards)).join(stash(every, "cascade"), "__shard")
        return met.select(*rows.columns, told.alias(out))


def build(universe: DataFrame, shard_keys: int = SHARD_KEYS) -> Cascade:
    """The cascade of universe(key, listed), a row for each distinct key, in shards of about so many keys."""
    cascade = Cascade(max(1, ceil(universe.count() / shard_keys)))
    keyed = universe.withColumn("shard", _shard(F.col("key"), cascade.shards))
    inside, outside = keyed.where("listed").select("shard", "key"), keyed.where("not listed").select("shard", "key")
    while not inside.isEmpty():
        level = stash(_encode(inside, len(cascade.levels)), "level")
        passed = outside.join(level, "shard").where(_has(F.col("key"), F.col("words"), len(cascade.levels))).select("shard", "key")
        cascade.levels.append(level)
        inside, outside = stash(passed, "passed"), inside
    return cascade


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed: Column, key: str = "page_id", url: str = "url", shard_keys: int = SHARD_KEYS) -> DataFrame:
    """(key, host, path, rule, verdict, listed): the rule's verdict, or else block where the page's host is listed.

    `listed` is an aggregate over the urls of a host (column `url`) that tells whether the host is on the list.
    """
    parsed = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url")).withColumn("host", host()).withColumn("path", path())
    universe = stash(parsed.groupBy(F.col("host").alias("key")).agg(F.coalesce(listed, F.lit(False)).alias("listed")), "hosts")
    told = build(universe, shard_keys).marked(parsed, "host")
    rule, verdict = rule_for(rules)
    return told.select(F.col("key").alias(key), "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


#: The query's list: hosts of which at least so large a share of urls carry tracking parameters.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
TRACKED, SHARE = "utm_", 0.25


def tracked() -> Column:
    return F.avg(F.when(F.col("url").contains(TRACKED), 1.0).otherwise(0.0)) >= SHARE


ORACLE = f"""
WITH cut AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parsed AS (SELECT page_id, url, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
hosts AS (SELECT host, coalesce(avg(CASE WHEN contains(url, '{TRACKED}') THEN 1.0 ELSE 0.0 END) >= {SHARE}, false) AS listed FROM parsed GROUP BY host),
rules(said, h, p) AS (VALUES {", ".join(str(r) for r in RULES)}),
best AS (
  SELECT page_id, host, path, arg_max(h || p, len(h || p)) AS rule, arg_max(said, len(h || p)) AS said
  FROM (SELECT DISTINCT page_id, host, path FROM parsed) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id, host, path)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.said, CASE WHEN h.listed THEN 'block' ELSE 'allow' END) AS verdict, h.listed
FROM parsed p JOIN hosts h ON p.host = h.host LEFT JOIN best b ON p.page_id IS NOT DISTINCT FROM b.page_id AND p.host = b.host AND p.path = b.path
"""
