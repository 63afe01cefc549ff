"""Dictionaries of thousands of phrases, matched by joins; hits are those of functions.text.match_keywords.

match_keywords compiles every rule into the plan, which is best for some dozens.  Here rules are a table:

* Rules that say the same phrase are matched once; what is found is told to each of them at the end, or counted before.
* Words are judged once for each distinct word of the corpus.  A phrase of one word is found in the words that are it, or it
  between hyphens.  A word within one edit of a phrase shares with it one of the strings that come of deleting one letter or
  none: both sides emit these, and the pairs that meet are verified.
* A longer phrase can only stand where all its words stand: the texts that have its rarest one are searched for it.
* Regexes have no key: they are compiled into the plan as before, and are meant to be few.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import HIT, LETTER, Rule, check_rules, keyword_hits
from gleaner.sources.scratch import stored

#: Single words of so many letters or more are matched within one edit.
LEAST_FUZZY = 6
#: So many pairs of a word and a phrase are broadcast to the texts' words; more are joined by Spark's own choice.
BROADCAST = 1 << 19
#: So many pairs of a word and a longer phrase that it asks for are looked up in each text where it lies.
IN_PLACE = 1 << 12
_KIND = "position int, phrase string, weight int, category string"
#: Runs of letters, and runs with hyphens in them: split at its hyphens, the second gives the first.
_RUNS, _WORDS = r"(?U)\w+", r"(?U)[\w-]+"
#: What a text says of a phrase, the least one counting: a longer phrase, a single word, or else (place of the word, rank of the word among those near the phrase).
_LONGER, _SINGLE, _NEAR = 0, 1, 1 << 62
_PLACE = 1 << 31


def rule_table(rules: DataFrame) -> DataFrame:
    """rules(position, phrase, weight, category) with the phrase in lower case (plain).

    Phrases without a word are left out.
    """
    return rules.select("position", "phrase", "weight", "category", F.trim(F.lower("phrase")).alias("plain")).where(F.col("plain").rlike(_RUNS))


def phrase_table(table: DataFrame) -> DataFrame:
    """The distinct phrases (plain) of a rule table, with single spaces (tight), with their pattern, their words and whether they are one word alone."""
    body = F.array_join(F.transform(F.split(F.col("plain"), r"(?U)\s+"), lambda w: F.regexp_replace(w, r"(?U)([^\w\s])", r"\\$1")), r"\s+")
    runs = F.array_distinct(F.regexp_extract_all("plain", F.lit(_RUNS), F.lit(0)))
    told = table.select("plain").distinct().withColumn("runs", runs)
    return told.withColumns({"tight": F.regexp_replace("plain", r"(?U)\s+", " "), "pattern": F.concat(F.lit(f"(?iU)(?<!{LETTER})"), body, F.lit(f"(?!{LETTER})")), "single": F.col("runs") == F.array("plain")})


def deletions(word: Column) -> Column:
    """The word and what is left of it without any one of its letters."""
    shorter = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), shorter))


def _nearable() -> Column:
    return (F.length("plain") >= LEAST_FUZZY) & ~F.contains("plain", F.lit(" "))


def near_words(words: DataFrame, phrases: DataFrame) -> DataFrame:
    """(word, plain, distance): the distinct words(word) within one edit of a single-word phrase."""
    rules = phrases.where(_nearable()).select("plain", F.explode(deletions(F.col("plain"))).alias("left"))
    each = words.where(F.length("word") >= LEAST_FUZZY).select("word", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("i"))
    each = each.select("word", F.expr("substring(word, 1, i - 1) || substring(word, i + 1, length(word))").alias("left"))  # its deletions, made one by one
    distance = F.levenshtein(F.col("plain"), F.col("word"), 1)
    return each.join(rules, "left").select("word", "plain", distance.alias("distance")).where("distance between 0 and 1").distinct()


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST else df


def longer_hits(texts: DataFrame, pieces: DataFrame, phrases: DataFrame, key: str, text: str) -> DataFrame:
    """(key, plain, found): the first match of each of the phrases, which are not one word alone.

    A text whose white space is single spaces is searched with a phrase's pattern only if it holds the phrase as it is.
    """
    longer = phrases.select("plain", "tight", "pattern", F.explode("runs").alias("run"), F.size("runs").alias("n"))
    often = pieces.join(longer.select("run").distinct(), "run").groupBy("run").agg(F.sum("texts").alias("often"))
    rarest = longer.join(often, "run").groupBy("plain", "tight", "pattern", "n").agg(F.count("*").alias("there"), F.min(F.struct("often", "run"))["run"].alias("run")).where("there = n")
    asked = stored(pieces.join(rarest, "run").select("word", "plain", "tight", "pattern"), "asked")
    if asked.count() <= IN_PLACE:  # then texts need not be shuffled
        every = F.broadcast(asked.agg(F.collect_set("word").alias("asked")))
        called = texts.crossJoin(every).select(key, text, "loose", F.explode(F.array_intersect("asked", "words")).alias("word")).join(F.broadcast(asked), "word")
    else:
        called = texts.select(key, F.explode("words").alias("word")).join(_sized(asked), "word").select(key, "plain", "tight", "pattern").distinct()
        called = texts.select(key, text, "loose").join(called, key)
    found = called.where(F.col("loose") | F.contains(text, "tight")).select(key, "plain", F.expr(f"regexp_extract(`{text}`, pattern, 0)").alias("found"))
    return found.groupBy(key, "plain").agg(F.max("found").alias("found")).where("found <> ''")


def phrase_hits(posts: DataFrame, phrases: DataFrame, key: str, text: str, fuzzy: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What stands in the texts, a row for each text and phrase, in three tables.

    (key, plain, rank) of the single words, where rank is null for the phrase itself; (plain, rank, word, distance) of the
    words within one edit; (key, plain, found) of the longer phrases.
    """
    words, loose = F.array_distinct(F.regexp_extract_all(text, F.lit(_WORDS), F.lit(0))), F.col(text).rlike(r"(?U)\s\s|[^\S ]")
    texts = stored(posts.select(key, text, words.alias("words"), loose.alias("loose")), "texts")  # loose: asked for each phrase
    phrases = stored(phrases, "phrases")
    vocabulary = stored(texts.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("texts")), "vocabulary")
    pieces = vocabulary.select("word", "texts", F.explode(F.array_distinct(F.split("word", "-"))).alias("run")).where("run <> ''")
    met = pieces.join(phrases.where("single").select(F.col("plain").alias("run")), "run").select("word", F.col("run").alias("plain"), F.lit(None).cast("long").alias("rank"), F.lit(0).alias("distance"))
    if fuzzy:
        by_word = Window.partitionBy("plain").orderBy("word")
        near = near_words(vocabulary.select("word"), phrases)
        met = met.unionByName(near.select("word", "plain", F.row_number().over(by_word).cast("long").alias("rank"), "distance"))
    met = stored(met, "met")
    spaced = ~_nearable() if fuzzy else F.lit(True)
    longer = longer_hits(texts, pieces, phrases.where(~F.col("single") & spaced), key, text)
    words = texts.select(key, F.posexplode("words").alias("at", "word"))
    says = F.coalesce(F.lit(_NEAR) + F.col("at").cast("long") * _PLACE + F.col("rank"), F.lit(_SINGLE))
    hits = words.join(_sized(met), "word").select(key, "plain", says.alias("says"))
    hyphened = phrases.where(~F.col("single") & _nearable())
    if fuzzy and hyphened.head(1):  # these may stand as they are where a word near them stands too
        standing = stored(longer_hits(texts, pieces, hyphened, key, text), "longer")
        longer = longer.unionByName(standing)
        hits = hits.unionByName(standing.select(key, "plain", F.lit(_LONGER).cast("long").alias("says")))
    hits = hits.groupBy(key, "plain").agg(F.min("says").alias("says")).where(F.col("says") > _LONGER)
    return hits.select(key, "plain", F.when(F.col("says") >= _NEAR, F.col("says") % _PLACE).alias("rank")), met.where("rank is not null"), longer


def dictionary_hits(posts: DataFrame, rules: list[Rule] | DataFrame, key: str, text: str = "normalized_text", fuzzy: bool = True) -> DataFrame:
    """(key, position, phrase, matched_text, weight, category, is_regex, is_fuzzy, distance): a row for each hit, as keyword_hits has them.

    posts has a unique key and normalised texts (lower case).  rules is a list, or a table (position, phrase, weight, category)
    of phrases that hold a word each.  Rows with a null key or text have no hits.
    """
    posts, compiled, places = posts.select(key, text).where(F.col(key).isNotNull()), [], []
    if isinstance(rules, list):
        check_rules(rules)
        places = [i for i, r in enumerate(rules) if r.is_regex or not re.search(r"\w", r.phrase)]
        compiled = [rules[i] for i in places]
        rules = posts.sparkSession.createDataFrame([(i, r.phrase, r.weight, r.category) for i, r in enumerate(rules) if i not in set(places)], _KIND)
        posts = stored(posts, "posts") if compiled else posts
    table = rule_table(rules)
    hits, near, longer = phrase_hits(posts, phrase_table(table), key, text, fuzzy)
    hits = hits.join(near, ["plain", "rank"], "left").select(key, "plain", F.coalesce("word", "plain").alias("matched_text"), F.coalesce("distance", F.lit(0)).alias("distance"))
    hits = hits.unionByName(longer.select(key, "plain", F.col("found").alias("matched_text"), F.lit(0).alias("distance"))).join(table, "plain")
    fields = ["position", "phrase", "matched_text", "weight", "category", F.lit(False).alias("is_regex"), (F.col("distance") > 0).alias("is_fuzzy"), "distance"]
    hits = hits.select(key, F.struct(*fields).cast(HIT).alias("hit"))
    if compiled:
        found = keyword_hits(posts, compiled, text, fuzzy).withColumn("position", F.element_at(F.array(*map(F.lit, places)), F.col("position") + 1))
        names = [f.split(":")[0] for f in HIT[7:-1].split(",")]
        hits = hits.unionByName(found.select(key, F.struct(*names).cast(HIT).alias("hit")))
    return hits.select(key, "hit.*")


def dictionary_counts(posts: DataFrame, rules: DataFrame, key: str, text: str = "normalized_text", fuzzy: bool = True) -> DataFrame:
    """(position, phrase, exact, fuzzy, letters): the hits of dictionary_hits for each rule that has any, counted by phrase before they are told to its rules."""
    table = rule_table(rules)
    hits, near, longer = phrase_hits(posts.select(key, text).where(F.col(key).isNotNull()), phrase_table(table), key, text, fuzzy)
    each = hits.groupBy("plain", "rank").agg(F.count("*").alias("n")).join(near, ["plain", "rank"], "left")
    each = each.select("plain", "n", (F.coalesce("distance", F.lit(0)) > 0).alias("is_fuzzy"), F.length(F.coalesce("word", "plain")).alias("long"))
    each = each.unionByName(longer.select("plain", F.lit(1).cast("long").alias("n"), F.lit(False).alias("is_fuzzy"), F.length("found").alias("long")))
    counted = lambda of: F.sum(F.when(of, F.col("n")).otherwise(0))
    told = each.groupBy("plain").agg(counted(~F.col("is_fuzzy")).alias("exact"), counted(F.col("is_fuzzy")).alias("fuzzy"), F.sum(F.col("n") * F.col("long")).alias("letters"))
    return table.join(told, "plain").select("position", "phrase", "exact", "fuzzy", "letters")
