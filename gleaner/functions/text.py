"""Text functions as columns.  Patterns use Java's Unicode classes ((?U)); dictionaries and markers are arguments."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Abbreviations that normalising spells out.
ABBREVIATIONS = [(r"\bсрочн\b", "срочно"), (r"\bинет[\s-]?магазин\b", "интернет-магазин")]
#: Characters that may not be in composed form already; only texts with one of them go through Python.
MAY_COMPOSE = r"[\p{M}̀-·क़-ਫ਼ଡ଼ଢ଼གྷ-ྐྵᄀ-ᇿά-´  ΩKÅ〈〉⫝̸豈-﫿יִ-פֿ]"
#: What tells languages apart.
CYRILLIC, LATIN, UKRAINIAN = "[а-яёіїєґ]", "[a-z]", "[іїєґ]"
RUSSIAN_MARKERS = ["нужен", "нужно", "ищу", "требуется", "сайт", "сделать", "разработать", "доработать", "бюджет"]
LETTER = r"[\wа-яёіїєґ]"


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(text: Column) -> Column:
    """Composed form; only texts that may need it are sent to Python."""
    return F.coalesce(_composed(F.when(text.rlike(r"[^\x00-\x{02FF}]") & text.rlike(MAY_COMPOSE), text)), text)  # what may compose is beyond; the cheap test first


def normalize_text(text: Column, compose: bool = True) -> Column:
    """Null gives empty; composed, marks and symbols dropped, lower case, abbreviations spelt out, white space single.

    Lower case stands for case folding (they differ for ß, İ and final sigma).  compose=False skips composing, for
    texts that are known to be composed; the plan is then free of Python.
    """
    out = F.coalesce(text, F.lit(""))
    out = F.lower(F.regexp_replace(nfc(out) if compose else out, r"[\p{Mn}\p{So}]", ""))
    for pattern, full in ABBREVIATIONS:
        out = F.regexp_replace(out, f"(?iU){pattern}", full)
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once however often f uses it (a transform of a one-element array)."""
    return F.transform(F.array(value), lambda v: f(v))[0]


def detect_language(text: Column, markers: list[str] | None = None) -> Column:
    """unknown without letters; en under a quarter of Cyrillic; uk by its own letters; ru by markers or half Cyrillic; else unknown.  text is normalised.

    Letters are counted only in texts that have Cyrillic ones, by the length that is lost when they are deleted.
    """
    count = lambda p: F.length(text) - F.length(F.regexp_replace(text, f"(?iu){p}+", ""))
    marked = F.lit(False)
    for m in RUSSIAN_MARKERS if markers is None else markers:
        marked = marked | text.contains(m)
    by_share = lambda share: (
        F.when(share < 0.25, "en").when(text.rlike(f"(?iu){UKRAINIAN}"), "uk").when(marked | (share >= 0.5), "ru").otherwise("unknown")
    )
    mixed = bound(bound(count(CYRILLIC), lambda n: n / (n + count(LATIN))), by_share)
    return F.when(text.rlike(f"(?iu){CYRILLIC}"), mixed).when(text.rlike(f"(?iu){LATIN}"), "en").otherwise("unknown")


def language_by_markers(text: Column, markers: dict[str, list[str]]) -> Column:
    """The first language one of whose marker words stands in the text between word boundaries; else unknown.  For languages of one script."""
    out = F.lit("unknown")
    for lang, words in reversed(markers.items()):
        out = F.when(text.rlike(r"(?U)(?<!\w)(?:" + "|".join(map(re.escape, words)) + r")(?!\w)"), lang).otherwise(out)
    return out


@dataclass(frozen=True)
class Rule:
    """A dictionary entry.  lang and weight are carried along but decide nothing."""

    phrase: str
    lang: str = "ru"
    weight: int = 1
    category: str | None = None
    is_regex: bool = False


class InvalidRule(ValueError):
    pass


def _literal(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text)


def phrase_pattern(phrase: str) -> str:
    """Words of the phrase with any white space between, not inside a longer word."""
    body = r"\s+".join(_literal(w) for w in phrase.lower().split())
    return f"(?iU)(?<!{LETTER}){body}(?!{LETTER})"


def check_rules(rules: list[Rule]) -> None:
    """Raise InvalidRule for a regex that Spark's own engine does not compile."""
    for r in rules:
        if r.is_regex:
            try:
                SparkSession.getActiveSession().sql("SELECT '' RLIKE :pattern", {"pattern": f"(?iU){r.phrase}"}).collect()
            except PySparkException as wrong:
                raise InvalidRule(f"{r.phrase!r}: {wrong}") from wrong


def _alone(f):
    return lambda m: f(m)


def _within_one(phrase: str):
    return lambda w: (F.length(w) >= 6) & F.levenshtein(F.lit(phrase), w, 1).between(0, 1)


HIT = "struct<position:int,phrase:string,matched_text:string,weight:int,category:string,is_regex:boolean,is_fuzzy:boolean,distance:int>"


def match_keywords(text: Column, rules: list[Rule], fuzzy: bool = True) -> Column:
    """Array of hits in rule order: every match of a regex rule; of a phrase its first match, or else the first word within one edit.

    text is normalised, so in lower case.  Fuzzy matches are of single words; both words have six characters or more.
    """
    check_rules(rules)
    words = F.regexp_extract_all(text, F.lit(r"(?iU)[\wа-яёіїєґ-]+"), F.lit(0))
    hits = []
    for i, r in enumerate(rules):
        hit = lambda matched, is_fuzzy=False, distance=0, r=r, i=i: F.struct(
            F.lit(i).alias("position"), F.lit(r.phrase).alias("phrase"), matched.alias("matched_text"), F.lit(r.weight).alias("weight"), F.lit(r.category).cast("string").alias("category"),
            F.lit(r.is_regex).alias("is_regex"), F.lit(is_fuzzy).alias("is_fuzzy"), F.lit(distance).alias("distance"),
        )
        none = F.array().cast(f"array<{HIT}>")
        if r.is_regex:
            found = F.regexp_extract_all(text, F.lit(f"(?iU){r.phrase}"), F.lit(0))
            hits.append(F.transform(found, _alone(hit)).cast(f"array<{HIT}>"))
            continue
        pattern = phrase_pattern(r.phrase)
        phrase = r.phrase.lower().strip()
        miss = none
        if fuzzy and " " not in phrase and len(phrase) >= 6:
            first = F.get(F.filter(words, _within_one(phrase)), F.lit(0))
            told = lambda w, phrase=phrase, hit=hit, none=none: (
                F.when(w.isNull(), none).when(F.levenshtein(F.lit(phrase), w, 1) == 0, F.array(hit(w).cast(HIT))).otherwise(F.array(hit(w, True, 1).cast(HIT)))
            )
            miss = bound(first, told)
        there = text.rlike(pattern)
        for word in phrase.split():
            there = text.contains(word) & there  # cheap, and most texts lack one of the words
        hits.append(F.when(there, F.array(hit(F.regexp_extract(text, pattern, 0)).cast(HIT))).otherwise(miss))
    return F.concat(*hits) if hits else F.array().cast(f"array<{HIT}>")


def keyword_hits(df: DataFrame, rules: list[Rule], text: str = "normalized_text", fuzzy: bool = True) -> DataFrame:
    """A row for each hit, in the dictionary's order; only rows that any phrase or regex could match pay for the extraction."""
    return df.withColumn("hit", F.explode(match_keywords(F.col(text), rules, fuzzy))).select(*df.columns, "hit.*")


def mask_pii(text: Column, compose: bool = True) -> Column:
    """Normalised text with e-mails, handles, links and phone numbers replaced by a word for each kind."""
    out = normalize_text(text, compose)
    for pattern, word in [(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", "email"), (r"@[a-zA-Z][\w\d_]{4,31}", "username"), (r"https?://\S+|t\.me/\S+", "url"), (r"\+?\d[\d\s()\-]{7,}\d", "phone")]:
        out = F.regexp_replace(out, f"(?U){pattern}", f" {word} ")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


#: Words that embeddings treat as one.
ALIASES = {
    "лендинг": "landing", "посадочную": "landing", "посадочная": "landing", "страница": "landing", "страницу": "landing", "одностраничник": "landing", "курс": "course", "курса": "course",
    "онлайн-курса": "course", "сайт": "site", "магазин": "shop", "интернет-магазин": "shop", "оплата": "payment", "платеж": "payment", "crm": "crm", "бот": "bot",
}


def semantic_tokens(text: Column, aliases: dict[str, str] = ALIASES, compose: bool = True) -> Column:
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else None
    words = F.regexp_extract_all(mask_pii(text, compose), F.lit(r"(?U)[\w-]+"), F.lit(0))
    return F.transform(words, lambda w: F.coalesce(table[w], w)) if aliases else words


def build_summary(text: Column, length: int = 500) -> Column:
    """White space compacted, first `length` characters; null for a null or empty text."""
    return F.when(F.length(text) > 0, F.substring(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), 1, length))


def build_title(text: Column) -> Column:
    return F.substring(build_summary(text), 1, 80)


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def shard_for(key: Column, n: int) -> Column:
    """The SHA-256 of the key as a number, modulo n: folded over its hexadecimal digits."""
    digits = F.split(F.sha2(key.cast("binary"), 256), "")
    return F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0).cast("long"), lambda acc, d: F.pmod(acc * 16 + F.conv(d, 16, 10).cast("long"), F.lit(n).cast("long"))).cast("int")


#: Hosts and private paths of source links.
LINK_HOSTS, PRIVATE_PATHS = ["t.me", "telegram.me", "www.t.me", "www.telegram.me"], ["joinchat", "+", "c"]


def source_link(link: Column, hosts: list[str] = LINK_HOSTS) -> Column:
    """struct(username, error): error is SOURCE_NOT_PUBLIC or INVALID_SOURCE_USERNAME."""
    value = F.trim(link)
    rest = F.when(value.contains("://"), F.regexp_extract(value, r"(?s)^.*?://(.*)$", 1)).otherwise(value)
    host = F.lower(F.regexp_extract(rest, r"^(?:[^/?#@]*@)?([^/?#:]*)", 1))
    first = F.regexp_extract(rest, r"^[^/?#]*/+([^/?#]+)", 1)
    private = F.lit(False)
    for p in PRIVATE_PATHS:
        private = private | first.startswith(p)
    known = host.isin(hosts)
    name = F.lower(F.when(value.startswith("@"), F.substring(value, 2, 1_000_000)).when(known, first).when(value.rlike("[/.]"), F.lit("")).otherwise(value))
    good = name.rlike("^[a-z][a-z0-9_]{4,31}$") & ~name.endswith("bot")
    error = F.when(~value.startswith("@") & known & private & (first != ""), "SOURCE_NOT_PUBLIC").when(~F.coalesce(good, F.lit(False)), "INVALID_SOURCE_USERNAME")
    return F.struct(F.when(error.isNull(), name).alias("username"), error.alias("error"))
