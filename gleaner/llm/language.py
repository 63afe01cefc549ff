"""Language identification by rank-order profiles.

A profile lists a language's most frequent character n-grams (1 to 3 code points, over lower-cased letters and
single spaces between runs of letters) by rank.  A document's own most frequent n-grams are ranked alike, and
the language with the least sum of out-of-place distances is predicted; an n-gram that a profile lacks costs
the profile's length.

Profiles are learned from a bounded sample: about `per_language` documents of each language, chosen by a hash
of the key.  Every language is learned.  Prediction compares a document with BLOCK languages at a time, in as many
passes over the text, so what a task holds is BLOCK x depth n-grams, however many languages there are; the driver
holds depth n-grams for each language.

Defined results: a text that is null or has no letter gives `und` and score 0; ties between languages go to the
first in code point order; with no learned language every text gives `und`.  Only key and text of a document
are used to predict.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import small_batches, stash

DEPTH, PER_LANGUAGE, BLOCK = 400, 2000, 256
#: Up to so many languages, their shares of the sample are broadcast; beyond, Spark joins them as it finds best.
FEW_LANGUAGES = 1 << 16


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text as packed code points, ascending, and their counts."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    is_letter = letters()[points]
    if not is_letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.concatenate([[32], np.where(is_letter, points, 32), [32]])
    space = points == 32
    points = points[~(space & np.concatenate([[False], space[:-1]]))]
    two = points[:-1] << 21 | points[1:]
    packed = np.sort(np.concatenate([points[points != 32], two, two[:-1] << 21 | points[2:]]))
    firsts = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
    return packed[firsts], np.diff(np.append(firsts, len(packed)))


def ranked(codes: np.ndarray, counts: np.ndarray, depth: int) -> np.ndarray:
    """The most frequent codes, ties to the smaller code."""
    return codes[np.argsort(-counts, kind="stable")[:depth]]


def learn(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", depth: int = DEPTH, per_language: int = PER_LANGUAGE) -> dict[str, list[int]]:
    """Profiles: for each language its packed n-grams by rank.  Rows with a null key, text or language are not learned from."""
    rows = labelled.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).dropna()
    sizes = rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(per_language) / F.count("*")).alias("share"))
    sizes = stash(sizes, "languages")
    few = sizes.count() <= FEW_LANGUAGES  # rows of a name and a number: a few MB at most
    sample = rows.join(F.broadcast(sizes) if few else sizes, "lang").where((F.xxhash64("key", F.lit("language sample")) / F.lit(2.0**64) + 0.5) < F.col("share"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, texts in b.groupby("lang")["text"]:
                found = [grams(t) for t in texts]
                codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                yield pd.DataFrame({"lang": name, "code": codes, "n": np.bincount(at, np.concatenate([n for _, n in found]), len(codes)).astype(np.int64)})

    totals = sample.select("lang", "text").mapInPandas(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    by_lang = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = totals.withColumn("rank", F.row_number().over(by_lang)).where(F.col("rank") <= depth).select("lang", "rank", "code").collect()
    profiles: dict[str, list[int]] = {}
    for r in sorted(top):
        profiles.setdefault(r["lang"], []).append(r["code"])
    return profiles


class Block:
    """Profiles of some languages, laid out for comparing."""

    def __init__(self, profiles: dict[str, list[int]], depth: int) -> None:
        self.names, self.depth = sorted(profiles), depth
        self.known = np.unique(np.concatenate([np.zeros(0, np.int64), *[np.array(profiles[n], np.int64) for n in self.names]]))
        self.places = np.full((len(self.known) + 1, len(self.names)), depth, np.int64)  # the last row: an n-gram in no profile
        for i, n in enumerate(self.names):
            self.places[np.searchsorted(self.known, profiles[n]), i] = np.arange(len(profiles[n]))

    def nearest(self, own: np.ndarray) -> tuple[int, str]:
        """(distance, language) of the least out-of-place language for a document's ranked n-grams."""
        at = np.searchsorted(self.known, own)
        at[(at == len(self.known)) | (self.known[np.minimum(at, len(self.known) - 1)] != own)] = len(self.known)
        place = self.places[at]
        far = np.where(place == self.depth, self.depth, np.abs(place - np.arange(len(own))[:, None])).sum(0)
        best = int(far.argmin())
        return int(far[best]), self.names[best]


def predict(docs: DataFrame, profiles: dict[str, list[int]], key: str = "doc_id", text: str = "text", depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """(key, lang_pred, score): score is 1 - distance / largest possible distance."""
    small_batches(docs.sparkSession)
    names = sorted(profiles)
    blocks = [Block({n: profiles[n] for n in names[i : i + block]}, depth) for i in range(0, len(names), block)]

    def pass_over(told: Block):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                langs, far, sizes = b["lang_pred"].tolist(), b["far"].to_numpy(copy=True), b["n"].to_numpy(copy=True)
                for i, t in enumerate(b["text"]):
                    own = ranked(*grams(t), depth)
                    if len(own):
                        d, lang = told.nearest(own)
                        if sizes[i] == 0 or d < far[i]:  # of languages equally far, the first by name
                            langs[i], far[i], sizes[i] = lang, d, len(own)
                yield pd.DataFrame({"key": b["key"], "text": b["text"], "lang_pred": langs, "far": far, "n": sizes})

        return run

    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"), F.lit("und").alias("lang_pred"), F.lit(0).cast("long").alias("far"), F.lit(0).cast("long").alias("n"))
    for i, told in enumerate(blocks):
        last = i == len(blocks) - 1
        run = pass_over(told)
        rows = rows.mapInPandas((lambda batches, run=run: (x.drop(columns="text") for x in run(batches))) if last else run, f"key string, {'' if last else 'text string, '}lang_pred string, far long, n long")
    score = F.when(F.col("n") > 0, 1.0 - F.col("far") / (F.lit(depth) * F.col("n"))).otherwise(0.0)
    return rows.select(F.col("key").cast(kind).alias(key), "lang_pred", score.alias("score"))
