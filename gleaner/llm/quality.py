"""Quality classifier: nearest-neighbour voting among latent-semantic vectors.

A text becomes counts of hashed terms: its lower-cased words, the shapes of its tokens (letters as a or A,
digits as 0, runs shortened), repeats of the token before (their number, and whether their share passes some
marks), and repeats of whole lines.  Counts are damped,
weighted by inverse document frequency and projected on the leading directions of a labelled sample (latent
semantic analysis).  Every document is compared with every labelled vector by exact cosine products, block by
block, and the labels of its nearest neighbours are weighted by similarity.

The labelled sample is bounded: about `most_labelled` rows, chosen by a hash of the key, half for each label
where there are as many.  The model is learned from their counts in a task, so what goes to the driver and back out
by broadcast is the model alone, about most_labelled x DIRECTIONS small numbers, whatever the corpus holds.  Repeats
of a key's label are one; a key with both labels counts for each.

Defined results: null texts and texts without words score 0, as there is nothing in them to be good; a text unlike
every labelled one gets the sample's mean label; with no labels every score is 0.5; ties among neighbours go to the
earlier one by key.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import small_batches

WORD_TERMS, SHAPE_TERMS = 768, 256
TERMS = WORD_TERMS + SHAPE_TERMS
#: Shares of tokens that repeat the one before, each a term of its own that counts as so many words.
REPEATED, MARK = (0.1, 0.25, 0.5), 50
DIRECTIONS, NEIGHBOURS, MOST_LABELLED, BLOCK = 48, 25, 4000, 512


def shape(token: str) -> str:
    """Letters as a or A, digits as 0, other characters as they are; runs of the same are one."""
    if token.isalpha():
        return "a" if token.islower() else "Aa" if token.istitle() else "A" if token.isupper() else "aA"
    out = [""]
    for c in token:
        k = ("A" if c.isupper() else "a") if c.isalpha() else "0" if c.isdigit() else c
        if out[-1] != k:
            out.append(k)
    return "".join(out)


class Terms:
    """Counts the terms of texts; remembers the terms of words that it has seen lately."""

    MOST = 200_000

    def __init__(self) -> None:
        self.seen: dict[str, tuple[int, int]] = {}

    def _of(self, token: str) -> tuple[int, int]:
        if len(self.seen) >= self.MOST:
            self.seen.clear()
        found = self.seen[token] = (crc32(token.lower().encode("utf-8", "surrogatepass")) % WORD_TERMS, WORD_TERMS + crc32(shape(token).encode("utf-8", "surrogatepass")) % (SHAPE_TERMS - 8))
        return found

    def counts(self, text: str | None) -> np.ndarray:
        out = np.zeros(TERMS, np.float32)
        tokens = (text or "").split()
        if not tokens:
            return out
        seen, of = self.seen, self._of
        for token, n in Counter(tokens).items():
            word, form = seen.get(token) or of(token)
            out[word] += n
            out[form] += n
        lines = (text or "").split("\n")
        out[TERMS - 1] = again = sum(map(str.__eq__, tokens[1:], tokens))  # repeats of the token before
        for i, share in enumerate(REPEATED):
            if again >= share * len(tokens):
                out[TERMS - 3 - i] = MARK
        out[TERMS - 2] = len(lines) - len(set(lines))
        return out


def damped(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return np.log1p(counts) * idf


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


class Model:
    """Bounded: idf (TERMS), directions (TERMS x DIRECTIONS), vectors (MOST_LABELLED x DIRECTIONS), labels."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, directions: int = DIRECTIONS) -> None:
        self.labels = labels.astype(np.float32)
        self.idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
        weighted = unit(damped(counts, self.idf))
        _, axes = np.linalg.eigh((weighted.T @ weighted).astype(np.float64)) if len(counts) else (0, np.eye(TERMS))
        self.axes = np.ascontiguousarray(axes[:, ::-1][:, :directions], np.float32)
        self.vectors = self.project(counts)

    def project(self, counts: np.ndarray) -> np.ndarray:
        return unit(damped(counts, self.idf) @ self.axes)

    def score(self, counts: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        near = self.project(counts) @ self.vectors.T
        k = min(neighbours, near.shape[1])
        at = np.argsort(-near, axis=1, kind="stable")[:, :k] if near.shape[1] <= k else np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, at, 1), 0).astype(np.float64) ** 8
        total = weight.sum(1)
        mean = np.where(counts.any(1), float(self.labels.mean()), 0.0)
        return np.where(total > 1e-12, (weight * self.labels[at]).sum(1) / np.maximum(total, 1e-12), mean).clip(0, 1)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most_labelled: int = MOST_LABELLED) -> Model:
    """Learn from the documents whose key has a label of 0 or 1; see the module for the bound.

    Keys are sampled before texts are read, so what is joined to the documents is bounded and no text is shuffled.
    """
    small_batches(docs.sparkSession)
    named = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and key is not null").distinct()
    sizes = {r["label"]: r["n"] for r in named.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.create_map(*[x for y in (0, 1) for x in (F.lit(y), F.lit(min(1.0, most_labelled / 2 / max(1, sizes.get(y, 0)))))])
    chosen = named.where((F.xxhash64(F.col("key").cast("string"), F.lit("quality sample")) / F.lit(2.0**64) + 0.5) < share[F.col("label")])
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    sample = rows.join(F.broadcast(chosen), "key").select(F.col("key").cast("string").alias("key"), "text", "label")  # about most_labelled rows

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Terms()
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "label": b["label"], "counts": [terms.counts(t).tobytes() for t in b["text"]]})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if found := [b for b in batches if len(b)]:
            rows = pd.concat(found)
            counts = np.frombuffer(b"".join(rows["counts"]), np.float32).reshape(-1, TERMS)
            yield pd.DataFrame({"model": [pickle.dumps(Model(counts, rows["label"].to_numpy(np.float32)))]})

    # one task for the bounded sample: its counts and what is reckoned from them would be a tenth of a small driver's memory
    in_order = sample.mapInPandas(count, "key string, label int, counts binary").repartition(1).sortWithinPartitions("key", "label", "counts")
    learned = in_order.mapInPandas(learn, "model binary").first()
    return pickle.loads(learned["model"]) if learned else Model(np.zeros((0, TERMS), np.float32), np.zeros(0, np.float32))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) for each row of docs."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = Terms()
        for b in batches:
            for i in range(0, len(b), BLOCK):
                block = b.iloc[i : i + BLOCK]
                yield pd.DataFrame({"key": block["key"], "score": shared.value.score(np.stack([terms.counts(t) for t in block["text"]]))})

    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInPandas(run, "key string, score double").select(F.col("key").cast(kind).alias(key), "score")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, **bounds) -> DataFrame:
    """docs without the documents that score under `least`; all rows of a key share one decision only if their texts do."""
    model = fit(docs, labels, **bounds)
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        terms = Terms()
        return pd.Series(np.concatenate([shared.value.score(np.stack([terms.counts(t) for t in texts.iloc[i : i + BLOCK]])) for i in range(0, len(texts), BLOCK)] or [np.zeros(0)]))

    return docs.where(scored(F.col("text").cast("string")) >= least)
