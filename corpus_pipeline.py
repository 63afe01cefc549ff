"""Corpus pipeline: documents through five stages, each by one operator of gleaner.llm.

Each stage function takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in
the shared folder and reads it back as the next stage's docs.  All but the last return the columns of documents.

1. quality: documents that score under 0.5 go; the model learns from `labels`.
2. near_duplicates: groups whose five-word shingles overlap by 0.8 or more; the document of the smallest id of each group stays.
3. secrets: base spans and live-looking tokens are masked in the text (n_chars follows).
4. mixing: sources are mixed to target weights; a document taken several times is repeated, one taken 0 times goes.
5. encoding: byte-level BPE ids of what was taken, checked by decoding.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import byte_bpe, mixing, overlap, quality, secrets
from gleaner.llm.common import stash, table
from gleaner.llm.queries import RANKS

#: No SQL: quality scores, fingerprints and token ids cannot be expressed in it; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score 0.5 or more.  Only the text decides: repeated rows go or stay together, null and empty texts score 0 and go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of the smallest doc_id of each group.  Rows with a null doc_id are in no group and stay; so do repeated rows of
    a kept doc_id, as a doc_id is one document.  Texts without words, null ones too, are one group."""
    return overlap.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, its secrets masked; a null text stays null and its n_chars is null.  Repeated rows are masked alike."""
    return secrets.mask(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes; documents without words stay out, as they have no share of any target."""
    return mixing.take(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): the ids of each row's text and the digest of the bytes that they decode to.

    A null text counts as empty and has no ids; repeated rows each give a row."""
    ids = byte_bpe.decode(byte_bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", good_quality), ("near_duplicates", near_duplicates), ("secrets", without_secrets), ("mixing", mixed), ("encoding", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
