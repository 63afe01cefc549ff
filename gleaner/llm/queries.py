"""Registered queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import byte_bpe, codes, extraction, language, mixing, negatives, parsing, quality, repeats, secrets, simhash, topk, urls
from gleaner.llm.common import held_out, table

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3).select("doc_id", "size", "source_size", "target", "taken")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language.learn(docs.where(~held_out(4, 2)))
    return language.predict(docs, profiles).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.summary(table(spark, sf_dir, "documents"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"), least=200)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3)
    return found.select("doc_id", simhash.hex16("fp").alias("fingerprint"), found["component"].alias("component_id"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs.where(~held_out(3, 1)), table(spark, sf_dir, "labels").where(~held_out(3, 1)))
    return quality.score(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.RULES, urls.tracked())


def op9_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.compare_with_next(table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), "id % 20 = 0", 20)


def op11_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_texts(table(spark, sf_dir, "pages"))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0, positives=5, negatives=5, share=(80, 100))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.ORACLE, "op4_secrets": secrets.ORACLE, "op8_urls": urls.ORACLE, "op10_topk": topk.ORACLE, "op12_codes": codes.ORACLE, "op13_negatives": negatives.ORACLE}
