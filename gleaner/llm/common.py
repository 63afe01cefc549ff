"""What the operators of this package share: reading tables, shared scratch tables, the word definition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.sources.scratch import dropped, stored

#: Rows in a batch of texts that goes to a Python worker.
BATCH_ROWS = "1000"
#: Fixed value: a word is a maximal run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def small_batches(spark: SparkSession) -> None:
    """Let Python workers get fewer rows at a time than Spark's default: texts are long.  A setting of the user's own stays."""
    name, default = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(name, default) == default:
        spark.conf.set(name, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Write a frame once as a Parquet table in the shared folder and read it back: later jobs reuse it, and a lost executor costs no recomputation.
stash = stored
#: Delete stashed tables whose last reader is done.
unstash = dropped


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def finite(vector: str) -> Column:
    """True for vectors that are not null and hold no null and no non-finite component."""
    each = F.forall(F.col(vector).cast("array<double>"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(each, F.lit(False))


def held_out(mod: int, rest: int, key: str = "doc_id") -> Column:
    """True where crc32 of the key as text leaves that remainder; a null key is never held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % mod == rest, F.lit(False))
