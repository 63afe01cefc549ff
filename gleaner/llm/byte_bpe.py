"""Byte-level BPE encoding and decoding by overlapping chunks.

A long text is cut into chunks of fixed step that overlap.  Each chunk is pre-tokenised on its own, in
parallel; its first pre-tokens may be wrong, as the chunk can start inside one, but as soon as two
neighbouring chunks share a boundary inside their overlap they agree from there on (the pattern never looks
behind).  The text is cut at the first such shared boundary and the pieces are encoded independently.  Where
an overlap has no shared boundary (one pre-token longer than the overlap), the two chunks are encoded as one.

Defined results: a null text counts as empty and has no ids; repeated rows each give a row; only the key and
the text column are read, so other columns can't clash.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import small_batches, stash, text_or_empty

STEP, OVERLAP = 1 << 16, 1 << 11
ROWS_OUT = 256


@lru_cache(maxsize=2)
def tokenizer(rank_file: str, pattern: str):
    """The library's encoder, once per Python worker."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, lines)))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def ragged(parts: list, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate([np.asarray(p, np.int64) for p in parts]) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat).cast(kind))


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, ROWS_OUT):
            yield b.slice(i, ROWS_OUT)


def encode_texts(df: DataFrame, keys: list[str], rank_file: str, pattern: str) -> DataFrame:
    """keys and ids for each row; the text column is encoded as it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(rank_file, pattern)
        for b in sliced(batches):
            ids = [encoder.encode_ordinary(t) for t in b.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], ragged(ids, pa.int32())], [*keys, "ids"])

    kinds = dict(df.dtypes)
    return df.select(*keys, "text").mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", ids array<int>")


def boundaries(chunks: DataFrame, pattern: str, step: int, overlap: int) -> DataFrame:
    """For each chunk, the pre-token starts in its first and in its last overlap, as offsets in the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        found = regex.compile(pattern)
        for b in sliced(batches):
            heads, tails = [], []
            for n, piece in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                starts = [m.start() for m in found.finditer(piece)]
                heads.append([n * step + x for x in starts if x < overlap])
                # the last pre-token may be cut off by the chunk's end, but its start is decided by what stands before
                tails.append([n * step + x for x in starts if x >= step])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), ragged(heads, pa.int64()), ragged(tails, pa.int64())], ["row", "n", "heads", "tails"])

    return chunks.mapInArrow(run, "row long, n long, heads array<long>, tails array<long>")


def encode(docs: DataFrame, rank_file: str, pattern: str, key: str = "doc_id", text: str = "text", step: int = STEP, overlap: int = OVERLAP) -> DataFrame:
    """Return (key, ids array<int>), one row per row of docs, without special tokens.

    Texts of up to `step` characters are one chunk and never leave their task.  Only longer ones are shuffled.
    """
    small_batches(docs.sparkSession)
    if not 0 < overlap < step:
        raise ValueError("overlap must be between 0 and step")
    rows = docs.select(F.col(key).alias("key"), text_or_empty(text).alias("text"))
    short = encode_texts(rows.where(F.length("text") <= step), ["key"], rank_file, pattern)

    long = stash(rows.where(F.length("text") > step), "long-texts").withColumn("row", F.monotonically_increasing_id())
    chunks = long.select("row", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.length("text") - 1) / step).cast("long"))).alias("n"), "text").select("row", "n", F.expr(f"substring(text, cast(n * {step} + 1 as int), {step + overlap})").alias("text"))
    seen = boundaries(chunks, pattern, step, overlap)
    by_chunk = Window.partitionBy("row").orderBy("n")
    cuts = (
        seen.withColumn("next_heads", F.lead("heads").over(by_chunk))
        .withColumn("cut", F.array_min(F.array_intersect("tails", "next_heads")))
        .withColumn("prev_cut", F.lag("cut").over(by_chunk))
        .withColumn("is_last", F.col("next_heads").isNull())
        .select(
            "row", "n", "is_last",
            F.coalesce("prev_cut", F.col("n") * step).alias("lo"),
            F.when(~F.col("is_last"), F.coalesce("cut", (F.col("n") + 1) * step)).alias("hi"),
            # a chunk whose predecessor shares no boundary with it goes on with that one's run
            F.max(F.when(F.col("prev_cut").isNotNull() | (F.col("n") == 0), F.col("n"))).over(by_chunk).alias("run"),
        )
    )
    pieces = chunks.join(cuts, ["row", "n"]).select(
        "row", "run", "n",
        F.expr(f"substring(text, cast(lo - n * {step} + 1 as int), cast(coalesce(hi, n * {step} + length(text)) - lo as int))").alias("text"),
        F.when(F.col("run") == F.col("n"), F.lit(0)).otherwise(1).alias("more"),
    )
    runs = pieces.groupBy("row", "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda p: p["text"]), "").alias("text"))
    parts = encode_texts(runs, ["row", "run"], rank_file, pattern)
    whole = parts.groupBy("row").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("run", "ids"))), lambda p: p["ids"])).alias("ids"))
    stitched = long.select("row", "key").join(whole, "row").select("key", "ids")
    return short.unionByName(stitched).withColumnRenamed("key", key)


def decode(encoded: DataFrame, rank_file: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Add `decoded` (binary): the raw bytes of the ids, concatenated.  Null ids give null."""
    rest = [c for c in encoded.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(rank_file, pattern)
        for b in sliced(batches):
            raw = [None if v is None else encoder.decode_bytes(v) for v in b.column(rest.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(raw, pa.binary())], [*rest, "decoded"])

    kinds = dict(encoded.dtypes)
    return encoded.select(*rest).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in rest) + ", decoded binary")


def digests(docs: DataFrame, rank_file: str, pattern: str, **options) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each document."""
    encoded = decode(encode(docs, rank_file, pattern, **options), rank_file, pattern)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
