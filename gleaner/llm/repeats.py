"""Removal of repeated byte strings by maximal repeats from enhanced suffix arrays.

Every string of LEAST bytes that starts in a document is a window.  A window is assigned to its anchor: the
KGRAM-byte gram in it with the least hash (the first such).  Equal windows have equal anchors at equal places, so
equal windows meet at their anchor's gram.  Consecutive windows with one anchor make a piece: their bytes, at
most 2 x LEAST - KGRAM.  The pieces of all documents are the leaves of one suffix structure, split by anchor.

1. Pieces are counted by anchor with partial aggregation; anchors that occur once are done with.
2. Equal pieces are one leaf with a multiplicity.  Where an anchor has one leaf only, all its windows repeat.
3. Where an anchor has several, their bytes are fetched once for each leaf, the suffixes at their windows are
   sorted (suffix array) with common prefix lengths (LCP array), and a stack scan over the LCP intervals yields
   the maximal repeats: intervals of at least LEAST whose occurrences differ in the byte to the left.  Each is
   a group with all its occurrences, not only neighbours.
4. An anchor with more than LEAVES leaves is split into several suffix arrays.  Each hands on its different
   windows, in runs of RUN places with a digest of the bytes that all windows of the run hold.  Digests are
   counted across the parts with partial aggregation; only runs whose digest occurs again are opened and their
   windows counted likewise, and windows that repeat across parts are added.  So no task holds more than LEAVES
   pieces of an anchor.

Pieces that repeat within one document are decided where they are read, so periodic texts stay small.

Texts are read twice and dealt once: the exchange of the documents serves both the fetch of the leaves and the
removal.

Defined results: null counts as empty; texts shorter than LEAST bytes lose nothing; repeated rows are copies of
each other; rows that share a key are told apart by a hash of their text; keys of any type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import small_batches, stash, text_or_empty

LEAST, KGRAM = 200, 32
LEAVES, RUN = 256, 16
CHUNK = 1 << 20  # bytes that are hashed in one pass; 24 bits of a packed hash hold a place in it
PLACE = np.uint64((1 << 24) - 1)
LONGEST = 1 << 20  # of one span, so that start and length fit a long
RADIX = np.uint64(0x9E3779B97F4A7C15 | 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def anchors(data: np.ndarray, least: int, kgram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of `data` (uint8) the place of its anchor; and the hash of the gram at each place."""
    bytes_ = data.astype(np.uint64) + np.uint64(1)
    grams = bytes_[: len(data) - kgram + 1].copy()
    done = 1
    grams = bytes_
    # doubling: the hash of 2n bytes is that of n, times a power, plus that of the next n
    power = RADIX
    while done < kgram:
        grams = grams[: len(grams) - done] * power + grams[done:]
        with np.errstate(over="ignore"):
            power = power * power
        done *= 2
    grams = _mix(grams)
    spread = least - kgram + 1
    low = grams & ~PLACE | np.arange(len(grams), dtype=np.uint64)
    done = 1
    while done * 2 <= spread:
        low = np.minimum(low[: len(low) - done], low[done:])
        done *= 2
    rest = spread - done
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    return (low & PLACE).astype(np.int64), grams


def pieces(texts: list[bytes], least: int = LEAST, kgram: int = KGRAM) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, start, windows, anchor's place in the piece, anchor's hash) for all pieces, in order of text and start."""
    parts = []  # (text, offset, bytes): long texts in parts that overlap by one window less a byte
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - least + 1), CHUNK):
            if len(t) - at >= least:
                parts.append((i, at, t[at : at + CHUNK + least - 1]))
    i = 0
    while i < len(parts):
        j, size = i, 0
        while j < len(parts) and (j == i or size + len(parts[j][2]) <= CHUNK):
            size += len(parts[j][2])
            j += 1
        group, i = parts[i:j], j
        place, grams = anchors(np.frombuffer(b"".join(p[2] for p in group), np.uint8), least, kgram)
        ends = np.cumsum([len(p[2]) for p in group])
        begin = 0
        for (text, offset, raw), end in zip(group, ends.tolist(), strict=True):
            own = place[begin : end - least + 1]  # windows inside this text
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            hashes = grams[own[first]].view(np.int64).tolist()
            counts = np.diff(np.append(first, len(own))).tolist()
            for p, n, m, h in zip(first.tolist(), counts, (own[first] - begin).tolist(), hashes, strict=True):
                yield text, offset + p, n, m - p, h
            begin = end


def packed(start: int, length: int) -> int:
    return start << 21 | length


def _piece(place: int) -> tuple[int, int, int]:
    """(start, windows, anchor's place in the piece) of a packed piece: start << 21 | anchor << 9 | windows."""
    return place >> 21, place & 511, place >> 9 & 4095


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, e in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((a, e))
    return out


def read_pieces(docs: DataFrame, least: int, kgram: int) -> DataFrame:
    """docs(k, th, text) -> (anchor, leaf, n, place, k, th): pieces with their place (see _piece); anchor null: a span (start << 21 | length) known to repeat.

    leaf is a hash of the piece's bytes and its anchor's place in them; n is 2 if the text has it more than once.
    """
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                b = whole.slice(i, 512)
                texts = [t.encode("utf-8", "surrogatepass") for t in b.column(2).to_pylist()]
                rows: list[list] = [[], [], [], [], []]  # row, anchor, leaf, n, place
                own: dict = {}
                spans = []

                def end(text: int) -> None:
                    for (anchor, leaf), (place, n) in own.items():  # noqa: B023
                        for column, v in zip(rows, (text, anchor, leaf, n, place), strict=True):  # noqa: B023
                            column.append(v)
                    for a, e in _merged(spans):  # noqa: B023
                        for at in range(a, e, LONGEST):
                            for column, v in zip(rows, (text, None, 0, 1, packed(at, min(e, at + LONGEST) - at)), strict=True):  # noqa: B023
                                column.append(v)

                last = -1
                for text, start, n, place, anchor in pieces(texts, least, kgram):
                    if text != last:
                        if last >= 0:
                            end(last)
                        last, own, spans = text, {}, []
                    key = anchor, xxhash.xxh3_64_intdigest(texts[text][start : start + n + least - 1], place) - (1 << 63)
                    if key in own:
                        first = own[key][0]
                        own[key] = first, 2
                        spans += [(first >> 21, (first >> 21) + n + least - 1), (start, start + n + least - 1)]
                    else:
                        own[key] = packed(start, place << 9 | n), 1
                if last >= 0:
                    end(last)
                at = pa.array(rows[0], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int32()), pa.array(rows[4], pa.int64()), b.column(0).take(at), b.column(1).take(at)], ["anchor", "leaf", "n", "place", "k", "th"])

    kind = dict(docs.dtypes)["k"]
    return docs.select("k", "th", "text").mapInArrow(run, f"anchor long, leaf long, n int, place long, k {kind}, th int")


def maximal_repeats(leaves: list[tuple[bytes, int]], least: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, occurrences (leaf, start)) of the maximal repeats among leaves (bytes, windows), by a stack scan of the LCP intervals.

    A leaf's first window has an unknown byte to its left, which counts as different from any other.
    """
    starts = [(i, p) for i, (_, n) in enumerate(leaves) for p in range(n)]
    suffixes = [leaves[i][0][p:] for i, p in starts]
    order = sorted(range(len(starts)), key=suffixes.__getitem__)

    def common(a: bytes, b: bytes) -> int:
        low, high = least, min(len(a), len(b))
        if a[:least] != b[:least]:
            return 0
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle - 1)
        return low

    def left(at: int):
        i, p = starts[at]
        return leaves[i][0][p - 1] if p else (i, -1)

    found, stack = [], []  # stack of open intervals: (lcp, first place in order)
    for r in range(1, len(order) + 1):
        lcp = common(suffixes[order[r - 1]], suffixes[order[r]]) if r < len(order) else 0
        begin = r - 1
        while stack and stack[-1][0] > lcp:
            length, begin = stack.pop()
            members = order[begin:r]
            if len({left(m) for m in members}) > 1:
                found.append((length, [starts[m] for m in members]))
        if lcp and (not stack or stack[-1][0] < lcp):
            stack.append((lcp, begin))
    return found


def _ranges(flags: list[bool] | bytearray) -> Iterator[tuple[int, int]]:
    """(first, last) of the runs of set flags."""
    at = None
    for i, x in enumerate([*flags, 0]):
        if x and at is None:
            at = i
        elif not x and at is not None:
            yield at, i - 1
            at = None


def search(leaves: DataFrame, least: int) -> DataFrame:
    """leaves(anchor, part, parts, leaf, n, place, k, th, bytes) -> (k, th, span, anchor, digest, windows).

    Rows with a null digest are spans that repeat within a part.  Others tell of an anchor in several parts: a run
    of different windows with the digest of what they have in common; windows is an array of (digest, n, span), n
    being 2 for a window that occurs here more than once.
    """
    import xxhash

    def bucket(rows: list[dict]) -> Iterator[tuple]:
        shapes = [_piece(r["place"]) for r in rows]
        texts = [(r["bytes"], windows) for r, (_, windows, _) in zip(rows, shapes, strict=True)]
        hit = [bytearray(n) for _, n in texts]
        for length, occurrences in maximal_repeats(texts, least):
            for i, p in occurrences:  # the repeat covers all windows from p on that lie inside it
                for x in range(p, min(p + length - least + 1, len(hit[i]))):
                    hit[i][x] = 1
        for r, flags, (start, _, _) in zip(rows, hit, shapes, strict=True):
            if r["n"] == 1:
                for a, b in _ranges(flags):
                    yield r["k"], r["th"], packed(start + a, b - a + least), None, None, None
        if rows[0]["parts"] > 1:
            told: dict[int, dict] = {}
            runs: dict[tuple[int, int], list[dict]] = {}
            for i, (r, flags, (start, windows, anchor)) in enumerate(zip(rows, hit, shapes, strict=True)):
                for p in range(windows):
                    digest = xxhash.xxh3_64_intdigest(r["bytes"][p : p + least], anchor - p) - (1 << 63)
                    if digest in told:
                        told[digest]["n"] = 2
                    else:
                        told[digest] = {"digest": digest, "n": 2 if flags[p] or r["n"] > 1 else 1, "span": packed(start + p, least)}
                        runs.setdefault((i, (anchor - p) // RUN), []).append(told[digest])
            for (i, run_), windows in runs.items():
                first = shapes[i][2] - RUN * run_  # of the run's last window; the first one ends RUN - 1 earlier
                common = xxhash.xxh3_64_intdigest(rows[i]["bytes"][first : first + least - RUN + 1], run_) - (1 << 63)
                yield rows[i]["k"], rows[i]["th"], None, rows[i]["anchor"], common, windows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k", "th", "span", "anchor", "digest", "windows"]
        held: list[dict] = []
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kinds[i]) for i in range(6)], names)
            out.clear()
            return batch

        kinds = [None, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("digest", pa.int64()), ("n", pa.int32()), ("span", pa.int64())]))]
        for b in batches:
            kinds[0] = b.schema.field("k").type
            for r in b.to_pylist():
                if held and (held[0]["anchor"], held[0]["part"]) != (r["anchor"], r["part"]):
                    out.extend(bucket(held))
                    held = []
                if held and held[-1]["leaf"] == r["leaf"]:
                    continue  # copies of a row ask alike: one of them serves
                held.append(r)
                if len(out) > 20_000:
                    yield flush()
        if held:
            out.extend(bucket(held))
        if out:
            yield flush()

    kind = dict(leaves.dtypes)["k"]
    dealt = leaves.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "leaf")
    return dealt.select("anchor", "part", "parts", "leaf", "n", "place", "k", "th", "bytes").mapInArrow(run, f"k {kind}, th int, span long, anchor long, digest long, windows array<struct<digest:long,n:int,span:long>>")


def _fetched(asked: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    """asked(anchor, part, parts, leaf, n, place, k, th) with the bytes of each piece, cut from docs(k, th, text)."""
    by_doc = asked.groupBy("k", "th").agg(F.collect_list(F.struct("anchor", "part", "parts", "leaf", "n", "place")).alias("asked"))
    met = _by_key(docs, by_doc, "inner")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 128):
                b = whole.slice(i, 128)
                lists = b.column(3)
                rows = lists.flatten()
                at = pa.array(np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy())), pa.int32())
                texts = [t.encode("utf-8", "surrogatepass") for t in b.column(2).to_pylist()]
                fields = dict(zip([f.name for f in rows.type], rows.flatten(), strict=True))
                cut = [texts[j][(p >> 21) : (p >> 21) + (p & 511) + least - 1] for j, p in zip(at.to_pylist(), fields["place"].to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([fields["anchor"], fields["part"], fields["parts"], fields["leaf"], fields["n"], fields["place"], b.column(0).take(at), b.column(1).take(at), pa.array(cut, pa.binary())], ["anchor", "part", "parts", "leaf", "n", "place", "k", "th", "bytes"])

    kind = dict(docs.dtypes)["k"]
    return met.mapInArrow(run, f"anchor long, part int, parts int, leaf long, n int, place long, k {kind}, th int, bytes binary")


def _by_key(docs: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """docs(k, th, text) joined with other(k, th, x) on a key that may be null."""
    renamed = other.withColumnRenamed("k", "__k").withColumnRenamed("th", "__th")
    return docs.join(renamed, docs["k"].eqNullSafe(renamed["__k"]) & (docs["th"] == renamed["__th"]), how).drop("__k", "__th")


def repeated_spans(docs: DataFrame, least: int = LEAST, kgram: int = KGRAM, leaves: int = LEAVES) -> DataFrame:
    """docs(k, th, text) -> (k, th, span): spans (start << 21 | length) that together cover all bytes of repeated windows."""
    read = stash(read_pieces(docs, least, kgram), "pieces")
    found = read.where("anchor is not null")
    counted = found.groupBy("anchor").agg(F.sum("n").alias("times"), F.min("leaf").alias("a"), F.max("leaf").alias("b")).where("times > 1").select("anchor", (F.col("a") != F.col("b")).alias("several"))
    again = stash(found.join(counted, "anchor"), "anchors")
    whole = F.shiftleft(F.shiftright("place", 21), 21) + (F.col("place").bitwiseAND(F.lit(511)) + least - 1)
    single = again.where("not several").select("k", "th", whole.alias("span"))

    several = again.where("several")
    least_place = F.min(F.struct("k", "th", "place")).alias("rep")
    forms = stash(several.groupBy("anchor", "leaf").agg(F.sum("n").cast("int").alias("n"), least_place).select("anchor", "leaf", "n", "rep.*"), "leaves")
    many = forms.groupBy("anchor").agg(F.ceil(F.count("*") / leaves).cast("int").alias("parts"))
    asked = forms.join(many, "anchor").withColumn("part", F.pmod(F.xxhash64("leaf"), F.col("parts")).cast("int"))
    copies = several.join(forms.where("n > 1").select("anchor", "leaf"), ["anchor", "leaf"]).select("k", "th", whole.alias("span"))
    told = stash(search(_fetched(asked, docs, least), least), "repeats")
    parts = told.where("digest is not null")
    runs = parts.groupBy("anchor", "digest").agg(F.count("*").alias("times")).where("times > 1").select("anchor", "digest")
    opened = parts.join(runs, ["anchor", "digest"]).select("k", "th", "anchor", F.explode("windows").alias("w")).select("k", "th", "anchor", "w.*")
    across = opened.groupBy("anchor", "digest").agg(F.sum("n").alias("times")).where("times > 1").select("anchor", "digest")
    met = opened.where("n = 1").join(across, ["anchor", "digest"]).select("k", "th", "span")
    known = read.where("anchor is null").select("k", "th", F.col("place").alias("span"))
    return known.unionByName(single).unionByName(copies).unionByName(told.where("digest is null").select("k", "th", "span")).unionByName(met)


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, kgram: int = KGRAM, leaves: int = LEAVES) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept) for each row of docs; kept (binary) is what remains of its UTF-8 bytes."""
    if not 0 < kgram <= least or kgram & (kgram - 1):
        raise ValueError("kgram must be a power of two, at most least")
    if least - kgram >= 511:
        raise ValueError("a window may have at most 511 places for its anchor")
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), text_or_empty(text).alias("text")).withColumn("th", F.pmod(F.xxhash64("text"), F.lit(2147483647)).cast("int"))
    rows = rows.select("k", "th", "text")
    spans = repeated_spans(rows, least, kgram, leaves).groupBy("k", "th").agg(F.collect_list("span").alias("spans"))
    met = _by_key(rows, spans, "left").select("k", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                out: list[list] = [[], [], [], []]
                for t, packed_spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    raw = t.encode("utf-8", "surrogatepass")
                    gone = _merged([(s >> 21, (s >> 21) + (s & (1 << 21) - 1)) for s in packed_spans or []])
                    edges = [0, *(x for s in gone for x in s), len(raw)]
                    for column, v in zip(out, (len(raw), sum(e - a for a, e in gone), len(gone), b"".join(raw[a:e] for a, e in zip(edges[::2], edges[1::2], strict=True))), strict=True):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.binary())], ["k", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = dict(rows.dtypes)["k"]
    return met.mapInArrow(run, f"k {kind}, n_bytes long, n_removed long, n_spans long, kept binary").withColumnRenamed("k", key)


def digests(docs: DataFrame, **options) -> DataFrame:
    return remove(docs, **options).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
