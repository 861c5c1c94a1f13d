"""Removal of long repeated byte strings by distributed prefix doubling on sampled suffixes.

A suffix array that is sorted only as far as a threshold, by prefix doubling: positions get ranks
for longer and longer strings from pairs of the rank that they have and the rank of what follows,
and leave once their rank is unique or the threshold is reached. Ranks of every byte would be
some twenty bytes of shuffle for each byte of text and round, so the suffixes are sampled and the
positions that share a sample go through the rounds together:

1. Each window of `threshold` bytes has an anchor, the position in its first part with the least
   hash of the bytes there, which is the same wherever the window occurs. Anchors are ranked by
   the string that all their windows share. Unique ones leave.
2. An anchor's windows are cut into slices of a few neighbours, and ranked by the pair of the
   anchor's rank and the longer string that the slice's windows share. Unique ones leave. A slice
   whose whole text occurs twice is settled: all its windows are repeated.
3. What is left are slices at the ends of repeats. Their windows, of full length, are ranked one
   by one, one instance of each distinct slice, against those of the slices of the same rank.

Spark shuffles only ranks and positions, and combines equal ranks before each shuffle, so a string
that a third of all documents share is no hot group. A rank is named by a digest of its string:
names of windows and whole slices have 128 bits.

Null and empty texts, and those shorter than the threshold, have no windows and stay whole. Each
row is a document of its own, so rows that are repeated are copies of each other and go as far as
they are long enough. Null doc_ids are allowed. Matches never cross documents. Empty tables give
empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyroll.operators.hot import counted_join
from tidyroll.operators.staging import release, stage

from .texts import chunks
from .window_dedup import PLACE_BITS, leftmost_least

THRESHOLD = 400
#: Bytes that an anchor's hash covers, and windows of a slice.
GRAM, SLICE = 24, 23
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)
_BYTES = (np.arange(1, 257, dtype=np.uint64) * np.uint64(_FACTORS[0])) ^ np.uint64(_FACTORS[1])


def _reach(threshold: int) -> int:
    """How far before its anchor a window may start."""
    return max(0, (threshold - GRAM) * 7 // 15)


def _grams(raw: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each position."""
    h = _BYTES[raw]
    parts = {1: h}
    for i, width in enumerate((1, 2, 4, 8)):
        h = h[: len(h) - width] * np.uint64(_FACTORS[i]) + h[width:]
        parts[2 * width] = h
    eight, sixteen = parts[8], parts[16]
    h = sixteen[: len(sixteen) - 8] * np.uint64(_FACTORS[4]) + eight[16:]
    return (h ^ (h >> np.uint64(31))) * np.uint64(_FACTORS[0])


def anchors(text: bytes, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a text: position, first window and number of windows of each."""
    n = len(text) - threshold + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    reach = _reach(threshold)
    grams = _grams(np.frombuffer(text, np.uint8)[: n + reach + GRAM - 1])
    place = np.uint64((1 << PLACE_BITS) - 1)
    least = leftmost_least((grams & ~place) | np.arange(len(grams), dtype=np.uint64), reach + 1)
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    return (least[first] & place).astype(np.int64), first, np.diff(np.append(first, n))


def _documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    raw = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(raw).alias("tie"), raw.alias("text"))


def _same(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["tie"] == b["tie"])


def _first_round(texts: DataFrame, threshold: int) -> DataFrame:
    """Anchors whose shared string isn't unique, by document: doc_id, tie, places."""
    core = threshold - _reach(threshold)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for start, end in chunks(batch.column(2)):
                part = batch.slice(start, end - start)
                names, places, sizes = [], [], []
                for text in part.column(2).to_pylist():
                    at, _, _ = anchors(text, threshold)
                    names += [digest(text[a : a + core]) for a in at.tolist()]
                    places.append(at)
                    sizes.append(len(at))
                rows = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.array(names, np.uint64).view(np.int64)),
                        part.column(0).take(rows),
                        part.column(1).take(rows),
                        pa.array(np.concatenate(places)),
                    ],
                    names=["rank", "doc_id", "tie", "place"],
                )

    ranked = stage(texts.mapInArrow(rank, "rank long, doc_id long, tie long, place long"), "ranked")
    shared = stage(ranked.groupBy("rank").count().where("count > 1"), "shared")
    kept = counted_join(ranked, shared, "rank", "count", ranked.count(), "left_semi")
    return kept.groupBy("doc_id", "tie").agg(F.collect_set("place").alias("places"))


def _second_round(texts: DataFrame, first: DataFrame, threshold: int) -> DataFrame:
    """Slices of those anchors: rank (of what its windows share), whole (its text), and place."""
    shared_size = threshold - SLICE + 1

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, name = xxhash.xxh3_64_intdigest, xxhash.xxh3_128_digest
        for batch in batches:
            for start, end in chunks(batch.column(2)):
                part = batch.slice(start, end - start)
                at, ranks, wholes, places = [], [], [], []
                for i, (text, kept) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    position, window, count = anchors(text, threshold)
                    for k in np.searchsorted(position, kept).tolist():
                        a, s, n = int(position[k]), int(window[k]), int(count[k])
                        # by distance before the anchor, so that copies are cut alike
                        far, near = a - s, a - s - n + 1
                        for t in range(near // SLICE, far // SLICE + 1):
                            low, high = max(near, t * SLICE), min(far, t * SLICE + SLICE - 1)
                            begin = a - t * SLICE
                            at.append(i)
                            ranks.append(digest(text[begin : begin + shared_size], t))
                            wholes.append(name(text[a - high : a - low + threshold], high))
                            places.append((a - high) << 8 | (high - low + 1))
                rows = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.array(ranks, np.uint64).view(np.int64)),
                        pa.array(wholes, pa.binary()),
                        part.column(0).take(rows),
                        part.column(1).take(rows),
                        pa.array(places, pa.int64()),
                    ],
                    names=["rank", "whole", "doc_id", "tie", "place"],
                )

    owned = texts.join(first, _same(texts, first)).select(texts["doc_id"], texts["tie"], "text", "places")
    return owned.mapInArrow(rank, "rank long, whole binary, doc_id long, tie long, place long")


def _last_round(texts: DataFrame, open_slices: DataFrame, threshold: int) -> DataFrame:
    """Repeated windows of slices, one instance of each: whole, mask (a bit for each window)."""

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = xxhash.xxh3_128_digest
        for batch in batches:
            for start, end in chunks(batch.column(0)):
                part = batch.slice(start, end - start)
                wholes, windows, names = [], [], []
                for text, slices in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for one in slices:
                        s, n = one["place"] >> 8, one["place"] & 255
                        wholes += [one["whole"]] * n
                        windows += range(n)
                        names += [name(text[s + i : s + i + threshold]) for i in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.binary()), pa.array(wholes, pa.binary()), pa.array(windows, pa.int32())],
                    names=["name", "whole", "window"],
                )

    by_text = open_slices.groupBy("doc_id", "tie").agg(F.collect_list(F.struct("whole", "place")).alias("slices"))
    once = texts.join(by_text, _same(texts, by_text)).select(texts["doc_id"], texts["tie"], "text", "slices")
    windows = stage(once.select("text", "slices").mapInArrow(rank, "name binary, whole binary, window int"), "ends")
    # a window is in a slice once, so more than one slice of another text has to hold it
    slice_of = F.xxhash64("whole")
    held = windows.groupBy("name").agg(F.min(slice_of).alias("a"), F.max(slice_of).alias("b"), F.count("*").alias("n"))
    shared = stage(held.where("a <> b").select("name", "n"), "shared")
    found = counted_join(windows, shared, "name", "n", windows.count(), "left_semi")
    return found.groupBy("whole").agg(F.bit_or(F.expr("shiftleft(1L, window)")).alias("mask"))


def _repeats(texts: DataFrame, threshold: int) -> DataFrame:
    """Repeated windows of each document: doc_id, tie, windows (start << 8 | count, mask)."""
    spark = texts.sparkSession
    first = stage(_first_round(texts, threshold), "anchors")
    slices = stage(_second_round(texts, first, threshold), "slices")
    release(spark, first)
    distinct = slices.groupBy("rank", "whole").agg(
        F.count("*").alias("n"), F.max(F.struct("doc_id", "tie", "place")).alias("at")
    )
    distinct = stage(distinct, "distinct")
    # a rank with slices of several texts, one of which occurs once, has windows to tell apart
    ranks = distinct.groupBy("rank").agg(F.count("*").alias("texts"), F.min("n").alias("least"))
    open_ranks = stage(ranks.where("texts > 1 and least = 1").select("rank", "texts"), "open")
    open_slices = counted_join(distinct, open_ranks, "rank", "texts", distinct.count(), "left_semi").select("whole", "at.*")
    masks = stage(_last_round(texts, open_slices, threshold), "masks")
    settled = distinct.where("n > 1").select("whole", F.lit((1 << SLICE) - 1).cast("long").alias("mask"), "n")
    single = distinct.where("n = 1").select("whole", "n").join(masks, "whole").select("whole", "mask", "n")
    known = stage(settled.unionByName(single), "known")
    found = counted_join(slices, known, "whole", "n", slices.count())
    out = found.groupBy("doc_id", "tie").agg(F.collect_set(F.struct("place", "mask")).alias("windows"))
    out = stage(out, "windows")
    release(spark, slices, distinct, open_ranks, masks, known)
    return out


def _covered(size: int, windows: list[dict] | None, threshold: int) -> np.ndarray | None:
    """Which bytes of a text lie in a repeated window."""
    if not windows:
        return None
    place = np.array([w["place"] for w in windows], np.int64)
    mask = np.array([w["mask"] for w in windows], np.int64)
    bits = (mask[:, None] >> np.arange(SLICE)) & (np.arange(SLICE) < (place & 255)[:, None])
    row, offset = np.nonzero(bits)
    starts = (place >> 8)[row] + offset
    edges = np.zeros(size + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + threshold, -1)
    return np.cumsum(edges)[:size] > 0


def remove_repeats(
    docs: DataFrame, threshold: int = THRESHOLD, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """Whole documents without repeated strings: doc_id, n_bytes, n_removed, n_spans, kept (bytes)."""
    return _results(docs, threshold, text, doc_id, False)


def digests(docs: DataFrame, threshold: int = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """As `remove_repeats`, with kept_sha256 in place of the kept bytes."""
    return _results(docs, threshold, text, doc_id, True)


def cleaned(docs: DataFrame, threshold: int = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents with all their columns, and what is left of their texts.

    A character that a cut splits goes as a whole; null texts become empty. A column n_chars is
    brought up to date.
    """
    others = [c for c in docs.columns if c != text]
    texts = _documents(docs, doc_id, text)
    found = _repeats(texts, threshold)
    raw = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.xxhash64(raw).alias("tie"),
        raw.alias("text"),
        F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in others)).alias("row"),
    )
    marked = rows.join(found, _same(rows, found), "left").select("row", "text", "windows")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in chunks(batch.column(1)):
                part = batch.slice(start, end - start)
                kept = []
                for raw, windows in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    gone = _covered(len(raw), windows, threshold)
                    left = raw if gone is None else np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    kept.append(left.decode(errors="ignore"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.string())], names=["row", "kept"])

    out = marked.mapInArrow(cut, T.StructType([marked.schema["row"], T.StructField("kept", T.StringType())]))
    columns = {c: F.col(f"row.`{c}`") for c in others} | {text: F.col("kept")}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return out.select(*(columns[c].alias(c) for c in docs.columns))


def _results(docs: DataFrame, threshold: int, text: str, doc_id: str, digest: bool) -> DataFrame:
    texts = _documents(docs, doc_id, text)
    found = _repeats(texts, threshold)
    marked = texts.join(found, _same(texts, found), "left").select(texts["doc_id"], "text", "windows")
    name, kind = ("kept_sha256", "string") if digest else ("kept", "binary")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in chunks(batch.column(1)):
                part = batch.slice(start, end - start)
                total, removed, spans, kept = [], [], [], []
                for raw, windows in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    gone = _covered(len(raw), windows, threshold)
                    left = raw
                    if gone is not None and gone.any():
                        left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                        spans.append(int((np.diff(gone.view(np.int8), prepend=0) == 1).sum()))
                    else:
                        spans.append(0)
                    total.append(len(raw))
                    removed.append(len(raw) - len(left))
                    kept.append(hashlib.sha256(left).hexdigest() if digest else left)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(total, pa.int64()),
                        pa.array(removed, pa.int64()),
                        pa.array(spans, pa.int64()),
                        pa.array(kept, pa.string() if digest else pa.binary()),
                    ],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", name],
                )

    return marked.mapInArrow(cut, f"doc_id long, n_bytes long, n_removed long, n_spans long, {name} {kind}")
