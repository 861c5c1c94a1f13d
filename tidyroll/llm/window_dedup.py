"""Exact removal of repeated word windows by super-k-mers.

Every window of consecutive words has a minimiser, the least of its short word runs by a hash.
Windows that follow each other and share it make a super-k-mer. One whose minimiser occurs in no
other super-k-mer can't hold a repeated window and stays where it is; each other one travels as
one packed string, its words joined, to the bucket of its minimiser. Equal strings are one
before the shuffle, with their first place. In a bucket the windows of all strings are sorted,
and the first place of each distinct window is what is left: any other window of the travelling
super-k-mers repeats an earlier one, and its words go.

A bucket with too many distinct strings is dealt anew: its windows travel singly, to the place
of their own text, where equal ones are combined before the shuffle. So no group that a task
holds grows with the corpus.

"Earlier" is a smaller doc_id, or the same document and an earlier start; null doc_ids come
first, and rows that share a doc_id are in the order of a hash of their texts. Rows with the same
doc_id and text are one document, and each of them gets its result. Null and empty texts, and
texts of fewer words than a window, keep all their words. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyroll.operators.hot import counted_join
from tidyroll.operators.staging import release, stage

from .texts import chunks

#: Words of a window and of the runs among which its minimiser is.
WINDOW, RUN = 20, 8
#: Distinct strings of a bucket that one task sorts.
BUCKET = 2048
#: Low bits of a hash that give way to the place of its run, so that the least is the leftmost.
PLACE_BITS = 28
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return (x ^ (x >> np.uint64(29))) * _FACTOR


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def super_kmers(hashes: np.ndarray, window: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser, first window and number of windows of each super-k-mer of a text.

    A super-k-mer's windows share the place of their minimiser, the leftmost of equal ones.
    """
    n = len(hashes) - window + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    size = len(hashes) - run + 1
    runs = np.zeros(size, np.uint64)
    for i in range(run):
        runs = _mixed(runs + hashes[i : i + size])
    place = np.uint64((1 << PLACE_BITS) - 1)
    least = leftmost_least((runs & ~place) | np.arange(size, dtype=np.uint64), window - run + 1)
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    return runs[least[first] & place].view(np.int64), first, np.diff(np.append(first, n))


def leftmost_least(values: np.ndarray, span: int) -> np.ndarray:
    """The least of each `span` values that follow each other, by doubling."""
    width = 1
    while width < span:
        step = min(width, span - width)
        values = np.minimum(values[: len(values) - step], values[step:])
        width += step
    return values


def _documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    raw = F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b""))
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(raw).alias("tie"), raw.alias("text"))


def _candidates(texts: DataFrame, window: int, run: int) -> DataFrame:
    """Super-k-mers whose minimiser is in another one too: doc_id, tie, places (start, count).

    Only numbers travel here. Equal minimisers are counted before the shuffle.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in chunks(batch.column(2)):
                part = batch.slice(start, end - start)
                found = []
                for text in part.column(2).to_pylist():
                    found.append(super_kmers(word_hashes(text.split()), window, run))
                at = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
                keys, firsts, counts = (np.concatenate([f[i] for f in found]) for i in range(3))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys),
                        part.column(0).take(pa.array(at)),
                        part.column(1).take(pa.array(at)),
                        pa.array((firsts << 20) | counts),
                    ],
                    names=["key", "doc_id", "tie", "place"],
                )

    rows = stage(texts.mapInArrow(cut, "key long, doc_id long, tie long, place long"), "minimisers")
    shared = stage(rows.groupBy("key").count().where("count > 1"), "shared")
    kept = counted_join(rows, shared, "key", "count", rows.count(), "left_semi")
    found = stage(kept.groupBy("doc_id", "tie").agg(F.collect_set("place").alias("places")), "candidates")
    release(texts.sparkSession, rows, shared)
    return found


def _packed(texts: DataFrame, candidates: DataFrame, window: int, run: int) -> DataFrame:
    """Candidates as strings: key, words (joined), doc_id, tie, start; distinct, with first places."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in chunks(batch.column(2)):
                part = batch.slice(begin, end - begin)
                at, keys, words, starts = [], [], [], []
                for i, (text, places) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    split = text.split()
                    key, first, _ = super_kmers(word_hashes(split), window, run)
                    for place in places:
                        start, count = place >> 20, place & ((1 << 20) - 1)
                        at.append(i)
                        starts.append(start)
                        words.append(b" ".join(split[start : start + count + window - 1]))
                    keys.append(key[np.searchsorted(first, [p >> 20 for p in places])])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(keys)),
                        pa.array(words, pa.binary()),
                        part.column(0).take(pa.array(at, pa.int64())),
                        part.column(1).take(pa.array(at, pa.int64())),
                        pa.array(starts, pa.int64()),
                    ],
                    names=["key", "words", "doc_id", "tie", "start"],
                )

    # repeated rows of one document meet here once
    owned = texts.join(candidates, _same(texts, candidates)).select(
        texts["doc_id"], texts["tie"], texts["text"], candidates["places"]
    )
    rows = owned.mapInArrow(pack, "key long, words binary, doc_id long, tie long, start long")
    return rows.groupBy("key", "words").agg(F.min(F.struct("doc_id", "tie", "start")).alias("first"))


def _same(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["tie"] == b["tie"])


FIRSTS = "doc_id long, tie long, start long"


def _small_buckets(packed: DataFrame, window: int) -> DataFrame:
    """First places of the distinct windows of each bucket."""

    def firsts(group: list[tuple[bytes, dict]]) -> Iterator[tuple]:
        rows = []
        for words, first in group:
            split = words.split(b" ")
            doc, tie, start = first["doc_id"], first["tie"], first["start"]
            order = (doc is not None, doc or 0)  # null ids first
            for k in range(len(split) - window + 1):
                rows.append((b" ".join(split[k : k + window]), order, tie, start + k))
        rows.sort()
        last = None
        for text, (known, doc), tie, start in rows:
            if text != last:
                yield doc if known else None, tie, start
            last = text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, dict]] = []
        key = None
        for batch in batches:
            out: list[tuple] = []
            for k, words, first in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if k != key:
                    out += firsts(held)
                    held, key = [], k
                held.append((words, first))
            yield _places(out)
        yield _places(list(firsts(held)))

    sorted_rows = packed.repartition("key").sortWithinPartitions("key").select("key", "words", "first")
    return sorted_rows.mapInArrow(run, FIRSTS)


def _places(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["doc_id", "tie", "start"])


def _single_windows(packed: DataFrame, window: int) -> DataFrame:
    """The same for windows that travel singly: equal ones are combined before the shuffle."""
    words = F.split(F.col("words").cast("string"), " ")
    each = packed.select(words.alias("w"), "first").select(
        F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - window + 1), lambda i: F.array_join(F.slice("w", i, window), " "))),
        "w", "first",
    )
    place = F.struct("first.doc_id", "first.tie", (F.col("first.start") + F.col("pos")).alias("start"))
    return each.groupBy("col").agg(F.min(place).alias("p")).select("p.doc_id", "p.tie", "p.start")


def first_windows(packed: DataFrame, window: int) -> DataFrame:
    """First places of all distinct windows of the packed strings."""
    large = stage(packed.groupBy("key").count().where(F.col("count") > BUCKET), "large")
    total = packed.count()
    small = _small_buckets(counted_join(packed, large, "key", "count", total, "left_anti"), window)
    return small.unionByName(_single_windows(counted_join(packed, large, "key", "count", total, "left_semi"), window))


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, run: int = RUN, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """Whole documents without repeated windows: doc_id, n_words, n_removed, kept (words joined)."""
    return _results(docs, window, run, text, doc_id, False)


def digests(
    docs: DataFrame, window: int = WINDOW, run: int = RUN, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """As `remove_repeats`, with kept_sha256 in place of the kept words."""
    return _results(docs, window, run, text, doc_id, True)


def _results(docs: DataFrame, window: int, run: int, text: str, doc_id: str, digest: bool) -> DataFrame:
    texts = _documents(docs, doc_id, text)
    candidates = _candidates(texts, window, run)
    packed = stage(_packed(texts, candidates, window, run), "packed")
    found = stage(first_windows(packed, window).groupBy("doc_id", "tie").agg(F.collect_list("start").alias("firsts")), "firsts")
    release(docs.sparkSession, packed)
    marks = candidates.join(found, _same(candidates, found), "left").select(
        candidates["doc_id"], candidates["tie"], "places", "firsts"
    )
    # the windows that go, as runs
    marked = texts.join(marks, _same(texts, marks), "left").select(texts["doc_id"], texts["text"], "places", "firsts")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in chunks(batch.column(1)):
                part = batch.slice(begin, end - begin)
                total, removed, kept = [], [], []
                for raw, places, firsts in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    words = raw.split()
                    gone = _gone(len(words), places, firsts, window)
                    left = words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    total.append(len(words))
                    removed.append(len(words) - len(left))
                    joined = b" ".join(left)
                    kept.append(hashlib.sha256(joined).hexdigest() if digest else joined.decode(errors="replace"))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                    names=["doc_id", "n_words", "n_removed", name],
                )

    name = "kept_sha256" if digest else "kept"
    return marked.mapInArrow(clean, f"doc_id long, n_words long, n_removed long, {name} string")


def _gone(n: int, places: list[int] | None, firsts: list[int] | None, window: int) -> np.ndarray | None:
    """Which of n words lie in a window that isn't the first of its text."""
    if not places:
        return None
    repeated = np.zeros(n, bool)
    for place in places:
        repeated[place >> 20 : (place >> 20) + (place & ((1 << 20) - 1))] = True
    repeated[firsts or []] = False
    edges = np.zeros(n + window + 1, np.int64)
    starts = np.flatnonzero(repeated)
    if not len(starts):
        return None
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return np.cumsum(edges)[:n] > 0
