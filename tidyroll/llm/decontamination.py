"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark items.

Texts and items are lower-cased in A-Z and cut into words (runs of digits, letters and any
non-ASCII characters), which are joined by single spaces. Each window of consecutive item words
is a pattern with a space at both ends, so it can only match whole words. A text is scanned once;
the places of matches become word numbers, and those byte offsets in the original text.

The automaton holds the windows of items of a bounded total size. A larger benchmark is dealt
into several blocks by a hash of the window, and texts are scanned once for each; what each scan
finds is carried along in the rows, so no case needs a shuffle.

Null texts and items have no words; items without words have no window; an item with fewer words
than a window is one window itself. Repeated items count once by their id; windows of an item
without an id hit words, but no id is listed. Rows of documents that are repeated each get their
result. An empty benchmark hits nothing; empty documents give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyroll.operators.staging import stage

from .texts import chunks
from .worker import held

#: Words of a window, and bytes of the windows in one automaton.
WINDOW = 10
AUTOMATON_BYTES = 32 << 20

_LOWER = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 32
    for c in range(256)
)
HITS = "array<struct<first:int,last:int,items:array<long>>>"


def normalise(text: bytes) -> bytes:
    """The words of a text, each with one space before it, and a space at the end."""
    words = text.translate(_LOWER).split()
    return b" " + b" ".join(words) + b" " if words else b""


def word_offsets(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word starts and ends in the original bytes."""
    inside = np.frombuffer(text.translate(_LOWER), np.uint8) != 32
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def windows(benchmark: DataFrame, size: int = WINDOW, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows of the items: pattern, items (sorted distinct ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, patterns = [], []
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = normalise(raw or b"").split()
                for k in range(max(len(words) - size + 1, min(1, len(words)))):
                    ids.append(i)
                    patterns.append(b" " + b" ".join(words[k : k + size]) + b" ")
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(patterns, pa.binary())], names=["item", "pattern"]
            )

    items = benchmark.select(
        F.col(f"`{item}`").cast("long").alias("item"), F.col(f"`{text}`").cast("binary").alias("text")
    )
    found = items.mapInArrow(run, "item long, pattern binary")
    return found.groupBy("pattern").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _automaton(shared) -> tuple[ahocorasick.Automaton, list[list[int]]]:
    """Built once in a Python worker, from patterns that were sent to it."""

    def make() -> tuple[ahocorasick.Automaton, list[list[int]]]:
        automaton = ahocorasick.Automaton()
        for i, (pattern, _) in enumerate(shared.value):
            automaton.add_word(pattern.decode("latin-1"), (i, pattern.count(b" ") - 1))
        automaton.make_automaton()
        return automaton, [items for _, items in shared.value]

    return held(("decontamination", shared), make)


def _scan(docs: DataFrame, patterns: list[tuple[bytes, list[int]]]) -> DataFrame:
    """One more block of patterns: what it finds is added to the column `hits`."""
    shared = docs.sparkSession.sparkContext.broadcast(patterns)
    hits = pa.list_(
        pa.struct([("first", pa.int32()), ("last", pa.int32()), ("items", pa.list_(pa.int64()))])
    )

    def one(text: bytes | None, automaton, items) -> tuple[int, list[dict]]:
        norm = normalise(text or b"")
        if not norm:
            return 0, []
        spaces = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
        found = [(end, *what) for end, what in automaton.iter(norm.decode("latin-1"))] if items else []
        if not found:
            return len(spaces) - 1, []
        last = np.searchsorted(spaces, [e for e, _, _ in found]) - 1
        return len(spaces) - 1, [
            {"first": int(w) - n + 1, "last": int(w), "items": items[i]}
            for w, (_, i, n) in zip(last, found, strict=True)
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, items = _automaton(shared)
        for batch in batches:
            rows, texts, before = (batch.column(i) for i in range(3))
            for start, end in chunks(texts):
                part = texts.slice(start, end - start)
                found = [one(t, automaton, items) for t in part.to_pylist()]
                old = before.slice(start, end - start).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.slice(start, end - start),
                        part,
                        pa.array([o + h for o, (_, h) in zip(old, found, strict=True)], hits),
                        pa.array([n for n, _ in found], pa.int64()),
                    ],
                    names=["row", "text", "hits", "n_words"],
                )

    schema = T.StructType([docs.schema["row"], *T.StructType.fromDDL(f"text binary, hits {HITS}, n_words long")])
    return docs.select("row", "text", "hits").mapInArrow(run, schema)


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = WINDOW,
    text: str = "text",
    carry: Sequence[str] = ("doc_id",),
    automaton_bytes: int = AUTOMATON_BYTES,
) -> DataFrame:
    """Occurrences of item windows in whole texts.

    Gives row (struct of `carry`), text (bytes), n_words, and hits: first and last word of each
    occurrence, and the items with that window.
    """
    spark = docs.sparkSession
    found = stage(windows(benchmark, size), "windows")
    # the size is known before any pattern comes to the driver, one bounded block at a time
    total = found.agg(F.sum(F.length("pattern") + 8 * F.size("items") + 64)).first()[0] or 0
    blocks = 1 + total // automaton_bytes
    out = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"),
        F.col(f"`{text}`").cast("binary").alias("text"),
        F.array().cast(HITS).alias("hits"),
    )
    for block in range(blocks):
        mine = found.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == block)
        patterns = [(bytes(r["pattern"]), r["items"]) for r in mine.collect()]
        if block:
            out = stage(out, "scanned")
        out = _scan(out, patterns)
    return out.select("row", "text", "n_words", "hits")


def hit_words(hits: Column) -> Column:
    """How many words lie in any occurrence; occurrences are ordered and swept once."""
    ordered = F.array_sort(F.transform(hits, lambda h: F.struct(h["first"], h["last"])))
    start = F.struct(F.lit(-1).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, h: Column) -> Column:
        new = F.greatest(F.lit(0), h["last"] - F.greatest(acc["end"], h["first"] - 1))
        return F.struct(
            F.greatest(acc["end"], h["last"]).alias("end"), (acc["n"] + new).cast("long").alias("n")
        )

    return F.aggregate(ordered, start, add, lambda acc: acc["n"])


def item_ids(hits: Column) -> Column:
    """Distinct ids of the items with occurring windows, sorted as strings."""
    ids = F.array_distinct(F.flatten(F.transform(hits, lambda h: h["items"])))
    return F.array_sort(F.transform(ids, lambda i: i.cast("string")))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, **options) -> DataFrame:
    """For each document: row, n_words, n_hit, items (ids as sorted strings), contaminated."""
    found = scan(docs, benchmark, size, **options)
    return found.select(
        "row",
        "n_words",
        hit_words(F.col("hits")).alias("n_hit"),
        item_ids(F.col("hits")).alias("items"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def spans(found: DataFrame) -> DataFrame:
    """Occurrences of `scan` in the original texts: row, items, byte_start, byte_end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, items, starts, ends = [], [], [], []
            for i, (raw, hits) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if hits:
                    begin, stop = word_offsets(raw)
                    for h in hits:
                        at.append(i)
                        items.append(h["items"])
                        starts.append(int(begin[h["first"]]))
                        ends.append(int(stop[h["last"]]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at, pa.int64())),
                    pa.array(items, pa.list_(pa.int64())),
                    pa.array(starts, pa.int64()),
                    pa.array(ends, pa.int64()),
                ],
                names=["row", "items", "byte_start", "byte_end"],
            )

    fields = "items array<long>, byte_start long, byte_end long"
    schema = T.StructType([found.schema["row"], *T.StructType.fromDDL(fields)])
    return found.select("row", "text", "hits").mapInArrow(run, schema)
