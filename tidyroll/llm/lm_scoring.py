"""Cross-entropy difference of a target and a background bigram model.

Both models share one vocabulary, a table of hashed words, and one table of hashed word pairs, and
the same smoothing: the chance of a word after another mixes the pair's share with the word's own.
The target model counts documents that are labelled good, the background model counts every
document. A document's score is the mean over its words of the target's loss less the
background's: the lower, the more it is like the target.

Counts cover all documents and all words; each task adds up its own counts before the shuffle. The
tables have a fixed number of cells, a parameter, so the model that all tasks get has a proven
size at any size of the corpus.

Null and empty texts, and texts of white space, have no words and a score of zero. Labels that are
null, and documents without a label, aren't in the target. Repeated rows count as often as they
occur. With an empty target, or empty documents, the loss of the target is that of its smoothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyroll.operators.staging import stage

from .texts import chunks, per_text
from .worker import Words, held

#: Cells for words and for pairs, and how many words the smoothing counts for.
WORDS, PAIRS, STRENGTH = 1 << 18, 1 << 21, 20.0
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Cells:
    """The cells of the words of texts, and of their pairs with the word before."""

    def __init__(self, words: int = WORDS, pairs: int = PAIRS):
        self.words, self.pairs = words, pairs
        self.known = Words(lambda found: (1 + xxhash.xxh64_intdigest(w) % (self.words - 1) for w in found))

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word: its cell, the cell of the word before it (the first of all stands for
        the start of a text), and the cell of the pair, behind those of the words."""
        words = text.translate(_LOWER).split()
        self.known.learn(set(words))
        cells = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        before = np.concatenate([np.zeros(min(1, len(cells)), np.int64), cells[:-1]])
        mixed = (before.astype(np.uint64) * np.uint64(self.words) + cells.astype(np.uint64)) * _FACTOR
        return cells, before, ((mixed >> np.uint64(32)) % np.uint64(self.pairs)).astype(np.int64) + self.words


def counts(docs: DataFrame, labels: DataFrame, words: int = WORDS, pairs: int = PAIRS) -> DataFrame:
    """Counts of each cell in all documents and in the target: cell, n, n_target."""
    good = (
        labels.where("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.min(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("good"))
        .where("good = 1")
    )
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    # one plan at every size: texts meet the labels by a shuffle
    marked = texts.join(good.hint("merge"), "doc_id", "left").select("text", F.col("good").isNotNull().alias("good"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells(words, pairs)
        sums = np.zeros((2, words + pairs), np.int64)
        for batch in batches:
            for start, end in chunks(batch.column(0)):
                part = batch.slice(start, end - start)
                flags = part.column(1).to_pylist()
                both: list[list[np.ndarray]] = [[], []]
                for text, flag in zip(part.column(0).to_pylist(), flags, strict=True):
                    cell, before, pair = cells.of(text or b"")
                    both[flag].extend([cell, before[:1], pair])
                for flag in (0, 1):
                    if both[flag]:
                        sums[flag] += np.bincount(np.concatenate(both[flag]), minlength=words + pairs)
        sums[0] += sums[1]
        held = np.flatnonzero(sums[0])
        for k in range(0, len(held), 1 << 16):
            some = held[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some), pa.array(sums[0][some]), pa.array(sums[1][some])], names=["cell", "n", "n_target"]
            )

    parts = marked.mapInArrow(count, "cell long, n long, n_target long")
    return parts.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))


class Model:
    """Losses of words with the counts of one or the other column of the table."""

    def __init__(self, table: np.ndarray, words: int):
        self.table, self.words = table.astype(np.float32), words
        self.totals = table[:, 1:words].sum(axis=1) + STRENGTH

    def losses(self, which: int, cell: np.ndarray, before: np.ndarray, pair: np.ndarray) -> np.ndarray:
        table = self.table[which]
        own = (table[cell] + STRENGTH / self.words) / self.totals[which]
        return -np.log((table[pair] + STRENGTH * own) / (np.maximum(table[before], table[pair]) + STRENGTH))


def _shared(model) -> tuple[Model, Cells]:
    """Kept by a Python worker for its next tasks."""

    def make() -> tuple[Model, Cells]:
        table, words = model.value
        return Model(table, words), Cells(words, table.shape[1] - words)

    return held(("lm_scoring", model), make)


def score(
    docs: DataFrame, labels: DataFrame, words: int = WORDS, pairs: int = PAIRS, carry: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """Scores of whole documents: row, n_words, target_loss, background_loss, score (means)."""
    spark = docs.sparkSession
    found = stage(counts(docs, labels, words, pairs), "counts")
    table = np.zeros((2, words + pairs), np.int64)
    for batch in found.toArrow().to_batches():  # a row for each cell at most
        cell = batch.column("cell").to_numpy()
        table[0, cell], table[1, cell] = batch.column("n").to_numpy(), batch.column("n_target").to_numpy()
    shared = spark.sparkContext.broadcast((table, words))

    def make():
        model, cells = _shared(shared)

        def process(texts):
            out = np.zeros((len(texts), 2))
            sizes = np.zeros(len(texts), np.int64)
            for i, text in enumerate(texts):
                at = cells.of(text or b"")
                sizes[i] = len(at[0])
                if sizes[i]:
                    out[i] = [model.losses(k, *at).mean() for k in (1, 0)]
            return pa.array(sizes), pa.array(out[:, 0]), pa.array(out[:, 1]), pa.array(out[:, 0] - out[:, 1])

        return process

    fields = "n_words long, target_loss double, background_loss double, score double"
    return per_text(docs, fields, make, carry=carry)
