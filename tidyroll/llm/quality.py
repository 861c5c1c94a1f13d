"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document's words and their shapes (case, digits, marks) are hashed to one vector of shared
weights, whose product is the document's place on one scale; ordered thresholds cut the scale into
grades. The chance of a grade of at least k is the logistic of the distance to the k-th threshold.
The model is fitted by maximum likelihood with a ridge penalty, on a sample of labelled rows whose
size is a parameter, in one Spark task; features of that sample are made where the texts are.

Null and empty texts, and texts of white space, have no features and get the chances of the
thresholds alone. Labels that are null have no grade. Repeated label rows count as often as they
occur in the sample; repeated documents are scored alike. With no labels at all every document has
the highest grade. Empty documents give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyroll.operators.staging import release, stage

from .texts import per_text
from .worker import Words, held

#: Hashed weights, labelled rows that are fitted at most, and steps of the fit.
WEIGHTS, SAMPLE, STEPS = 1 << 18, 20_000, 400
RIDGE, RATE, RARE = 1e-4, 0.1, 3
#: Standard errors that a feature's share has to differ by between grades to get a weight.
CHANCE = 4.5
#: Share of a text's words that have a shape, for it to be a feature.
OFTEN = 0.02
GRADES = 3
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_SHAPE = bytes(
    0x78 if 0x61 <= c <= 0x7A or c >= 0x80 else 0x58 if 0x41 <= c <= 0x5A else 0x39 if 0x30 <= c <= 0x39 else c
    for c in range(256)
)
_RUNS = re.compile(rb"(.)\1+", re.DOTALL)
_MARKED = re.compile(rb"([!-/:-@\[-`{-~])\1")
_MARKS = bytes(c for c in range(128) if not chr(c).isalnum())


def grade(quality: Column, toxic: Column) -> Column:
    """Graded rating of a label: 0 toxic, 1 of low quality, 2 good; null where it isn't told."""
    return F.when(toxic == 1, 0).when(quality == 0, 1).when((quality == 1) & (toxic == 0), 2)


class Features:
    """Hashed features of texts: words, frequent word shapes, and two marks of repetition."""

    def __init__(self, size: int):
        self.size = size
        self.known = Words(lambda words: map(self._places, words))

    def _places(self, word: bytes) -> int:
        core = word.translate(_LOWER).strip(_MARKS)
        shape = b"marks" if _MARKED.search(word) else _RUNS.sub(rb"\1\1", word.translate(_SHAPE)[:32])
        half = self.size // 2
        a = xxhash.xxh64_intdigest(core, 1) % half if core else half - 1
        return a << 32 | (half + xxhash.xxh64_intdigest(shape, 2) % (half - 2))

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places and values of a text's features."""
        words = text.split()
        self.known.learn(set(words))
        both = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        cores = np.unique(both >> 32)
        shapes, counts = np.unique(both & 0xFFFFFFFF, return_counts=True)
        shapes = shapes[counts >= OFTEN * len(words)]
        # words that repeat the one before, and few words said often
        same = int((both[1:] == both[:-1]).sum()) >= 0.1 * max(5, len(words))
        few = len(cores) <= 0.4 * len(words) and len(words) >= 20
        marks = [self.size - 1] * same + [self.size - 2] * few
        places = np.unique(np.concatenate([cores, shapes, np.array(marks, np.int64)]))
        return places.astype(np.int32), np.ones(len(places), np.float32)


def chances(scores: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """For each score, the chance of a grade of at least 1, 2, ..."""
    return 1 / (1 + np.exp(np.clip(thresholds[None, :] - scores[:, None], -50, 50)))


def _telling(at: np.ndarray, row_grades: np.ndarray, grades: np.ndarray, size: int) -> np.ndarray:
    """Which features are in the documents of some grade more or less often than chance allows.

    Among many thousand words some always lean to a grade in the sample; weights for those
    would only blur the scores of other documents.
    """
    held = np.bincount(at, minlength=size)
    share = held / len(grades)
    telling = np.zeros(size, bool)
    for g in np.unique(grades):
        inside = int((grades == g).sum())
        outside = max(1, len(grades) - inside)
        here = np.bincount(at[row_grades == g], minlength=size)
        gap = here / inside - (held - here) / outside
        spread = np.sqrt(share * (1 - share) * (1 / inside + 1 / outside)) + 1e-12
        telling |= np.abs(gap) / spread > CHANCE
    # what most documents have is left to the thresholds, so that a text without features is ordinary
    return telling & (held >= RARE) & (share < 0.5)


def fit_rows(places: list[np.ndarray], values: list[np.ndarray], grades: np.ndarray, size: int = WEIGHTS, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by full-batch Adam on the penalised likelihood."""
    top = GRADES - 1
    if not len(grades):
        return np.zeros(size, np.float32), np.full(top, -50.0)
    share = np.cumsum(np.bincount(grades, minlength=GRADES) + 1.0)[:-1] / (len(grades) + GRADES)
    thresholds = np.log(share / (1 - share))
    at, value = np.concatenate(places), np.concatenate(values).astype(np.float64)
    row = np.repeat(np.arange(len(places)), [len(p) for p in places])
    used = _telling(at, grades[row], grades, size)[at]
    names, at = np.unique(at[used], return_inverse=True)
    value, row = value[used], row[used]
    params = np.concatenate([np.zeros(len(names)), thresholds[:1], np.log(np.maximum(np.diff(thresholds), 1e-3))])
    n, count = len(names), len(places)
    mean, var = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        cuts = np.cumsum(np.concatenate([params[n : n + 1], np.exp(params[n + 1 :])]))
        score = np.bincount(row, value * params[:n][at], minlength=count)
        cdf = np.concatenate([np.zeros((count, 1)), 1 - chances(score, cuts), np.ones((count, 1))], axis=1)
        i = np.arange(count)
        high, low = cdf[i, grades + 1], cdf[i, grades]
        chance = np.maximum(high - low, 1e-12)
        up, down = high * (1 - high), low * (1 - low)
        slope = (up - down) / chance / count  # of the loss in the score
        cut = np.zeros((count, top + 2))
        cut[i, grades + 1] -= up / chance / count
        cut[i, grades] += down / chance / count
        by_cut = cut[:, 1:-1].sum(axis=0)
        tail = np.cumsum(by_cut[::-1])[::-1]
        grad = np.concatenate(
            [np.bincount(at, value * slope[row], minlength=n) + RIDGE * params[:n], tail[:1], tail[1:] * np.exp(params[n + 1 :])]
        )
        mean = 0.9 * mean + 0.1 * grad
        var = 0.999 * var + 0.001 * grad**2
        params -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.999**step)) + 1e-9)
    weights = np.zeros(size, np.float32)
    weights[names] = params[:n]
    return weights, np.cumsum(np.concatenate([params[n : n + 1], np.exp(params[n + 1 :])]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, size: int = WEIGHTS, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Fit on at most `sample` labelled rows: those of the least hashed doc_ids, so that the choice
    depends on no order. Labels hold doc_id, quality and toxic."""
    graded = labels.select("doc_id", grade(F.col("quality"), F.col("toxic")).alias("grade")).where(
        "doc_id is not null and grade is not null"
    )
    chosen = graded.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)
    spark = docs.sparkSession
    chosen = stage(chosen.repartition(1), "labelled")  # no more than `sample` short rows, so it can be broadcast
    rated = docs.select("doc_id", F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen), "doc_id")

    def make():
        features = _features(size)

        def process(texts):
            found = [features.of(t or b"") for t in texts]
            return (
                pa.array([p for p, _ in found], pa.list_(pa.int32())),
                pa.array([v for _, v in found], pa.list_(pa.float32())),
            )

        return process

    made = per_text(rated, "places array<int>, amounts array<float>", make, carry=("doc_id", "grade"))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_numpy(zero_copy_only=False) for c in b.columns), strict=True)]
        rows = rows[:sample]  # a doc_id that several documents share
        grades = np.array([r[0] for r in rows], np.int64)
        weights, cuts = fit_rows([r[1] for r in rows], [r[2] for r in rows], grades, size)
        yield pa.RecordBatch.from_arrays(
            [pa.array([weights.tobytes()], pa.binary()), pa.array([cuts.tolist()], pa.list_(pa.float64()))],
            names=["weights", "cuts"],
        )

    ordered = made.select(F.col("row.grade").alias("grade"), "places", "amounts", F.col("row.doc_id").alias("doc_id"))
    ordered = ordered.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample).select("grade", "places", "amounts")
    model = ordered.coalesce(1).mapInArrow(train, "weights binary, cuts array<double>").first()
    release(spark, chosen)
    if model is None:
        return fit_rows([], [], np.empty(0, np.int64), size)
    return np.frombuffer(bytes(model["weights"]), np.float32), np.array(model["cuts"])


def _features(size: int) -> Features:
    """Kept by a Python worker, from the fit to the scores."""
    return held(("quality", size), lambda: Features(size))


def score(
    docs: DataFrame,
    model: tuple[np.ndarray, np.ndarray],
    least: float = 0.5,
    text: str = "text",
    carry: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Grades of whole texts: row, expected_grade, p_1 and p_2 (chances of at least that grade), keep.

    A document is kept where the chance of the highest grade is at least `least`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as many numbers as weights

    def make():
        weights, cuts = shared.value
        features = _features(len(weights))

        def process(texts):
            scores = np.zeros(len(texts))
            for i, t in enumerate(texts):
                at, value = features.of(t or b"")
                scores[i] = weights[at] @ value
            tails = chances(scores, cuts)
            return (
                pa.array(tails.sum(axis=1)),
                pa.array(tails[:, 0]),
                pa.array(tails[:, 1]),
                pa.array(tails[:, 1] >= least),
            )

        return process

    return per_text(docs, "expected_grade double, p_1 double, p_2 double, keep boolean", make, text, carry)


def classify(docs: DataFrame, labels: DataFrame, least: float = 0.5, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Fit on the labels and score all documents."""
    return score(docs, fit(docs, labels), least, carry=carry)
