"""Alignment of two tokenizers against a plain version: hard texts, chunks, forgetting, empty tables."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow.parquet as pq
import pytest

from tidyroll.llm import alignment
from tidyroll.llm import queries as Q

from . import brute

SAMPLE = "/root/testdata/sf0.001"
PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ALPHABET = [
    " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "  \n ", "a", "Wort", "é", "e\u0301", "中", "…", "\u2581", "<0x41>", "<s>", "</s>",
    "<unk>", "<|endoftext|>", ".", ",", "'s", "12", "\0", "\x1c", "\x85", "\u3000", "🙂", "ﬁ", "Ａ", "İ",
]


def rows(df):
    return sorted((tuple(r) for r in df.select("row.doc_id", *COLUMNS[1:]).collect()), key=repr)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(9)
    out = [(i, "".join(rng.choices(ALPHABET, k=rng.randrange(14)))) for i in range(500)]
    passage = " ".join(rng.choices(["the", "Haus", "and", "x1"], k=3000))
    return [*out, (None, None), (7, None), (8, ""), (9, passage), (9, passage), (10, "a" * 3000), (11, "中" * 2000), *[(i, "copy of it") for i in range(600, 800)]]


def test_hard_texts_in_chunks(spark, docs, monkeypatch):
    expected = sorted(brute.alignment(docs), key=repr)
    assert any(r[1] == 0 and t for r, (_, t) in zip(brute.alignment(docs), docs, strict=True))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert rows(alignment.align(frame.repartition(3), *PATHS)) == expected


def test_sample(spark):
    table = pq.read_table(f"{SAMPLE}/documents.parquet")
    docs = list(zip(table["doc_id"].to_pylist(), table["text"].to_pylist(), strict=True))
    found = Q.align_tokenizers(spark, SAMPLE).select(*COLUMNS)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(brute.alignment(docs), key=repr)


def test_forgotten_pieces_change_nothing(docs, monkeypatch):
    texts = [t and t.encode() for _, t in docs]
    sides = alignment.Sides(*PATHS)

    def numbers():
        aligned = alignment.Aligned(sides)
        out = []
        for k in range(0, len(texts), 50):
            at, counts = aligned.documents(texts[k : k + 50])
            out += [tuple(r) for r in alignment._by_text(aligned.numbers[at], counts).tolist()]
        return out

    expected = numbers()
    monkeypatch.setattr(alignment, "REMEMBERED", 1000)
    monkeypatch.setattr(alignment, "BATCH", 7)
    assert numbers() == expected
    sides.cuts = False  # texts whole
    assert numbers() == expected


def test_overlaps_are_all_pairs():
    rng = np.random.default_rng(1)
    frames = [[], []]
    at = 0
    for doc in range(40):
        size = int(rng.integers(1, 30))
        for side in frames:
            cuts = sorted({0, *rng.integers(0, size, 6).tolist()})
            side += [(doc, at + a, at + b) for a, b in zip(cuts, [*cuts[1:], size], strict=True)]
        at += size
    a, b = (pd.DataFrame(side, columns=["doc", "start", "end"]) for side in frames)
    found = alignment.overlaps(a, b)
    expected = [(i, j) for i, x in enumerate(frames[0]) for j, y in enumerate(frames[1]) if x[1] < y[2] and y[1] < x[2]]
    assert list(zip(found["a"].tolist(), found["b"].tolist(), strict=True)) == expected


def test_groups_and_clashing_columns(spark):
    frame = spark.createDataFrame([(1, "Hi there", "x", 5)], "doc_id long, text string, chunk string, pairs int")
    found = alignment.groups(frame, *PATHS, carry=frame.columns).first()
    assert found["row"] == frame.first() and brute.sha(found["groups"].encode()) == brute.alignment([(1, "Hi there")])[0][-1]
    whole = alignment.align(frame, *PATHS, carry=frame.columns).first()
    assert whole["row"] == frame.first() and whole["n_a"] > 0
    assert alignment.align(frame.limit(0), *PATHS).count() == 0


def test_counts_are_those_of_the_corpus(spark):
    docs = [(1, "the house"), (2, "the the"), (3, None)]
    found = alignment.pair_counts(alignment.aligned_chunks(spark.createDataFrame(docs, "doc_id long, text string"), *PATHS))
    links = sum(r[4] for r in brute.alignment(docs))
    assert sum(r["count"] for r in found.collect()) == links and found.where("best").count() >= 1


def test_long_text_is_a_chunk(spark, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 1000)
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices(["one", "zwei", "drei,", "fünf"], k=n))) for i, n in enumerate([3, 40000, 2, 0, 500])]
    assert rows(alignment.align(spark.createDataFrame(docs, "doc_id long, text string"), *PATHS)) == sorted(brute.alignment(docs), key=repr)
