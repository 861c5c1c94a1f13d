"""Scores and grades against plain versions, and the whole pipeline on hard tables."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

import corpus_pipeline
from tidyroll.llm import lm_scoring, quality

from . import brute

SAMPLE = "/root/testdata/sf0.001"


def _texts():
    rng = random.Random(12)
    words = ["the", "The", "house", "hus", "né", "中文", "a.b", "%%", "x" * 40]
    prose = [" ".join(rng.choices(words, k=n)) for n in (1, 2, 30, 300, 4000)]
    return [None, "", " \n\t ", *prose, prose[2], prose[2], "one\x0bword\x1cagain", "THE house"]


@pytest.fixture
def tables(spark):
    """Nulls, empty texts, repeated rows and ids, ties, and columns named like results."""
    docs = [(i if i % 5 else None, t, i, "x") for i, t in enumerate(_texts())]
    docs += [(7, "the same id twice", 1, "y"), (7, "the same id twice", 1, "y"), (8, "again the house", 2, "z")]
    labels = [(3, 1, 0), (4, 0, 0), (6, 1, 1), (7, 1, 0), (7, 1, 0), (8, 1, 0), (8, 0, 0), (9, None, 0), (None, 1, 0), (11, 1, None), (99, 1, 0)]
    return (
        docs,
        labels,
        spark.createDataFrame(docs, "doc_id long, text string, score int, n_words string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def _bigram_losses(docs, labels, words, pairs):
    """Losses by dictionaries of cells."""
    lower = {c: c + 32 for c in range(65, 91)}

    def cells(text):
        found = [1 + xxhash.xxh64_intdigest(w) % (words - 1) for w in (text or "").translate(lower).encode().split()]
        before = [0, *found][: len(found)]
        return found, before, [(((b * words + c) * 0x9E3779B97F4A7C15 % 2**64) >> 32) % pairs for b, c in zip(before, found, strict=True)]

    good = {}
    for doc, q, t in labels:
        if doc is not None:
            flag = None if q is None or t is None else q == 1 and t == 0
            good.setdefault(doc, []).append(flag)
    target = {d for d, flags in good.items() if any(f is not None for f in flags) and all(f for f in flags if f is not None)}
    models = []
    for texts in ([t for d, t in docs if d in target], [t for _, t in docs]):
        one, two = Counter(), Counter()
        for text in texts:
            found, before, pair = cells(text)
            one.update(found)
            one.update(before[:1])
            two.update(pair)
        total = sum(n for c, n in one.items() if c) + lm_scoring.STRENGTH
        models.append((one, two, total))
    out = []
    for doc, text in docs:
        found, before, pair = cells(text)
        means = []
        for one, two, total in models:
            losses = []
            for c, b, p in zip(found, before, pair, strict=True):
                own = (one[c] + lm_scoring.STRENGTH / words) / total
                losses.append(-math.log((two[p] + lm_scoring.STRENGTH * own) / (max(one[b], two[p]) + lm_scoring.STRENGTH)))
            means.append(sum(losses) / len(losses) if losses else 0.0)
        out.append((doc, len(found), *means))
    return out


def test_scores_are_those_of_plain_bigram_models(tables):
    docs, labels, frame, rated = tables
    words, pairs = 1 << 10, 1 << 12
    found = lm_scoring.score(frame, rated, words, pairs, carry=frame.columns).collect()
    assert [r["row"].asDict() for r in found] == [dict(zip(frame.columns, d, strict=True)) for d in docs]
    expected = _bigram_losses([d[:2] for d in docs], labels, words, pairs)
    for row, (doc, n, target, background) in zip(found, expected, strict=True):
        assert (row["row"]["doc_id"], row["n_words"]) == (doc, n)
        assert row["target_loss"] == pytest.approx(target, abs=2e-5)
        assert row["background_loss"] == pytest.approx(background, abs=2e-5)
        assert row["score"] == pytest.approx(target - background, abs=4e-5)
    nothing = lm_scoring.score(frame, rated.limit(0), words, pairs).collect()
    assert len(nothing) == len(docs) and all(math.isfinite(r["score"]) for r in nothing)


def _likelihood(places, grades, weights, cuts):
    """Penalised mean loss, from the definition."""
    total = 0.0
    for at, grade in zip(places, grades, strict=True):
        score = float(sum(weights[i] for i in at))
        above = [1.0, *(1 / (1 + math.exp(c - score)) for c in cuts), 0.0]
        total -= math.log(above[grade] - above[grade + 1])
    return total / len(grades) + quality.RIDGE / 2 * float((weights.astype(float) ** 2).sum())


def test_the_fit_is_a_maximum_of_the_likelihood():
    rng = random.Random(3)
    places, grades = [], []
    for _ in range(400):
        grade = rng.choice([0, 1, 2, 2])
        own = {2 + grade} if rng.random() < 0.8 else {2 + rng.randrange(3)}
        places.append(np.array(sorted(own | {5 + rng.randrange(40)}), np.int32))
        grades.append(grade)
    grades = np.array(grades)
    values = [np.ones(len(p), np.float32) for p in places]
    weights, cuts = quality.fit_rows(places, values, grades, 64, 2000)
    assert set(np.flatnonzero(weights)) >= {2, 3, 4} and cuts[0] < cuts[1]
    best = _likelihood(places, grades, weights, cuts)
    used = np.flatnonzero(weights)
    for _ in range(40):
        moved, shifted = weights.astype(float), cuts.copy()
        if rng.random() < 0.7:
            moved[rng.choice(list(used))] += rng.choice([-0.05, 0.05])
        else:
            shifted[rng.randrange(2)] += rng.choice([-0.05, 0.05])
        assert _likelihood(places, grades, moved, shifted) > best - 1e-6


def test_grades_of_hard_rows(tables):
    docs, _, frame, rated = tables
    size = 1 << 8
    rng = np.random.default_rng(2)
    model = (rng.normal(size=size).astype(np.float32), np.array([-0.5, 0.7]))
    found = quality.score(frame, model, carry=frame.columns).collect()
    assert [r["row"].asDict() for r in found] == [dict(zip(frame.columns, d, strict=True)) for d in docs]
    features = quality.Features(size)
    for row in found:
        at, value = features.of((row["row"]["text"] or "").encode())
        score = sum(float(model[0][i]) * float(v) for i, v in zip(at, value, strict=True))
        tails = [1 / (1 + math.exp(c - score)) for c in model[1]]
        assert (row["p_1"], row["p_2"]) == pytest.approx(tails, abs=1e-5)
        assert row["expected_grade"] == pytest.approx(sum(tails), abs=1e-5) and row["keep"] == (row["p_2"] >= 0.5)
    empty = {r["p_2"] for r in found if not (r["row"]["text"] or "").split()}
    assert len(empty) == 1
    graded = rated.select(quality.grade(rated["quality"], rated["toxic"]).alias("g")).collect()
    assert [r["g"] for r in graded] == [2, 1, 0, 2, 2, 2, 1, None, 2, None, 2]
    weights, _ = quality.fit(frame, rated)
    assert len(weights) == quality.WEIGHTS and len(quality.classify(frame, rated).collect()) == len(docs)
    unrated = quality.classify(frame, rated.limit(0)).collect()
    assert len(unrated) == len(docs) and all(r["keep"] for r in unrated)


def test_grades_without_the_marks_of_repetition(spark, monkeypatch):
    """The words and shapes alone tell most of the grades apart; the two marks add to it."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    bare = model[0].copy()
    bare[-2:] = 0
    held = labels.where("doc_id % 2 = 1")
    kept = {}
    for name, weights in (("with", model[0]), ("without", bare)):
        scored = quality.score(docs, (weights, model[1])).selectExpr("row.doc_id", "keep").join(held, "doc_id")
        rows = scored.groupBy("toxic", "quality").agg({"keep": "count", "*": "count"}).collect()
        assert rows
        means = scored.selectExpr("toxic = 1 or quality = 0 as bad", "cast(keep as int) k").groupBy("bad").avg("k").collect()
        kept[name] = {r[0]: r[1] for r in means}
    assert kept["with"][False] > 0.98 and kept["without"][False] > 0.98
    assert kept["with"][True] <= kept["without"][True] < 0.6


def _brute_chain(spark, folder):
    """What the stages after the classifier should leave of what it keeps."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.quality_stage(spark, docs, folder).select("doc_id", "text").collect()
    rows = [(r["doc_id"], r["text"]) for r in kept]
    groups = brute.simhash(rows)
    # rows that share an id stand or fall together
    gone = {d for d, _, c in groups if d is not None and d != c} - {d for d, _, c in groups if d == c}
    rows = [r for r in rows if r[0] is None or r[0] not in gone]
    raw = [(t or "").encode() for _, t in rows]
    spans = brute.suffix_spans(raw, 400)
    cut = [bytes(b for b, g in zip(t, s, strict=True) if not g).decode(errors="ignore") for t, s in zip(raw, spans, strict=True)]
    rows = [(d, None if t is None else c) for (d, t), c in zip(rows, cut, strict=True)]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    clean = [r for r, found in zip(rows, brute.contamination(rows, items), strict=True) if not found[5]]
    return sorted(((d, n) for d, n, *_ in brute.byte_bpe(clean)), key=repr)


def test_the_pipeline_is_its_stages_on_the_sample(spark):
    found = corpus_pipeline.run(spark, SAMPLE)
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in found.collect()), key=repr) == _brute_chain(spark, SAMPLE)
    assert found.columns == ["doc_id", "n_tokens", "ids", "decoded"]


def test_the_pipeline_on_hard_tables(spark, tmp_path):
    rng = random.Random(4)
    passage = " ".join(f"w{i}" for i in range(120))
    prose = [" ".join(rng.choices(["the", "Of", "und", "x1"], k=n)) for n in (5, 60, 400)]
    texts = [None, None, "", " \n ", *prose, prose[1], f"a {passage} b", f"c d {passage}", f"{prose[2]} 中文", "eleven words of one benchmark item that is here for a test"]
    n = len(texts)
    ids = [*range(n - 2), 3, None]
    pq.write_table(
        pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.nulls(n, pa.string()), "source": pa.nulls(n, pa.string()),
                  "n_chars": pa.nulls(n, pa.int64()), "row": pa.array(range(n)), "hits": pa.array(["h"] * n), "keep": pa.nulls(n, pa.bool_())}),
        tmp_path / "documents.parquet",
    )
    pq.write_table(pa.table({"item_id": pa.array([1, None], pa.int64()), "text": pa.array([texts[-1], None], pa.string())}), tmp_path / "benchmark.parquet")
    labels = pa.table({"doc_id": pa.array([5, None], pa.int64()), "quality": pa.array([1, 0], pa.int32()), "toxic": pa.array([0, None], pa.int32())})
    pq.write_table(labels, tmp_path / "labels.parquet")
    folder = str(tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        assert step(spark, docs, folder).columns == docs.columns, name
    found = corpus_pipeline.run(spark, folder)
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in found.collect()), key=repr) == _brute_chain(spark, folder)


def test_a_pipeline_that_was_broken_off_goes_on(spark, tmp_path, monkeypatch):
    """Stages that were written aren't run again; one that broke off while writing is."""
    calls = []

    def stage(name, fail=False):
        def step(spark, docs, folder):
            calls.append(name)
            if fail:
                raise RuntimeError("lost")
            return docs.withColumn(name, docs["doc_id"])

        return name, step

    folder = str(tmp_path / "kept")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage("a"), stage("b", fail=True), stage("c")])
    with pytest.raises(RuntimeError, match="lost"):
        corpus_pipeline.run(spark, SAMPLE, folder)
    (tmp_path / "kept" / "1-b").mkdir()  # files of a write that didn't end
    (tmp_path / "kept" / "1-b" / "part-0.parquet").write_bytes(b"half")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [stage("a"), stage("b"), stage("c")])
    for _ in range(2):
        found = corpus_pipeline.run(spark, SAMPLE, folder)
        assert found.count() == 200 and {"a", "b", "c"} <= set(found.columns)
    assert calls == ["a", "b", "b", "c"]
