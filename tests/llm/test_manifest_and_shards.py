"""Merkle manifests and shards: ties, nulls, hot keys, several ranges of rows."""

from __future__ import annotations

import random

import pyarrow.parquet as pq
import pytest

from tidyroll.llm import merkle, sharding
from tidyroll.llm import queries as Q
from tidyroll.operators import hot, numbering

from . import brute

SAMPLE = "/root/testdata/sf0.001"
FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def _ties():
    rng = random.Random(3)
    ids = [None, 0, -1, 5, 63, 64, 10**15, -(2**63), 2**63 - 1]
    sources = ["x", "Á", None, "", "big", "big", "big"]
    out = []
    for i in range(600):
        source = rng.choice([*sources, f"s{i}"])
        out.append((rng.choice([*ids, i, i]), source, rng.choice(["a", None, ""]), rng.choice([None, 3]), rng.choice(["AbC", "", None, "ÀB"])))
    return [*out, (1, "lone", None, None, "Z"), *[(9, "same", "l", 1, "q")] * 300]


def test_manifest_of_ties(spark, monkeypatch):
    """Repeated ids and rows, ids at the ends of their range, sources of one leaf."""
    docs = _ties()
    frame = spark.createDataFrame(docs, FIELDS)
    expected = sorted(brute.merkle(docs), key=repr)
    assert rows(merkle.digests(frame)) == expected
    monkeypatch.setattr(hot, "SHARE", 3)
    assert rows(merkle.digests(frame.repartition(7))) == expected


@pytest.mark.parametrize("count", [1, 2, 15, 16, 17, 256, 257])
def test_manifest_of_run_lengths(spark, count):
    docs = [(i * 1000, "s", None, i, "T") for i in range(count)]
    assert rows(merkle.digests(spark.createDataFrame(docs, FIELDS))) == sorted(brute.merkle(docs), key=repr)


def test_steps_prove_a_leaf(spark):
    found = merkle.manifest(spark.createDataFrame(_ties(), FIELDS)).where("verified").limit(20).collect()
    for row in found:
        node = row["leaf"]
        for step in row["steps"]:
            node = brute.sha((step["before"] + node + step["after"]).encode())
        assert node == row["root"]


def test_sample(spark):
    table = pq.read_table(f"{SAMPLE}/documents.parquet").to_pylist()
    docs = [tuple(r[c] for c in merkle.FIELDS) for r in table]
    assert rows(Q.build_manifest(spark, SAMPLE)) == sorted(brute.merkle(docs), key=repr)
    assert rows(Q.deal_shards(spark, SAMPLE)) == sorted(brute.sharding([(d[0], d[4]) for d in docs]), key=repr)


def test_loads_after_a_run_of_equal_groups():
    rng = random.Random(1)
    for _ in range(200):
        loads = [rng.randrange(2000) for _ in range(5)]
        size, count = rng.randrange(1, 40), rng.choice([0, 3, 100, 300, 1000])
        expected = list(loads)
        for _ in range(count):
            expected[min(range(5), key=lambda i: (expected[i], i))] += size
        assert sharding.deal(loads, size, count) == expected


def test_shards_of_copies(spark):
    """A group with a third of all rows, null and empty texts, repeated rows, null ids, several ranges."""
    rng = random.Random(6)
    docs = [(i, "w" * rng.randrange(1, 60)) for i in range(900)] + [(i, "copy") for i in range(2000, 2500)]
    docs += [(None, None), (3, None), (None, ""), (4, ""), *[(5, "twice")] * 2, (8, "é" * 4000)]
    rng.shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert rows(sharding.digests(frame)) == sorted(brute.sharding(docs), key=repr)
    found = sharding.shard(frame, 7).groupBy("shard").sum("size").collect()
    sizes = sorted(r[1] for r in found)
    assert len(sizes) == 7 and sizes[-1] - sizes[0] <= max(sum(len(t or "") + 1 for _, t in docs if t == x) for x in ("copy", "é" * 4000)) * 2


def test_written_shards_hold_all_columns(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i % 9}", i, i * 2) for i in range(50)], "doc_id long, text string, shard int, size int")
    sharding.write(docs, str(tmp_path / "shards"), 3)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert rows(back.select("row.*")) == rows(docs)
    assert [r[0] for r in back.groupBy("shard").count().select("shard").orderBy("shard").collect()] == [0, 1, 2]


def test_numbers_in_groups(spark):
    rng = random.Random(2)
    data = [(rng.choice("aab"), rng.randrange(50), rng.randrange(4)) for _ in range(500)]
    found = numbering.numbered(spark.createDataFrame(data, "g string, k int, w int"), ["k"], "before", ["g"], "w")
    assert {c.name for c in found.schema} == {"g", "k", "w", "before"}
    by_group = {}
    for r in found.collect():
        by_group.setdefault(r["g"], []).append((r["before"], r["k"], r["w"]))
    for members in by_group.values():
        total = 0
        members.sort(key=lambda m: (m[1], m[0], m[2]))
        assert sorted(m[0] for m in members) == [m[0] for m in members]
        for at, _, w in sorted(members, key=lambda m: (m[0], m[2])):
            assert at == total
            total += w
    assert numbering.numbered(spark.createDataFrame([], "g string, k int"), ["k"], "before").count() == 0
