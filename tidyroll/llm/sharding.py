"""Shards of near equal size, of groups that must stay together: longest processing time first.

Rows with equal texts are a group. Groups sorted by size, the largest first, go one after another to
the shard with the least load, which a heap gives; ties go to the lower shard. So no shard is larger
than the mean by more than its last group, and a group that is larger than the mean is alone.

The order of all groups is a range sort. Where a range of it begins, the loads of the shards follow
from how many groups of each size come before: a run of groups of one size raises the loads by
numbers that need no walk through the run. One task reads these counts (of n bytes there can't be
more than about sqrt(2 n) different sizes) and gives the loads at the start of each range; the ranges
then run their heaps beside each other and deal as one heap over all groups would.

Slots number the rows of a shard from 0, by doc_id (nulls first). The size of a row is the bytes of
its text plus 1. A null text has no bytes, a checksum of 0, and is a group with all other null texts;
an empty text is not null and has its own group. Rows that share a doc_id each have a place, next to
each other where their texts are equal too, and repeated rows differ by their slot alone. An empty
table gives an empty result. Very long texts are read once, by Spark's own hash functions, and don't
travel; neither do columns that aren't carried, and carried ones come back in the struct `row`, where
they can't clash with the results.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyroll.operators.hot import counted_join
from tidyroll.operators.numbering import numbered
from tidyroll.operators.staging import stage


SHARDS = 16
#: A run of more groups than this isn't walked through.
WALK = 256


def deal(loads: list[int], size: int, count: int) -> list[int]:
    """Loads after `count` groups of one size went to the least loaded shard each."""
    loads = list(loads)
    if count > WALK:
        # below some level every shard takes all groups that it would begin there
        low, high = min(loads), min(loads) + size * count + 1
        while high - low > 1:
            level = (low + high) // 2
            if sum(max(0, -(-(level - x) // size)) for x in loads) <= count:
                low = level
            else:
                high = level
        taken = [max(0, -(-(low - x) // size)) for x in loads]
        loads = [x + n * size for x, n in zip(loads, taken, strict=True)]
        count -= sum(taken)
    heap = [(x, i) for i, x in enumerate(loads)]
    heapq.heapify(heap)
    for _ in range(count):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
    return [x for x, _ in sorted(heap, key=lambda h: h[1])]


def assign(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shards of groups (columns key, which is unique, and bytes, at least 1): the columns of
    `groups` with `shard`."""
    order = [F.desc("bytes"), F.asc("key")]
    ranges = groups.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    ranges = stage(ranges, "ranges")

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loads, last = [0] * shards, None
        for batch in batches:
            firsts = []
            for part, size, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != last:
                    firsts.append((part, loads))
                    last = part
                loads = deal(loads, size, n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in firsts], pa.int32()), pa.array([x for _, x in firsts], pa.list_(pa.int64()))],
                names=["part", "loads"],
            )

    runs = ranges.groupBy("__range", "bytes").agg(F.count("*").alias("n"))
    runs = runs.repartition(1).sortWithinPartitions("__range", F.desc("bytes"))
    # a row for each range
    starts = dict(runs.mapInArrow(begin, "part int, loads array<long>").collect())

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap, last = [], None
        for batch in batches:
            out = []
            parts, sizes = (batch.column(c).to_pylist() for c in ("__range", "bytes"))
            for part, size in zip(parts, sizes, strict=True):
                if part != last:
                    heap = [(load, shard) for shard, load in enumerate(starts[part])]
                    heapq.heapify(heap)
                    last = part
                load, shard = heap[0]
                heapq.heapreplace(heap, (load + size, shard))
                out.append(shard)
            yield batch.append_column("shard", pa.array(out, pa.int32()))

    inside = ranges.repartition("__range").sortWithinPartitions("__range", *order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranges.schema) + ", shard int"
    return inside.mapInArrow(spread, schema).drop("__range")


def shard(
    docs: DataFrame, shards: int = SHARDS, text: str = "text", carry: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """The place of each row: row (struct of `carry`), size, text_crc32, shard, slot."""
    raw = F.col(f"`{text}`").cast("binary")
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"),
        F.col("doc_id").alias("__id"),
        F.coalesce(F.unhex(F.sha2(raw, 256)), F.lit(b"")).alias("key"),
        (F.coalesce(F.octet_length(raw), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
    )
    rows = stage(rows, "sized")
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    dealt = stage(assign(groups, shards).select("key", "n", "shard"), "dealt")
    total = dealt.agg(F.sum("n")).first()[0] or 0
    placed = counted_join(rows, dealt, "key", "n", total)
    placed = numbered(placed, [F.asc_nulls_first("__id"), "key"], "slot", group=["shard"])
    return placed.select("row", "size", "text_crc32", "shard", "slot")


def write(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write all columns of `docs` (in `row`), with size and slot, in a folder for each shard.

    A shard is many files, each a range of slots in order.
    """
    placed = shard(docs, shards, carry=docs.columns)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digests(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `bytes`: sizes near equal. One shard more would move groups between the others, so
    `grown_shard` is null.
    """
    return shard(docs, shards).select(
        "row.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
