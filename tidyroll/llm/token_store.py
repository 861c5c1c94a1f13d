"""Token ids in files of directly addressable codes, with random access to any token.

The low eight bits of each id of a segment make the first level, the next eight bits of those
ids that have more the second, and so on. A bitmap beside each level tells which of its ids go
on, and a directory counts the set bits before each 512, so the place of an id in the next level
is a rank, and one id is read with a few bytes of each level and no decoding of its neighbours.

Files are a Parquet table that Spark writes and commits, so any store that Spark reaches can
hold them: a row is a segment of whole documents, `codes` its levels, and `doc_ids` and `lengths`
its directory. Shards follow each other in the order of doc_id; a second small table holds where
each shard begins.

Null and empty texts have only the end id. Null doc_ids come first. Rows that share a doc_id
follow each other in the order of a hash of their texts. An empty table gives an empty store.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pieces import PieceIds, Together, ragged
from .texts import chunks
from .worker import held

WORD, BLOCK = 8, 64  # bits of a chunk; bytes of a bitmap to one entry of its directory
_HEAD = struct.Struct("<4sQ")
_LEVEL = struct.Struct("<Q")
MAGIC = b"DAC1"
JOINED = 4096  # pieces in one string for the library
SEGMENTS = "shard int, first long, n_ids long, doc_ids array<long>, lengths array<long>, codes binary"


def pack(ids: np.ndarray) -> bytes:
    """The levels of unsigned 32-bit ids."""
    out = [_HEAD.pack(MAGIC, len(ids))]
    rest = ids.astype(np.uint32)
    while len(rest):
        more = rest > 255
        bitmap = np.packbits(more, bitorder="little")
        sums = np.add.reduceat(np.bitwise_count(bitmap).astype(np.int64), np.arange(0, len(bitmap), BLOCK))
        ranks = np.concatenate([[0], np.cumsum(sums)[:-1]]).astype("<u4")
        out += [_LEVEL.pack(len(rest)), rest.astype(np.uint8).tobytes(), bitmap.tobytes(), ranks.tobytes()]
        rest = rest[more] >> np.uint32(WORD)
    return b"".join(out)


class Codes:
    """Reads packed ids: any of them by place, or all."""

    def __init__(self, data: bytes):
        magic, self.size = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not packed ids")
        at, self.levels = _HEAD.size, []
        while at < len(data):
            (n,) = _LEVEL.unpack_from(data, at)
            at += _LEVEL.size
            bits = -(-n // 8)
            parts = []
            for kind, count in ((np.uint8, n), (np.uint8, bits), ("<u4", -(-bits // BLOCK))):
                part = np.frombuffer(data, kind, count, at)
                parts.append(part)
                at += part.nbytes
            self.levels.append(tuple(parts))

    def __getitem__(self, places: np.ndarray) -> np.ndarray:
        """The ids at some places: a chunk, a bit and a rank in each level, nothing else."""
        places = np.asarray(places, np.int64)
        if len(places) and (places.min() < 0 or places.max() >= self.size):
            raise IndexError("no such token")
        out = np.zeros(len(places), np.uint32)
        todo = np.arange(len(places))
        for depth, (low, bitmap, ranks) in enumerate(self.levels):
            out[todo] |= low[places].astype(np.uint32) << np.uint32(WORD * depth)
            byte = places >> 3
            more = (bitmap[byte] >> (places & 7).astype(np.uint8)) & 1 == 1
            todo, places, byte = todo[more], places[more], byte[more]
            if not len(todo):
                break
            block = byte // BLOCK
            window = block[:, None] * BLOCK + np.arange(BLOCK)
            before = np.where(window < byte[:, None], bitmap[np.minimum(window, len(bitmap) - 1)], 0)
            here = bitmap[byte] & ((1 << (places & 7)) - 1).astype(np.uint8)
            ones = np.bitwise_count(before).sum(axis=1, dtype=np.int64) + np.bitwise_count(here)
            places = ranks[block].astype(np.int64) + ones
        return out

    def all(self) -> np.ndarray:
        out = np.zeros(self.size, np.uint32)
        at = np.arange(self.size)
        for depth, (low, bitmap, _) in enumerate(self.levels):
            out[at] |= low.astype(np.uint32) << np.uint32(WORD * depth)
            at = at[np.unpackbits(bitmap, count=len(low), bitorder="little").astype(bool)]
        return out


def _library(path: str) -> PieceIds:
    def make() -> PieceIds:
        encode, special = _encoder(path)
        return PieceIds(encode, special=special)

    return held(("token_store", path), make)


def _encoder(path: str) -> tuple[Callable[[list[str]], tuple[np.ndarray, np.ndarray]], list[str]]:
    """Encodes pieces with the library; its special strings."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    sizes = np.zeros(tokenizer.get_vocab_size(), np.int64)
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        sizes[i] = len(token)  # a letter for each byte
    added = tokenizer.get_added_tokens_decoder()
    for i, token in added.items():
        sizes[i] = len(token.content.encode())

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Most pieces go to the library in long strings; their ids are told apart by the bytes
        that each id stands for."""
        todo = Together(texts)
        strings = ["".join(todo.parts[k : min(todo.alone, k + JOINED)]) for k in range(0, todo.alone, JOINED)]
        strings += todo.parts[todo.alone :]
        found = tokenizer.encode_batch_fast(strings, add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in found])
        starts, counts = todo.runs(sizes[ids], [len(p.encode()) for p in todo.parts])
        return ragged(ids, starts, counts), counts

    return encode, [token.content for token in added.values()]


def write(docs: DataFrame, tokenizer: str, end: int, path: str) -> None:
    """Encode whole texts with a byte-level tokenizer file and write them, in order of doc_id.

    `end` is appended to each document. Texts move once, to the range of ids they belong to.
    """
    spark = docs.sparkSession
    keys = ["doc_id", "tie"]
    frame = (
        docs.select("doc_id", F.col("text").cast("binary").alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .select("doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _library(tokenizer)
        shard, first = TaskContext.get().partitionId(), 0
        for batch in batches:
            for start, stop in chunks(batch.column(1)):
                ids, counts = memory.of(batch.column(1).slice(start, stop - start))
                flat = np.insert(ids, np.cumsum(counts), end)
                doc_ids = batch.column(0).slice(start, stop - start).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([shard], pa.int32()),
                        pa.array([first], pa.int64()),
                        pa.array([len(flat)], pa.int64()),
                        pa.array([doc_ids], pa.list_(pa.int64())),
                        pa.array([counts + 1], pa.list_(pa.int64())),
                        pa.array([pack(flat)], pa.binary()),
                    ],
                    names=["shard", "first", "n_ids", "doc_ids", "lengths", "codes"],
                )
                first += len(flat)

    frame.mapInArrow(run, SEGMENTS).write.parquet(f"{path}/segments")
    # one row for each shard, of which there are no more than partitions
    sizes = _segments(spark, path).groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()
    starts, total = [], 0
    for shard, n in sorted((r["shard"], r["n"]) for r in sizes):
        starts.append((shard, total, n))
        total += n
    schema = "shard int, shard_start long, shard_ids long"
    spark.createDataFrame(starts, schema).coalesce(1).write.parquet(f"{path}/shards")


def _segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENTS).parquet(f"{path}/segments")


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """Segments with `start`, the number of ids in the store before them."""
    shards = spark.read.schema("shard int, shard_start long").parquet(f"{path}/shards")
    return (
        _segments(spark, path)
        .join(F.broadcast(shards), "shard")  # one short row for each shard
        .withColumn("start", F.col("first") + F.col("shard_start"))
    )


def documents(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a store, read back: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = Codes(row["codes"]).all().astype("<u4")
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(starts + row["start"], pa.int64()),
                        pa.array(row["lengths"], pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    parts = _placed(spark, path).select("start", "doc_ids", "lengths", "codes")
    return parts.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokens_at(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """Ids at places (column `place`, from 0 over the whole store): place, token_id.

    Places meet their shard and then its segments, whose codes are read at those places only.
    Places outside the store have no row.
    """
    shards = spark.read.parquet(f"{path}/shards")
    inside = (F.col("place") >= F.col("shard_start")) & (
        F.col("place") < F.col("shard_start") + F.col("shard_ids")
    )
    wanted = places.select(F.col("place").cast("long")).join(F.broadcast(shards), inside)
    segments = _placed(spark, path)
    found = segments.select("shard", "start", "n_ids").join(wanted.select("shard", "place"), "shard")
    found = found.where((F.col("place") >= F.col("start")) & (F.col("place") < F.col("start") + F.col("n_ids")))
    lists = found.groupBy("start").agg(F.collect_list("place").alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = np.array(row["places"], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at), pa.array(Codes(row["codes"])[at - row["start"]], pa.int64())],
                    names=["place", "token_id"],
                )

    return lists.join(segments.select("start", "codes"), "start").mapInArrow(run, "place long, token_id long")
