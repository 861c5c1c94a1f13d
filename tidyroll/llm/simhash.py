"""SimHash near-duplicates: fingerprints, links within some bits, and their components.

Equal fingerprints are one node. The bits are cut into one block more than the distance, so two
fingerprints within it agree in a block; each fingerprint goes to the bucket of each of its block
values. A bucket with too many members is dealt anew by blocks of its other bits, of which the
same holds, until buckets are small: no bucket is ever larger than one task can hold, and no pair
is lost.

Within a task, the members of a bucket are in the order of their Gray rank, in which neighbours
share most bits. Runs of eight members make nodes, runs of eight nodes the nodes above, up to one
root for each bucket. A node keeps the bits that all its members share and that no node above
keeps; a search goes down from the root, adds up the differences in those bits, and drops a node
with all its members once the sum is over the distance. A task hands on a spanning forest of the
links it finds instead of all pairs.

Null and empty texts, and texts of white space, have the fingerprint zero and are linked like any
other. Rows that share a doc_id are rows of their own with the same id; a null doc_id is never the
least, and a component without any id has none. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyroll.operators.components import components
from tidyroll.operators.hot import counted_join
from tidyroll.operators.staging import release, stage

from .texts import per_text

BITS, SEED = 64, 42
#: Members of a run under one node, and the largest bucket of one task.
FAN, BUCKET = 8, 4096
#: Members are searched together up to so many pairs that they could make.
PAIRS = 1 << 20
SHINGLES = 1 << 15

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def fingerprint(text: bytes, size: int) -> int:
    """Majority of the bits of the shingles' XXH64; zero without words."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - size + 1)
    last = ends[min(size, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    sums = np.zeros(BITS, np.int64)
    for k in range(0, n, SHINGLES):
        cut = zip(starts[k : min(n, k + SHINGLES)].tolist(), last[k : k + SHINGLES].tolist(), strict=False)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in cut], "<u8")
        sums += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * sums > n))


def fingerprints(
    docs: DataFrame, shingle: int = 3, text: str = "text", carry: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """The fingerprint of each whole text: row (struct of `carry`), fp (64 bits in a long)."""

    def make():
        def process(texts):
            found = np.array([fingerprint(t or b"", shingle) for t in texts], np.uint64)
            return (pa.array(found.view(np.int64)),)

        return process

    return per_text(docs, "fp long", make, text, carry)


def gray_rank(fp: Column) -> Column:
    """The place of a fingerprint in the reflected Gray code, signed as longs are."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def _blocks(free: int, distance: int) -> list[int]:
    """A mask for each of distance + 1 blocks of the free bits."""
    places = [i for i in range(BITS) if free >> i & 1]
    count = min(len(places), distance + 1)
    return [sum(1 << p for p in places[k * len(places) // count : (k + 1) * len(places) // count]) for k in range(count)]


def _signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def _buckets(members: DataFrame, distance: int) -> Iterator[DataFrame]:
    """Frames of path, key, fp whose groups (path, key) have at most BUCKET members.

    `path` names the blocks in which the members of a group agree, `key` their bits there.
    """
    masks = {"": 0}  # of the bits that are agreed on
    while masks:
        steps: list[tuple[str, int]] = []
        for path, agreed in masks.items():
            free = (1 << BITS) - 1 & ~agreed
            steps += [(f"{path}{i}", agreed | block) for i, block in enumerate(_blocks(free, distance))]
        if not steps:
            return
        parent = F.col("path") if "path" in members.columns else F.lit("")
        ways = F.create_map(*(x for p, _ in steps for x in (F.lit(p), F.lit(_signed(dict(steps)[p])))))
        dealt = members.select(
            parent.alias("parent"), "fp", F.explode(F.array(*(F.lit(str(i)) for i in range(distance + 1)))).alias("way")
        ).select(F.concat("parent", "way").alias("path"), "fp")
        dealt = dealt.withColumn("key", F.col("fp").bitwiseAND(ways[F.col("path")])).where("key is not null")
        sizes = dealt.groupBy("path", "key").count()
        large = stage(sizes.where(F.col("count") > max(BUCKET, 2 << distance)).drop("count"), "large")
        paths = [r["path"] for r in large.select("path").distinct().collect()]  # of a few block choices
        if not paths:
            yield dealt
            return
        small = dealt.join(large, ["path", "key"], "left_anti")
        yield small.select("path", "key", "fp")
        members = stage(dealt.join(large, ["path", "key"], "left_semi").select("path", "fp").distinct(), "members")
        masks = {p: m for p, m in steps if p in paths and m != (1 << BITS) - 1}


def _levels(group: np.ndarray, fps: np.ndarray) -> list[dict[str, np.ndarray]]:
    """Nodes of each level from the members up; a root for each group.

    start, end: a node's children in the level below. keep: the bits that its members share,
    without those of the node above. bits: their values. last: the last member below it.
    """
    count = len(fps)
    all_bits = np.full(count, ~np.uint64(0))
    levels = [{"group": group, "shared": all_bits, "bits": fps, "last": np.arange(count)}]
    while True:
        below = levels[-1]
        first = np.flatnonzero(np.diff(below["group"], prepend=-1))
        sizes = np.diff(np.append(first, len(below["group"])))
        if len(levels) > 1 and (sizes == 1).all():
            break
        within = np.arange(len(below["group"])) - np.repeat(first, sizes)
        start = np.flatnonzero(within % FAN == 0)
        end = np.append(start[1:], len(within))
        ones = np.bitwise_and.reduceat(below["bits"] & below["shared"], start)
        zeros = np.bitwise_and.reduceat(~below["bits"] & below["shared"], start)
        levels.append({"group": below["group"][start], "shared": ones | zeros, "bits": ones, "start": start, "end": end, "last": below["last"][end - 1]})
    for below, above in zip(levels, levels[1:], strict=False):
        up = np.repeat(np.arange(len(above["start"])), above["end"] - above["start"])
        below["keep"] = below["shared"] & ~above["shared"][up]
    levels[-1]["keep"] = levels[-1]["shared"]
    return levels


def _links(group: np.ndarray, fps: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members of a group within the distance, the second behind the first."""
    levels = _levels(group, fps)
    roots = levels[-1]["group"]
    root_of = np.searchsorted(roots, group)
    sizes = np.bincount(root_of)
    parts = np.cumsum(sizes[root_of]) // PAIRS
    bounds = np.append(np.flatnonzero(np.diff(parts, prepend=-1)), len(fps))
    for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        query = np.arange(start, end)
        node = root_of[query]
        total = np.bitwise_count((fps[query] ^ levels[-1]["bits"][node]) & levels[-1]["keep"][node])
        for above, below in zip(levels[:0:-1], levels[-2::-1], strict=True):
            alive = (total <= distance) & (above["last"][node] > query)
            query, node, total = query[alive], node[alive], total[alive]
            n = above["end"][node] - above["start"][node]
            ends = np.cumsum(n)
            steps = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n)
            node = np.repeat(above["start"][node], n) + steps
            query, total = np.repeat(query, n), np.repeat(total, n)
            total = total + np.bitwise_count((fps[query] ^ below["bits"][node]) & below["keep"][node])
        found = (total <= distance) & (node > query)
        yield query[found], node[found]


def _forest(count: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Links from members to the first member of what they are connected to."""
    label = np.arange(count)
    for a, b in links:
        while len(a):
            la, lb = label[a], label[b]
            apart = la != lb
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while (label[label] != label).any():
                label = label[label]
    other = np.flatnonzero(label != np.arange(count))
    return label[other], other


def links(nodes: DataFrame, distance: int = 3) -> DataFrame:
    """Links (a, b) that connect whatever fingerprints `fp` within the distance connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            fps = np.concatenate([p.column(2).to_numpy() for p in parts]).view(np.uint64)
            keys = np.concatenate([p.column(1).to_numpy() for p in parts])
            paths = np.concatenate([p.column(0).to_numpy(zero_copy_only=False) for p in parts])
            new = np.append(True, (keys[1:] != keys[:-1]) | (paths[1:] != paths[:-1]))
            a, b = _forest(len(fps), _links(np.cumsum(new) - 1, fps, distance))
            signed = fps.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(signed[a]), pa.array(signed[b])], names=["a", "b"])

        # whole groups only: the last of a batch waits for the next
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(1).to_numpy()
            paths = batch.column(0).to_numpy(zero_copy_only=False)
            same = (keys == keys[-1]) & (paths == paths[-1])
            tail = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
            if tail:
                yield flush([*held, batch.slice(0, tail)])
                held = []
            held.append(batch.slice(tail))
        if held:
            yield flush(held)

    out = None
    for part in _buckets(nodes.select("fp"), distance):
        rank = gray_rank(F.col("fp"))
        sorted_part = (
            part.select("path", "key", "fp")
            .repartition("path", "key")
            .sortWithinPartitions("path", "key", rank)
            .mapInArrow(run, "a long, b long")
        )
        out = sorted_part if out is None else out.unionByName(sorted_part)
    return out


def near_duplicates(
    docs: DataFrame, shingle: int = 3, distance: int = 3, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """For each document: doc_id, fp, component_id (the least doc_id reachable by links)."""
    marked = fingerprints(docs, shingle, text, (doc_id,)).select(F.col(f"row.`{doc_id}`").alias("doc_id"), "fp")
    marked = stage(marked, "fingerprints")
    nodes = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "nodes")
    roots = components(links(nodes, distance))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", "n", F.coalesce("root", "fp").alias("root")
    )
    rooted = stage(rooted, "rooted")
    ids = stage(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")), "ids")
    # a component may hold a large share of the fingerprints, a fingerprint of the documents
    named = counted_join(rooted.select("fp", "n", "root"), ids, "root", "members", rooted.count())
    named = stage(named.select("fp", "n", "component_id"), "named")
    release(docs.sparkSession, nodes, rooted, ids)
    return counted_join(marked, named, "fp", "n", marked.count()).select("doc_id", "fp", "component_id")
