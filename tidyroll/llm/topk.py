"""Exact top-k search by inner product with a KD-tree in each shard.

Shards are regions: a bounded sample of the vectors is split at medians into as many parts as there
shall be shards, and every vector goes to the part that it lies in. A part that holds far more than its
share (equal vectors with many ids do) is dealt to several shards. A shard's tree splits at the median
of the dimension with the largest spread, and each node has a tight box and its smallest id. A search
goes through a tree best node first, by the largest inner product that the node's box allows; it ends
when that bound can't beat the kth score that it has.

Each query first visits the shard whose box allows it most. The kth score from there is carried to the
other shards: only those whose box allows as much are visited at all, and there it bounds the search.
A shard's tree is sent and loaded once for all queries that visit it (once for each SLICE of queries,
where there are more); queries stream past it one batch at a time.

Vectors that are null or have null or non-finite components, and rows without an id, take no
part. Scores are those of vectors of one length only. Ties go to the smaller id. Rows with the
same id and vector count once; rows with the same id and other vectors are queries of their own
and don't find each other. No vectors or no queries give an empty result.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidyroll.operators.staging import stage

#: Vectors in a shard, in a leaf, and queries that one copy of a tree serves, about.
SHARD, LEAF, SLICE = 16384, 64, 32768
#: Vectors that the regions are fitted on, and bytes of boxes that are broadcast at once.
SAMPLE, BOX_BYTES = 65536, 32 << 20
EXACT = 2.0**52
RESULT = "query_id long, query_key string, vec_id long, score long"
QUERY = "vec_id long, vector array<long>, key string, kth long"


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component; null where the vector takes no part."""
    doubles = vector.cast("array<double>")
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(doubles, lambda x: F.floor(x * scale))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(False)), whole)


class Tree:
    """A KD-tree over integer vectors with ids, in flat arrays."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        spans: list[tuple[int, int]] = [(0, len(ids))]
        self.children: list[int] = []
        lows, highs, least = [], [], []
        at = 0
        while at < len(spans):
            start, end = spans[at]
            part = order[start:end]
            low, high = vectors[part].min(axis=0), vectors[part].max(axis=0)
            lows.append(low)
            highs.append(high)
            least.append(ids[part].min())
            if end - start > leaf and len(low):
                wide = int((high - low).argmax())
                # equal values stay in the order of ids, so many equal vectors split as well
                order[start:end] = part[np.argsort(vectors[part, wide], kind="stable")]
                middle = (start + end) // 2
                self.children.append(len(spans))
                spans += [(start, middle), (middle, end)]
            else:
                self.children.append(-1)
            at += 1
        self.ids, self.vectors = ids[order], vectors[order]
        self.lows, self.highs = np.array(lows), np.array(highs)
        self.least, self.spans = np.array(least), spans
        big = float(np.abs(vectors).max(initial=0))
        self.most = big
        self.floats = self.vectors.astype(np.float64)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node, no less than any score in the node's box."""
        up, down = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
        out = up @ self.highs.astype(np.float64).T + down @ self.lows.astype(np.float64).T
        return out if self._exact(queries) else out + np.abs(out) * 1e-9 + 1

    def _exact(self, queries: np.ndarray) -> bool:
        return self.most * float(np.abs(queries).max(initial=0)) * max(1, queries.shape[1]) < EXACT

    def search(
        self, names: np.ndarray, queries: np.ndarray, k: int, kth: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best others of each query that score no less than `kth`: query, id, score."""
        exact = self._exact(queries)
        bounds = self.bounds(queries)
        out: list[tuple[int, int, int]] = []
        for q in range(len(queries)):
            best: list[tuple[int, int]] = []  # (score, -id), the worst on top
            limit = int(kth[q])
            bound = bounds[q]
            query = queries[q].astype(np.float64) if exact else queries[q]
            frontier = [(-bound[0], 0)]
            while frontier:
                top, node = heapq.heappop(frontier)
                if -top < limit:
                    break
                if len(best) == k and -top <= best[0][0] and self.least[node] > -best[0][1]:
                    continue  # it can tie only, with larger ids
                child = self.children[node]
                if child >= 0:
                    for c in (child, child + 1):
                        if bound[c] >= limit:
                            heapq.heappush(frontier, (-bound[c], c))
                    continue
                start, end = self.spans[node]
                part = self.floats[start:end] if exact else self.vectors[start:end]
                scores = part @ query
                for i in np.flatnonzero(scores >= limit):
                    name, score = int(self.ids[start + i]), int(scores[i])
                    if name == names[q]:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (score, -name))
                    elif (score, -name) > best[0]:
                        heapq.heapreplace(best, (score, -name))
                    if len(best) == k:
                        limit = max(limit, best[0][0])
            out += [(q, -name, score) for score, name in best]
        found = np.array(out, np.int64).reshape(-1, 3)
        return found[:, 0], found[:, 1], found[:, 2]


def _stack(lists: list[list[int]]) -> np.ndarray:
    return np.array(lists, np.int64).reshape(len(lists), len(lists[0]) if lists else 0)


class Regions:
    """Parts of the space of vectors of one length: median splits of a sample."""

    def __init__(self, sample: np.ndarray, parts: int):
        self.dims, self.cuts, self.children = [], [], []
        todo = [(sample, parts)]
        self.parts: list[int] = []
        at = 0
        while at < len(todo):
            rows, wanted = todo[at]
            spread = rows.max(axis=0) - rows.min(axis=0) if rows.size else np.zeros(1, np.int64)
            wide = int(spread.argmax())
            if wanted > 1 and spread[wide]:
                # rows equal to the median all go right, so that equal vectors stay together
                cut = int(np.sort(rows[:, wide])[len(rows) // 2])
                cut += int(cut == rows[:, wide].min())
                left = rows[:, wide] < cut
                self.children.append(len(todo))
                todo += [(rows[left], wanted // 2), (rows[~left], wanted - wanted // 2)]
                self.dims.append(wide)
                self.cuts.append(cut)
            else:
                self.children.append(-1)
                self.dims.append(0)
                self.cuts.append(0)
            at += 1
        todo.clear()
        leaves = [i for i, c in enumerate(self.children) if c < 0]
        number = {node: k for k, node in enumerate(leaves)}
        self.number = np.array([number.get(i, -1) for i in range(len(self.children))])
        self.dims, self.cuts, self.children = map(np.array, (self.dims, self.cuts, self.children))

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """The part that each vector lies in."""
        at = np.zeros(len(vectors), np.int64)
        todo = np.flatnonzero(self.children[at] >= 0)
        while len(todo):
            node = at[todo]
            right = vectors[todo, self.dims[node]] >= self.cuts[node]
            at[todo] = self.children[node] + right
            todo = todo[self.children[at[todo]] >= 0]
        return self.number[at]


def fit_regions(rows: DataFrame, shards: int, sample: int = SAMPLE) -> dict[int, Regions]:
    """Regions for each length, from no more than `sample` vectors: those of the least hash."""
    if shards < 2:
        return {}
    some = rows.select("vector").orderBy(F.xxhash64("vec_id", "vector")).limit(sample).toArrow()
    by_length: dict[int, list[list[int]]] = {}
    for vector in some.column("vector").to_pylist():
        by_length.setdefault(len(vector), []).append(vector)
    total = sum(map(len, by_length.values()))
    return {n: Regions(_stack(v), max(1, shards * len(v) // total)) for n, v in by_length.items()}


def deal(rows: DataFrame, regions: dict[int, Regions], shard: int) -> DataFrame:
    """Rows with dim and shard: a region, or a part of one that holds over twice `shard` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            dims = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy()
            parts = np.zeros(len(dims), np.int64)
            ends = np.cumsum(dims)
            for n in np.unique(dims):
                if n and int(n) in regions:
                    mine = np.flatnonzero(dims == n)
                    places = (ends[mine] - n)[:, None] + np.arange(n)
                    parts[mine] = regions[int(n)].of(flat[places])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(dims, pa.int32()), pa.array(parts, pa.int32())], names=["vec_id", "vector", "dim", "part"]
            )

    placed = rows.select("vec_id", "vector").mapInArrow(run, "vec_id long, vector array<long>, dim int, part int")
    placed = stage(placed, "regions")
    sizes = placed.groupBy("dim", "part").count()
    first, pieces = 0, []
    for dim, part, n in sorted(map(tuple, sizes.collect())):  # a row for each region
        pieces.append((dim, part, first, max(1, n // shard)))
        first += pieces[-1][-1]
    known = F.broadcast(rows.sparkSession.createDataFrame(pieces, "dim int, part int, first int, pieces int"))
    own = F.pmod(F.xxhash64("vec_id", "vector"), F.col("pieces")).cast("int")
    return placed.join(known, ["dim", "part"]).select("dim", (F.col("first") + own).alias("shard"), "vec_id", "vector")


def build(dealt: DataFrame) -> DataFrame:
    """One tree for each shard: dim, shard, tree, and the box around it (low, high)."""

    def run(key, table):
        ids = table.column("vec_id").to_numpy()
        tree = Tree(ids, _stack(table.column("vector").to_pylist()))
        return pa.table(
            {"dim": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()),
             "tree": pa.array([pickle.dumps(tree)], pa.binary()),
             "low": pa.array([tree.lows[0]], pa.list_(pa.int64())), "high": pa.array([tree.highs[0]], pa.list_(pa.int64()))}
        )

    schema = "dim int, shard int, tree binary, low array<long>, high array<long>"
    return dealt.groupBy("dim", "shard").applyInArrow(run, schema)


class Boxes:
    """Boxes of the shards of one length, and the largest score that each allows a query."""

    def __init__(self, shards: list[int], lows: list[list[int]], highs: list[list[int]]):
        self.shards = np.array(shards, np.int32)
        self.lows, self.highs = _stack(lows).astype(np.float64), _stack(highs).astype(np.float64)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """No less than any score: a little more than what floats give."""
        up, down = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
        out = up @ self.highs.T + down @ self.lows.T
        return out + np.abs(up @ np.abs(self.highs).T - down @ np.abs(self.lows).T) * 1e-9 + 1


def box_blocks(trees: DataFrame, most: int = BOX_BYTES) -> Iterator[dict[int, Boxes]]:
    """The boxes of all shards by length, in blocks of a bounded size."""
    boxes = trees.select("dim", "shard", "low", "high")
    size = boxes.agg(F.sum(F.col("dim") * 16 + 64)).first()[0] or 0
    blocks = 1 + size // most
    for block in range(blocks):
        found: dict[int, tuple[list, list, list]] = {}
        for row in boxes.where(F.col("shard") % blocks == block).collect():
            shards, lows, highs = found.setdefault(row["dim"], ([], [], []))
            shards.append(row["shard"])
            lows.append(row["low"])
            highs.append(row["high"])
        yield {dim: Boxes(*lists) for dim, lists in found.items()}


def _queries(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Rows of a batch by length of vector: length, their numbers, vectors."""
    lists = batch.column("vector")
    dims = np.diff(lists.offsets.to_numpy())
    flat, ends = lists.flatten().to_numpy(), np.cumsum(dims)
    for n in np.unique(dims):
        mine = np.flatnonzero(dims == n)
        yield int(n), mine, flat[(ends[mine] - n)[:, None] + np.arange(n)]


def visits(queries: DataFrame, boxes: dict[int, Boxes], home: bool) -> DataFrame:
    """A row for each query and shard to visit: shard, bound, and the columns of QUERY.

    With `home` that is the one shard whose box allows the query most, else all whose box allows the
    kth score that it has.
    """
    shared = queries.sparkSession.sparkContext.broadcast(boxes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, mine, vectors in _queries(batch):
                if n not in shared.value:
                    continue
                known = shared.value[n]
                bounds = known.bounds(vectors)
                if home:
                    rows, at = np.arange(len(mine)), bounds.argmax(axis=1)
                else:
                    kth = batch.column("kth").take(pa.array(mine)).to_numpy()
                    rows, at = np.nonzero(bounds >= kth[:, None])
                for start in range(0, len(rows), 4096):
                    some = slice(start, start + 4096)
                    part = batch.take(pa.array(mine[rows[some]]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(known.shards[at[some]]), pa.array(bounds[rows[some], at[some]]), *part.columns],
                        names=["shard", "bound", *part.schema.names],
                    )

    names = ["vec_id", "vector", "key", "kth"]
    return queries.select(*names).mapInArrow(run, f"shard int, bound double, {QUERY}")


def _visit(trees: DataFrame, wanted: DataFrame, slices: int, k: int) -> DataFrame:
    """Searches the tree of each shard for the queries that visit it."""
    none = [F.lit(None).cast(t).alias(c) for c, t in (("vec_id", "long"), ("vector", "array<long>"), ("key", "string"), ("kth", "long"))]
    copies = trees.join(wanted.select("shard").distinct(), "shard", "left_semi").select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "tree", *none
    )
    mine = F.pmod(F.xxhash64("vec_id", "key"), F.lit(slices)).cast("int").alias("slice")
    asked = wanted.select("shard", mine, F.lit(None).cast("binary").alias("tree"), "vec_id", "vector", "key", "kth")
    both = copies.unionByName(asked).repartition("shard", "slice")
    both = both.sortWithinPartitions("shard", "slice", F.col("tree").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            held = np.flatnonzero(batch.column("tree").is_valid().to_numpy(zero_copy_only=False))
            edges = [0, *held.tolist(), batch.num_rows]
            for start, end in zip(edges, edges[1:], strict=False):
                if start < end and batch.column("tree")[start].is_valid:
                    tree = pickle.loads(batch.column("tree")[start].as_py())
                    start += 1
                if start < end:
                    part = batch.slice(start, end - start)
                    names = part.column("vec_id").to_numpy()
                    vectors = _stack(part.column("vector").to_pylist())
                    q, ids, scores = tree.search(names, vectors, k, part.column("kth").to_numpy())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[q]), part.column("key").take(pa.array(q)), pa.array(ids), pa.array(scores)],
                        names=["query_id", "query_key", "vec_id", "score"],
                    )

    return both.select("tree", "vec_id", "vector", "key", "kth").mapInArrow(run, RESULT)


def top_k(
    vectors: DataFrame,
    every: int = 50,
    k: int = 5,
    scale: int = 256,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    shard: int = SHARD,
) -> DataFrame:
    """The k best rows for each row whose id is divisible by `every`: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"), quantised(F.col(f"`{vector}`"), scale).alias("vector")
    ).where("vec_id is not null and vector is not null")
    rows = stage(rows.distinct(), "vectors")
    n = rows.count()
    trees = stage(build(deal(rows, fit_regions(rows, 1 + n // shard), shard)), "trees")

    least = F.lit(-(2**63)).cast("long")
    key = F.sha2(F.concat_ws(",", F.col("vector").cast("array<string>")), 256)
    asked = rows.where(F.col("vec_id") % every == 0).withColumn("key", key)
    slices = 1 + asked.count() // SLICE
    blocks = list(box_blocks(trees))
    # first each query in the shard that allows it most, for a kth score that holds everywhere
    home = None
    for boxes in blocks:
        part = visits(asked.withColumn("kth", least), boxes, home=True)
        home = part if home is None else home.unionByName(part)
    if len(blocks) > 1:
        best = F.max_by("shard", "bound").alias("shard")
        home = home.join(home.groupBy("vec_id", "key").agg(best), ["vec_id", "key", "shard"], "left_semi")
    home = stage(home, "home")
    first = stage(_visit(trees, home, slices, k), "first")
    counted = first.groupBy("query_id", "query_key").agg(F.min("score").alias("kth"), F.count("*").alias("n"))
    counted = counted.where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), F.col("query_key").alias("key"), "kth")
    bounded = stage(asked.join(counted, ["vec_id", "key"], "left").withColumn("kth", F.coalesce("kth", least)), "bounded")
    # then in all others that may have as good a one
    been = home.select("vec_id", "key", "shard")
    found = first
    for boxes in blocks:
        others = visits(bounded, boxes, home=False).join(been, ["vec_id", "key", "shard"], "left_anti")
        found = found.unionByName(_visit(trees, stage(others, "others"), slices, k))
    # at most k rows of each shard for a query
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
