"""Merkle manifest of a table: a hash tree for each source, one over the sources, and proofs.

A row's leaf is the hash of its fields. In each source the leaves stand in the order of doc_id, and
where a leaf stands comes from bitmaps, not from a sort of the leaves: the doc_ids of a source are a
bitmap that is kept as its words of 64 bits that aren't zero, so ids that lie far apart cost a word
each, and rows are merged into words by OR before and after the shuffle. A directory has the bits
before each word, first within blocks of 1024 words, then over the blocks, so a leaf's place is the
directory's number plus the bits below its own in its word.

Nodes then meet their siblings under the key (source, place / 16), in arrays of 16 slots, whose hash
is the node above; each level has a sixteenth of the rows of the one below. Siblings go down the same
way, from the root to the leaves. Nothing is a group of more than 16 nodes, 64 ids or 1024 words.

Fields are written as `-` if null, else as UTF-8 byte count, colon and value, so a null and an empty
text have different leaves, as have clashing or extra columns no influence. Null doc_ids come first in
their source, null sources first of all. Rows that share source and doc_id (ties) stand next to each
other by leaf; their bits say that they are there, and a count how many, so a repeated id may hold any
share of the rows. Equal rows have equal leaves and places of their own. Very long texts are hashed
where they are and don't travel. An empty table gives an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidyroll.operators.hot import counted_join
from tidyroll.operators.numbering import numbered
from tidyroll.operators.staging import release, stage


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
WIDTH = 16
_WORD_BITS, _BLOCK_BITS = 6, 10
#: The word of null doc_ids, below that of any number.
_NULL_WORD = -(1 << 63)


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    """Lower-case hex SHA-256 of values as fields."""
    return F.sha2(F.concat(*map(_field, values)), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def leaves(docs: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """A row for each document: its key (source and word of its id's bitmap), bit, leaf, and `other`,
    the leaf after tampering, null where there was none."""
    values = [F.col(f"`{c}`") for c in fields]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    changed = [lower_ascii(v) if c == "text" else v for c, v in zip(fields, values, strict=True)]
    # 's' in front keeps the order of sources and leaves the empty key to null
    source = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).cast("binary")
    return docs.select(
        "doc_id",
        source.alias("tree"),
        F.coalesce(F.shiftright("doc_id", _WORD_BITS), F.lit(_NULL_WORD)).alias("word"),
        F.coalesce(F.col("doc_id").bitwiseAND(F.lit(63)), F.lit(0)).cast("int").alias("bit"),
        F.unhex(leaf_hash(*values)).alias("leaf"),
        F.when(tampered, F.unhex(leaf_hash(*changed))).alias("other"),
    )


class Directory(NamedTuple):
    """Where leaves stand: `words` (tree, word, bits, again, rows, before, size) and `trees` (tree,
    size). `before` is the number of rows of the tree before the word, `size` that of the tree, and
    `again` the further rows of ids that several rows share."""

    words: DataFrame
    trees: DataFrame


def directory(rows: DataFrame) -> Directory:
    """The bitmaps of trees, and the number of bits before each of their words."""
    ids = rows.groupBy("tree", "word", "bit").agg(F.count("*").alias("n"))
    again = F.collect_list(F.when(F.col("n") > 1, F.struct("bit", (F.col("n") - 1).alias("more"))))
    words = ids.groupBy("tree", "word").agg(
        F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), again.alias("again"), F.sum("n").alias("rows")
    )
    words = stage(words.withColumn("block", F.shiftright("word", _BLOCK_BITS)), "words")
    blocks = words.groupBy("tree", "block").agg(F.sum("rows").alias("block_rows"))
    blocks = stage(numbered(blocks, ["block"], "block_before", ["tree"], "block_rows"), "blocks")
    trees = stage(blocks.groupBy("tree").agg(F.sum("block_rows").alias("size")), "trees")
    blocks = blocks.drop("block_rows").join(trees, "tree")
    earlier = Window.partitionBy("tree", "block").orderBy("word").rowsBetween(Window.unboundedPreceding, -1)  # 1024 at most
    inside = words.withColumn("inside", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    found = inside.join(blocks, ["tree", "block"]).withColumn("before", F.col("inside") + F.col("block_before"))
    return Directory(stage(found.drop("block", "inside", "block_before"), "directory"), trees)


def places(rows: DataFrame, index: Directory) -> DataFrame:
    """Each leaf's `place` in its tree and the tree's `size`, by rank queries."""
    total = index.trees.agg(F.sum("size")).first()[0] or 0
    keyed = rows.withColumn("key", F.struct("tree", "word"))
    words = index.words.select(F.struct("tree", "word").alias("key"), "bits", "again", "rows", "before", "size")
    found = counted_join(keyed, words.withColumn("n", F.col("rows")), "key", "n", total)
    below = F.bit_count(F.expr("bits & ~shiftleft(-1L, bit)"))
    more = F.expr("aggregate(again, 0L, (s, x) -> s + if(x.bit < bit, x.more, 0L))")
    found = found.withColumn("place", F.col("before") + below + more)
    tied = F.expr("exists(again, x -> x.bit = bit)")
    columns = ["doc_id", "tree", "place", "size", "leaf", "other"]
    if index.words.where("size(again) > 0").isEmpty():
        return found.select(*columns)
    equal = numbered(found.where(tied).drop("key"), ["leaf"], "nth", ["tree", "word", "bit"])
    equal = equal.withColumn("place", F.col("place") + F.col("nth"))
    return found.where(~tied).select(*columns).unionByName(equal.select(*columns))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _joined(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda n: _hex(n["node"])), "")


def slots(nodes: DataFrame) -> DataFrame:
    """Runs of 16 nodes (tree, place, size, node, and whatever else) under the key of the node above:
    tree, place, size (of the level above), nodes (array by slot), node (their hash)."""
    others = [c for c in nodes.columns if c not in ("tree", "place", "size")]
    slot = F.struct((F.col("place") % WIDTH).cast("int").alias("slot"), *others)
    up = nodes.groupBy("tree", F.shiftright("place", 4).alias("place")).agg(
        F.array_sort(F.collect_list(slot)).alias("nodes"),  # no more than 16
        F.ceil(F.first("size") / WIDTH).alias("size"),
    )
    return up.withColumn("node", F.unhex(F.sha2(_joined(F.col("nodes")), 256)))


class Forest(NamedTuple):
    """Levels of slot arrays above the given nodes, and the root of each tree (tree, level, node);
    `level` is how many levels of slots lie between the root and the given nodes."""

    levels: list[DataFrame]
    roots: DataFrame


def grow(nodes: DataFrame) -> Forest:
    """Reduce nodes (tree, place, size, node) to a root for each tree."""
    levels, roots = [], [nodes.where("size = 1").select("tree", F.lit(0).alias("level"), "node")]
    now = nodes.where("size > 1")
    most = nodes.agg(F.max("size")).first()[0] or 0
    while most > 1:
        levels.append(stage(slots(now), f"level-{len(levels)}"))
        now = levels[-1].select("tree", "place", "size", "node")
        roots.append(now.where("size = 1").select("tree", F.lit(len(levels)).alias("level"), "node"))
        now, most = now.where("size > 1"), -(-most // WIDTH)
    out = roots[0]
    for more in roots[1:]:
        out = out.unionByName(more)
    return Forest(levels, out)


#: The nodes before and after one's own in its run, as joined hex text.
STEPS = "array<struct<before:string,after:string>>"


def _siblings(level: DataFrame, *others: str) -> DataFrame:
    """A row for each node of a level's arrays: tree, up (place of the node above), place, own (the
    node's struct), step."""
    at = F.posexplode("nodes").alias("at", "own")
    each = level.select("tree", F.col("place").alias("up"), "nodes", *others, at)
    step = F.struct(
        _joined(F.slice("nodes", 1, F.col("at"))).alias("before"),
        _joined(F.slice("nodes", F.col("at") + 2, WIDTH)).alias("after"),
    )
    place = F.col("up") * WIDTH + F.col("own.slot")
    return each.select("tree", "up", place.alias("place"), "own", step.alias("step"), *others)


def descend(forest: Forest, tops: DataFrame) -> DataFrame:
    """The steps from the nodes that a forest grew from up to the top: tree, place, steps, and other
    columns of `tops`, which has for each root (tree, level) the steps above it."""
    others = [c for c in tops.columns if c not in ("tree", "level", "steps")]
    columns = ["tree", "place", "steps", *others]

    def at(level: int) -> DataFrame:
        return tops.where(F.col("level") == level).withColumn("place", F.lit(0).cast("long")).select(*columns)

    now = at(len(forest.levels))
    for level in range(len(forest.levels) - 1, -1, -1):
        each = _siblings(forest.levels[level]).join(now.withColumnRenamed("place", "up"), ["tree", "up"])
        each = each.withColumn("steps", F.concat(F.array("step"), "steps")).select(*columns)
        now = stage(each.unionByName(at(level)), f"steps-{level}")
    return now


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its steps give, as hex text."""
    return F.aggregate(steps, _hex(leaf), lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def proof_hash(steps: Column) -> Column:
    """The hash of all siblings, level by level."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS) -> DataFrame:
    """doc_id, leaf, subroot, root, steps (siblings up to the root), folded_root, verified."""
    spark = docs.sparkSession
    rows = stage(leaves(docs, fields), "leaves")
    index = directory(rows)
    placed = places(rows, index).withColumnRenamed("leaf", "node")
    # the last time that rows travel; the one leaf of a tree is its root
    base = slots(placed).withColumn("lone", (F.col("size") == 1) & (F.size("nodes") == 1))
    base = stage(base, "runs")
    release(spark, rows, index.words, index.trees)

    forest = grow(base.where("not lone").select("tree", "place", "size", "node"))
    lone = base.where("lone").select("tree", F.lit(-1).alias("level"), F.col("nodes")[0]["node"].alias("node"))
    sources = numbered(forest.roots.unionByName(lone), ["tree"], "place")
    count = sources.count()
    sources = sources.withColumnRenamed("tree", "source").withColumn("tree", F.lit(b"")).withColumn("size", F.lit(count))
    top = grow(sources.select("tree", "place", "size", "node"))
    found = top.roots.first()  # one row, none for an empty table
    root = F.lit(bytes(found["node"]).hex() if found else None).cast("string")

    none = F.expr(f"cast(array() as {STEPS})")
    above = descend(top, top.roots.select("tree", "level", none.alias("steps")))
    tops = sources.join(above.select("place", "steps"), "place")
    tops = tops.select(F.col("source").alias("tree"), "level", "steps", _hex(F.col("node")).alias("subroot"))
    tops = stage(tops, "subroots")
    paths = descend(forest, tops)
    lone = tops.where("level = -1").select("tree", F.lit(0).cast("long").alias("place"), "steps", "subroot")
    paths = paths.unionByName(lone).withColumnRenamed("place", "up")

    each = _siblings(base, "lone").join(paths, ["tree", "up"])
    steps = F.when(F.col("lone"), F.col("steps")).otherwise(F.concat(F.array("step"), "steps"))
    each = each.withColumn("steps", steps).select(
        F.col("own.doc_id").alias("doc_id"),
        _hex(F.col("own.node")).alias("leaf"),
        "subroot",
        root.alias("root"),
        "steps",
        fold(F.coalesce("own.other", "own.node"), F.col("steps")).alias("folded_root"),
    )
    return each.withColumn("verified", F.col("folded_root") == F.col("root"))


def digests(docs: DataFrame) -> DataFrame:
    """As `manifest`, with the hash of all siblings in place of them."""
    return manifest(docs).select(
        "doc_id", "leaf", "subroot", "root", proof_hash(F.col("steps")).alias("proof_sha256"), "folded_root", "verified"
    )
