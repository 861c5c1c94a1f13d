"""Joins that hold up when one key owns a large share of the rows."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is split when it holds at least 1/SHARE of all rows. By the pigeonhole principle no
# more than SHARE keys can, which bounds what is broadcast: SHARE pairs of two numbers.
SHARE = 16_384
# Below this many rows a key is never split, whatever its share.
MIN_ROWS = 200_000
# Below this many pairs a key of `split_pairs` is never split.
MIN_PAIRS = 4_000_000
# Cells that a partition of `split_pairs` has on average.
CELLS_EACH = 4

_HASH, _PIECES, _PIECE = "__key_hash", "__pieces", "__piece"


class KeyCounts(NamedTuple):
    """How many left rows each key has: a DataFrame, its column with the number, the largest
    number, and the rows that a piece of a hot key should have, None when no key is hot."""

    keys: DataFrame
    rows: str
    most: int
    size: int | None


def key_counts(keys: DataFrame, *columns: str) -> dict[str, KeyCounts]:
    """Measure columns of a table with one row per key, in one pass.

    Two numbers per column come to the driver: the sum and the maximum.
    """
    totals = keys.agg(*(f(c) for c in columns for f in (F.sum, F.max))).first()
    measured = {}
    for column, total, most in zip(columns, totals[::2], totals[1::2], strict=True):
        total, most = total or 0, most or 0
        size = max(-(-total // SHARE), MIN_ROWS)
        measured[column] = KeyCounts(keys, column, most, size if most >= size else None)
    return measured


def hot_keys(counts: KeyCounts, keys: list[str]) -> DataFrame:
    """(hash of the key, number of pieces) of the keys with enough rows for a piece.

    A hash that two keys share only splits one key too many.
    """
    return (
        counts.keys.where(F.col(counts.rows) >= counts.size)
        .groupBy(F.xxhash64(*keys).alias(_HASH))
        .agg(F.floor(F.max(counts.rows) / counts.size + 1).cast("int").alias(_PIECES))
    )


def split_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    counts: KeyCounts,
    spread: str,
    how: str = "inner",
) -> DataFrame:
    """Join `left` to `right`, which has at most one row per key, splitting the hot keys.

    `counts` holds the number of left rows of each key, or an estimate of it: the result does
    not depend on it, only the balance of the tasks does. Without a hot key this is a plain
    join. Otherwise a hot key's left rows are dealt to pieces by a hash of column `spread`, and
    its one right row is copied to each piece, at most 2 * SHARE copies over all keys. Other
    keys have the single piece 0.
    """
    if counts.size is None:
        return left.join(right, keys, how)
    left, right = _dealt(left, right, keys, counts, spread, _PIECE)
    return left.join(right, [*keys, _PIECE], how).drop(_PIECE)


def split_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    counts: tuple[KeyCounts, KeyCounts],
    spread: tuple[str, str],
) -> DataFrame:
    """Inner join of two sides that may both have many rows of a key, splitting the hot keys.

    `counts` and `spread` are those of the left and of the right side. A key is hot by the pairs it
    makes, not by the rows it has: its pairs are a grid, cut into cells that are about square, and a
    row is dealt to one line of cells on its own side and copied to each cell of that line. The size
    of a cell is a share of all pairs, so there are at most 2 * SHARE of them, and a row is copied
    about as often as the square root of their number. Cells are dealt to a number of partitions that
    is given, as adaptive execution would merge partitions by their rows before the pairs are made.
    """
    sides = [c.keys.select(*keys, F.col(c.rows).cast("double").alias(n)) for c, n in zip(counts, "lr", strict=True)]
    # rows that find no other are still shuffled
    grid = sides[0].join(sides[1], keys, "full").fillna(0, ["l", "r"])
    grid = grid.select(*keys, *(F.greatest(n, F.lit(1)).alias(n) for n in "lr")).withColumn("pairs", F.col("l") * F.col("r"))
    total, most = grid.agg(F.sum("pairs"), F.max("pairs")).first()
    size = max((total or 0) / SHARE, MIN_PAIRS)
    if (most or 0) < size:
        return left.join(right, keys)
    cells = F.floor(F.col("pairs") / size + 1)
    lines = F.ceil(F.sqrt(cells * F.col("l") / F.col("r")))
    grid = grid.where(F.col("pairs") >= size).withColumn("cells", cells)
    grid = grid.withColumn("lefts", F.greatest(F.lit(1), F.least("cells", lines)).cast("long"))
    rights = F.ceil(F.col("cells") / F.col("lefts"))
    pieces = [f"{_PIECE}_left", f"{_PIECE}_right"]
    for piece, n, mine in zip(pieces, (F.col("lefts"), rights), (True, False), strict=True):
        hot = grid.groupBy(F.xxhash64(*keys).alias(_HASH)).agg(F.max(n).cast("int").alias(_PIECES))
        if mine:
            left, right = _tagged(left, right, keys, hot, spread[0], piece)
        else:
            right, left = _tagged(right, left, keys, hot, spread[1], piece)
    dealt_by = [*keys, *pieces]
    partitions = max(
        int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / size / CELLS_EACH)
    )
    left, right = (df.repartition(partitions, *dealt_by) for df in (left, right))
    return left.join(right, dealt_by).drop(*pieces)


def _dealt(
    many: DataFrame, other: DataFrame, keys: list[str], counts: KeyCounts, spread: str, name: str
) -> tuple[DataFrame, DataFrame]:
    """Both sides with the piece of each row in column `name`: dealt on the side with many rows
    of a key, copied to every piece on the other."""
    return _tagged(many, other, keys, hot_keys(counts, keys), spread, name)


def _tagged(
    many: DataFrame, other: DataFrame, keys: list[str], hot: DataFrame, spread: str, name: str
) -> tuple[DataFrame, DataFrame]:
    hot = F.broadcast(hot)
    dealt = F.pmod(F.xxhash64(F.col(spread)), F.coalesce(_PIECES, F.lit(1))).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce(_PIECES, F.lit(1)) - 1))

    def tagged(df: DataFrame, piece: Column) -> DataFrame:
        return (
            df.withColumn(_HASH, F.xxhash64(*keys))
            .join(hot, _HASH, "left")
            .withColumn(name, piece)
            .drop(_HASH, _PIECES)
        )

    return tagged(many, dealt), tagged(other, copies)
