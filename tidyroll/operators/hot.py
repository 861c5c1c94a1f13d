"""Joins to a table with one row for each key, of which one may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with at least 1/SHARE of the rows is hot, so there are at most SHARE hot keys.
SHARE = 4096


def counted_join(left: DataFrame, right: DataFrame, key: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """`left` joined (inner, left_semi or left_anti) to `right`, which has one row for each key.

    Column `n` of `right` holds how many of the `total` rows of `left` have the key. Rows of hot
    keys stay where they are and meet a broadcast of at most SHARE rows; the others are shuffled by
    key, none of which has a large share. `left` and `right` are read twice, so they are staged
    tables. Null keys match nothing.
    """
    is_hot = F.col(n) * SHARE >= total
    hot, cold = right.where(is_hot).drop(n), right.where(~is_hot).drop(n)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return rest if how == "left_anti" else left.join(F.broadcast(hot), key, how).unionByName(rest)
