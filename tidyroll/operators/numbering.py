"""Places of rows in an order over a whole table, without one task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stage

_INDEX, _PART, _FIRST = "__index", "__part", "__first"
#: monotonically_increasing_id has the partition above these bits, the row in it below.
_ROW_BITS = 33


def numbered(
    df: DataFrame,
    order: Sequence[Column | str],
    name: str,
    group: Sequence[str] = (),
    weight: str | None = None,
) -> DataFrame:
    """`df` with column `name`: how many rows of its group come before a row in the order, or the
    sum of their column `weight`. Columns of `group` hold no nulls; without them all rows are one.

    Rows are dealt to ranges of (group, order) and numbered there, and each range adds the sum of
    those before it, one number for each range that comes to the driver. A group of any share
    spreads over ranges; its start meets its rows once for each (range, group), a key that has no
    more rows than a range. Rows that are equal in the order follow each other in some order, and a
    random last key lets them spread too. The numbered rows are a staged table, so every later read
    sees the same numbers.
    """
    spark = df.sparkSession
    keys = [*group, *order, "__salt"]
    placed = df.withColumn("__salt", F.rand(7)).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = stage(placed.drop("__salt").withColumn(_INDEX, F.monotonically_increasing_id()), f"numbered-{name}")
    placed = placed.withColumn(_PART, F.shiftright(_INDEX, _ROW_BITS))
    amount = F.lit(1) if weight is None else F.col(weight)
    offsets, total = [], 0
    for part, n in sorted(placed.groupBy(_PART).agg(F.sum(amount)).collect()):
        offsets.append((part, total))
        total += n
    starts = F.broadcast(spark.createDataFrame(offsets, f"{_PART} long, __start long"))  # a number for each range
    if weight is None:
        own = F.col(_INDEX).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    else:
        # a window of one range, which one task has written
        earlier = Window.partitionBy(_PART).orderBy(_INDEX).rowsBetween(Window.unboundedPreceding, -1)
        own = F.coalesce(F.sum(weight).over(earlier), F.lit(0))
    found = placed.withColumn("__own", own).join(starts, _PART)
    found = found.withColumn(name, F.col("__own") + F.col("__start")).drop("__own", "__start", _INDEX)
    if group:
        each = found.groupBy(_PART, *group).agg(F.min(name).alias("__each"))
        first = each.groupBy(*group).agg(F.min("__each").alias(_FIRST))
        found = found.join(each.drop("__each").join(first, [*group]), [_PART, *group])
        found = found.withColumn(name, F.col(name) - F.col(_FIRST)).drop(_FIRST)
    return found.drop(_PART)
