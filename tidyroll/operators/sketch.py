"""Keys that hold a large share of a table's rows, found in one pass and without counting every key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import skew

# Keys with at least 1/SHARE of the rows are found. The summary drops a key with less than
# 7 / (a power of two above TRACKED / 0.75) of the rows at most, a quarter of that share.
SHARE = 4096
TRACKED = 8 * SHARE
# Summaries are merged by so many tasks before one merges theirs.
MERGES = 64
# Tables that the optimizer takes to be smaller aren't looked at: one task can have all their rows.
MIN_BYTES = 64 << 20


def heavy_keys(df: DataFrame, key: str) -> skew.KeyCounts:
    """Estimated rows of the keys of `df` that may be hot, for `skew.split_join`.

    Each task keeps a summary of frequent items (that of Misra and Gries, as Spark's approx_top_k
    has it) of a bounded size, whatever the number of keys; summaries are merged in two steps, and at
    most SHARE keys with their counts come to the driver. Rows without a key don't count. Only the
    key's column is read, and nothing of a table under MIN_BYTES by the optimizer's estimate.
    """
    spark = df.sparkSession
    if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < MIN_BYTES:
        return skew.KeyCounts(df, "rows", 0, None)
    some = df.select(F.col(key).alias("key")).where("key is not null")
    parts = some.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGES)).alias("merge")).agg(
        F.expr(f"approx_top_k_accumulate(key, {TRACKED})").alias("summary"),
        F.count(F.lit(1)).alias("rows"),
    )
    # grouped by a constant, so that an empty table has no row instead of a summary of nothing
    found = parts.groupBy(F.lit(1)).agg(
        F.expr(f"approx_top_k_estimate(approx_top_k_combine(summary, {TRACKED}), {SHARE})").alias("top"),
        F.sum("rows").alias("rows"),
    ).first()
    total, top = (found["rows"], found["top"]) if found else (0, [])
    least = max(-(-total // SHARE), skew.MIN_ROWS)
    hot = [(r["item"], r["count"]) for r in top if r["count"] >= least]
    most = max((n for _, n in hot), default=0)
    if not hot:
        return skew.KeyCounts(df, "rows", most, None)
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, rows long"
    return skew.KeyCounts(spark.createDataFrame(hot, schema), "rows", most, least)
