"""Connected components of links between long integers, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hot import counted_join
from .staging import release, stage


def _with_least(links: DataFrame, least: DataFrame) -> DataFrame:
    """Links with the least `m` of their node `a`. A node may hold a large share of the links, as
    the middle of a large component does; `n` of `least` has how many."""
    total = least.agg(F.sum("n")).first()[0] or 0
    return counted_join(links, least, "a", "n", total)


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links each node's larger neighbours to the least of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    larger = F.count(F.when(F.col("b") > F.col("a"), 1))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), larger.alias("n"))
    least = stage(least.where("n > 0"), "least")
    linked = _with_least(both.where("b > a"), least)
    return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links each node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stage(down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "least")
    linked = _with_least(down, least).select(F.col("b").alias("a"), F.col("m").alias("b"))
    ends = least.select("a", F.col("m").alias("b"))
    return linked.union(ends).where("a <> b").distinct(), least


def components(edges: DataFrame) -> DataFrame:
    """The least member `root` of the component of each `node` that has a link (columns a, b).

    Alternates large and small stars until nothing changes. A step keeps at most the links that
    it has, aggregates minima before the shuffle, and is written to the shared folder; only
    counts come to the driver.
    """
    spark = edges.sparkSession
    now, state = stage(edges.where("a <> b").distinct(), "links"), None
    while True:
        for star in (_large_star, _small_star):
            linked, least = star(now)
            after = stage(linked, "links")
            release(spark, now, least)
            now = after
        # a link (a, b) hides its ends in two sums that change with any link
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sums) == state:
            break
        state = tuple(sums)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
