"""Calls that can be made one after another, where groups of duplicates share contacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..operators.numbering import numbered
from ..operators.skew import key_counts, split_join
from ..operators.staging import release, stage
from .exports import TWO_TARGETS

ACTIVATE, MERGE, DEACTIVATE = "ACTIVATE", "MERGE", "DEACTIVATE"


def _chosen(told: DataFrame) -> DataFrame:
    """The target of each contact: active before inactive, then primary, then the lowest id."""
    target, active, primary = F.col("merge_with"), ~F.col("inactive"), ~F.col("ordinary")
    lowest = told.groupBy("Contact_RecID").agg(
        F.count(F.lit(1)).alias("targets"),
        F.min(F.when(active & primary, target)).alias("active_primary"),
        F.min(F.when(active, target)).alias("active"),
        F.min(F.when(primary, target)).alias("primary"),
        F.min(target).alias("lowest"),
    )
    return lowest.select(
        "Contact_RecID",
        "targets",
        F.coalesce("active_primary", "active", "primary", "lowest").alias("target"),
    )


def merge_schedule(duplicates: DataFrame) -> DataFrame:
    """Calls of an any-status `duplicate_contacts` report in an order in which each can be made.

    Contacts are in one group for each address, so a survivor of one group may be merged away in
    another. Contacts that merges link, over any number of groups, are a `component` (its lowest
    id), and `step` numbers its calls from 1. A call names no contact that an earlier call has merged
    away: targets come in the reverse of the order of preference, the least preferred first, and a
    contact is only ever merged into one that is preferred to it. Before the merges into an inactive
    target it is activated, and after them made inactive again.

    No order holds for a contact that is told to merge into several targets, as it is gone after the
    first merge. It goes to the most preferred of them; its other merges have no step and the
    `conflict` "two targets". Components of any size are split over tasks.
    """
    spark = duplicates.sparkSession
    rows = stage(
        duplicates.select(
            "Contact_RecID", "merge_with", "Contact_InactiveFlag", "Primary_Contact"
        ),
        "scheduled",
    )
    targets = rows.groupBy(F.col("Contact_RecID").alias("merge_with")).agg(
        F.max(F.col("Contact_InactiveFlag") != 0).alias("inactive"),
        F.max(F.col("Primary_Contact") != 1).alias("ordinary"),
    )
    links = stage(
        rows.where(F.col("merge_with").isNotNull()).select("Contact_RecID", "merge_with").distinct(),
        "links",
    )
    per_target = links.groupBy("merge_with").agg(F.count(F.lit(1)).alias("links"))
    told = stage(
        split_join(
            links,
            targets,
            ["merge_with"],
            counts=key_counts(per_target, "links")["links"],
            spread="Contact_RecID",
        ),
        "told",
    )
    chosen = stage(_chosen(told), "chosen")
    members = components(
        links.select(F.col("Contact_RecID").alias("a"), F.col("merge_with").alias("b"))
    )
    members = members.select(F.col("node").alias("Contact_RecID"), "root")
    # the lowest contact of a component isn't listed as its own member
    places = chosen.join(members, "Contact_RecID", "left").withColumn(
        "component", F.coalesce("root", "Contact_RecID")
    )
    merges = stage(
        split_join(
            told,
            places.select("Contact_RecID", "target", "component"),
            ["Contact_RecID"],
            counts=key_counts(chosen, "targets")["targets"],
            spread="merge_with",
        ),
        "merges",
    )
    made = merges.where(F.col("merge_with") == F.col("target"))
    place = ["component", "inactive", "ordinary", "target"]
    around = made.where("inactive").select(*place).distinct()
    phases = F.array(
        F.struct(F.lit(1).alias("phase"), F.lit(ACTIVATE).alias("action")),
        F.struct(F.lit(3).alias("phase"), F.lit(DEACTIVATE).alias("action")),
    )
    calls = around.select(
        *place,
        F.inline(phases),
        F.col("target").alias("Contact_RecID"),
        F.lit(None).cast("bigint").alias("merge_with"),
    ).unionByName(
        made.select(
            *place,
            F.lit(2).alias("phase"),
            F.lit(MERGE).alias("action"),
            "Contact_RecID",
            "merge_with",
        )
    )
    # the reverse of the order of preference
    order = [F.desc("inactive"), F.desc("ordinary"), F.desc("target"), "phase", "Contact_RecID"]
    calls = numbered(calls, order, "earlier", ["component"]).select(
        "component",
        (F.col("earlier") + 1).alias("step"),
        "action",
        "Contact_RecID",
        "merge_with",
        F.lit(None).cast("string").alias("conflict"),
    )
    refused = merges.where(F.col("merge_with") != F.col("target")).select(
        "component",
        F.lit(None).cast("bigint").alias("step"),
        F.lit(MERGE).alias("action"),
        "Contact_RecID",
        "merge_with",
        F.lit(TWO_TARGETS).alias("conflict"),
    )
    release(spark, rows, links, told, chosen)
    return calls.unionByName(refused)
