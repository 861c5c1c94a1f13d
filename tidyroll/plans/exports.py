"""Rows to act on after review. Nothing here changes the source system."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import key_counts, split_join
from ..operators.staging import stage

TWO_TARGETS = "two targets"
NO_ADDRESS = "no address id"
ALSO_SURVIVOR = "also a survivor"


def merge_export(duplicates: DataFrame) -> DataFrame:
    """Contacts to merge away, of a `duplicate_contacts` report of either policy.

    A contact can be in one group per address. `conflict` names contacts that are told to
    merge into two survivors, or that survive in another group.
    """
    target = F.col("merge_with").try_cast("bigint")
    by_text = dict(duplicates.dtypes)["merge_with"] == "string"
    survives = F.col("merge_with" if by_text else "merge_action") == "PRIMARY"
    rows = stage(
        duplicates.select(
            "Contact_RecID",
            target.alias("merge_with"),
            survives.alias("survives"),
            "Contact_Communication_RecID",
        ),
        "merges",
    )
    contacts = rows.groupBy("Contact_RecID").agg(
        F.count(F.lit(1)).alias("rows"),
        F.when(F.min("merge_with") != F.max("merge_with"), TWO_TARGETS).alias("two"),
        F.when(F.max("survives"), ALSO_SURVIVOR).alias("both"),
    )
    conflict = F.nullif(F.concat_ws(", ", "two", "both"), F.lit(""))
    merges = rows.where(F.col("merge_with").isNotNull())
    return split_join(
        merges,
        contacts,
        ["Contact_RecID"],
        counts=key_counts(contacts, "rows")["rows"],
        spread="Contact_Communication_RecID",
    ).select("Contact_RecID", "merge_with", conflict.alias("conflict"))


def move_export(suggestions: DataFrame) -> DataFrame:
    """Distinct moves of the rows that are ready, of a `move_suggestions` report.

    `conflict` marks contacts with more than one target, and else moves without an address id,
    which the API refuses. A contact has at most two targets: the own company and the one company
    it matches.
    """
    target = F.struct("MoveToCompanyRecID", "MoveToCompanyAddressRecID")
    moves = (
        suggestions.where(F.col("ReadyForApiUpdateFlag") == 1)
        .groupBy("Contact_RecID")
        .agg(F.collect_set(target).alias("targets"))
    )
    rows = moves.select(
        "Contact_RecID", (F.size("targets") > 1).alias("several"), F.explode("targets").alias("target")
    )
    conflict = F.when(F.col("several"), TWO_TARGETS).when(
        F.col("target.MoveToCompanyAddressRecID").isNull(), NO_ADDRESS
    )
    return rows.select("Contact_RecID", "target.*", conflict.alias("conflict"))


def merge_plan(duplicates: DataFrame) -> DataFrame:
    """Ordered calls of an any-status `duplicate_contacts` report.

    Per group: activate an inactive survivor (step 1), merge every other contact into it
    (step 2, in any order), make the survivor inactive again (step 3). A group that has only
    its survivor needs no call.
    """
    group = ["Company_RecID", "EmailAddress"]
    duplicates = stage(
        duplicates.select(
            *group, "merge_action", "Contact_RecID", "Contact_InactiveFlag", "merge_with"
        ),
        "plan",
    )
    merges = F.col("merge_action") == "MERGE"
    survivor = F.when(~merges, F.col("Contact_RecID"))
    inactive = F.when(~merges, F.col("Contact_InactiveFlag"))
    around = (
        duplicates.groupBy(*group)
        .agg(
            F.max(survivor).alias("Contact_RecID"),
            F.max(inactive).alias("inactive"),
            F.count(F.when(merges, 1)).alias("merges"),
        )
        .where((F.col("merges") > 0) & (F.col("inactive") != 0))
        .withColumn(
            "call",
            F.explode(
                F.array(
                    F.struct(F.lit(1).alias("step"), F.lit("ACTIVATE").alias("action")),
                    F.struct(F.lit(3).alias("step"), F.lit("DEACTIVATE").alias("action")),
                )
            ),
        )
        .select(
            *group, "call.*", "Contact_RecID", F.lit(None).cast("bigint").alias("merge_with")
        )
    )
    merged = (
        duplicates.where(merges)
        .select(
            *group,
            F.lit(2).alias("step"),
            F.lit("MERGE").alias("action"),
            "Contact_RecID",
            "merge_with",
        )
        .distinct()
    )
    return around.unionByName(merged).orderBy(*group, "step", "Contact_RecID")


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write with a header line, one file per task."""
    df.write.mode(mode).option("header", True).csv(path)
