"""Groups of rows that share an address within a company, and the contact each one keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mailboxes import GROUP


def address_groups(emails: DataFrame) -> DataFrame:
    """Per (company, address): rows, survivor under either policy.

    The order of preference is active before inactive, then primary, then the lowest id. It
    is taken apart into the lowest id of each of four classes, so that the aggregate keeps
    five numbers per group, runs as a hash aggregate and combines before the shuffle.
    """
    active = F.col("Contact_InactiveFlag") == 0
    primary = F.col("Primary_Contact") == 1
    contact = F.col("Contact_RecID")
    groups = emails.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(F.when(active & primary, contact)).alias("active_primary"),
        F.min(F.when(active, contact)).alias("active"),
        F.min(F.when(primary, contact)).alias("primary"),
        F.min(contact).alias("lowest"),
    )
    return groups.select(
        *GROUP,
        "rows",
        F.coalesce("active_primary", "active").alias("active_survivor"),
        F.coalesce("active_primary", "active", "primary", "lowest").alias("any_survivor"),
    )


def duplicate_groups(emails: DataFrame) -> DataFrame:
    """Keys of the groups with more than one row."""
    return address_groups(emails).where(F.col("rows") > 1).select(*GROUP)
