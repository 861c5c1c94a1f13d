"""Report: contacts of one company that share an email address, and which one to keep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import under
from ..operators.mailboxes import GROUP, email_data
from ..operators.skew import key_counts, split_join
from ..operators.staging import stage
from ..operators.survivors import address_groups


def duplicate_contacts(
    views: dict[str, DataFrame],
    allow_inactive: bool = False,
    ordered: bool = True,
    collation: str | None = None,
) -> DataFrame:
    """Rows of every group with more than one row, with the contact to merge into.

    By default the survivor has to be active: `merge_with` is text, `PRIMARY` on the survivor,
    its id on the others, and null in a group without an active contact. With `allow_inactive`
    any contact may survive: `merge_with` is an id, null on the survivor, and `merge_action`
    says `PRIMARY` or `MERGE`.
    """
    emails = stage(email_data(views, collation), "emails")
    groups = stage(address_groups(emails).where(F.col("rows") > 1), "groups")
    rows = split_join(
        emails,
        groups.drop("rows"),
        GROUP,
        counts=key_counts(groups, "rows")["rows"],
        spread="Contact_Communication_RecID",
    )
    contact = F.col("Contact_RecID")
    if allow_inactive:
        survivor = F.col("any_survivor")
        labels = {
            "merge_with": F.when(contact != survivor, survivor),
            "merge_action": F.when(contact == survivor, "PRIMARY").otherwise("MERGE"),
        }
    else:
        survivor = F.col("active_survivor")
        labels = {
            "merge_with": F.when(contact == survivor, "PRIMARY").otherwise(
                survivor.cast("string")
            )
        }
    report = rows.select(
        "Company_RecID",
        "Company_Name",
        "EmailAddress",
        "Contact_RecID",
        "First_Name",
        "Last_Name",
        "Contact_InactiveFlag",
        "Primary_Contact",
        "Contact_Communication_RecID",
        *(c.alias(name) for name, c in labels.items()),
    )
    if not ordered:
        return report
    # The last two keys only settle ties; they let the sort split rows that are equal so far.
    return report.orderBy(
        under(F.col("Company_Name"), collation),
        "EmailAddress",
        "Contact_InactiveFlag",
        F.desc("Primary_Contact"),
        "Contact_RecID",
        "Company_RecID",
        "Contact_Communication_RecID",
    )
