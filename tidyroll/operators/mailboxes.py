"""Contacts with their addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import (
    email_domain,
    is_usable_address,
    normalize_email,
    normalized_domain,
    under,
)
from .sketch import heavy_keys
from .skew import split_join

GROUP = ["Company_RecID", "EmailAddress"]


def _of_contacts(communications: DataFrame, contacts: DataFrame) -> DataFrame:
    """Communications with the columns of their contact, whose id is a key. A contact with a large
    share of the communications is split."""
    return split_join(
        communications,
        contacts,
        ["Contact_RecID"],
        counts=heavy_keys(communications, "Contact_RecID"),
        spread="Contact_Communication_RecID",
    )


def contact_emails(
    views: dict[str, DataFrame], collation: str | None = None, contacts: DataFrame | None = None
) -> DataFrame:
    """One row per email communication of a contact, with the address normalized.

    The contact's company is not looked up, so an id without a company is still here. `contacts`
    is the view of contacts or a part of it, and may have the company's name.
    """
    contacts = views["contact"] if contacts is None else contacts
    emails = views["communication"].where(
        (under(F.col("Communication_Name"), collation) == "Email")
        & F.col("Contact_Communication_Desc").isNotNull()
    )
    return _of_contacts(emails, contacts).select(
        "Company_RecID",
        normalize_email(F.col("Contact_Communication_Desc")).alias("EmailAddress"),
        "Contact_RecID",
        "First_Name",
        "Last_Name",
        F.coalesce("Inactive_Flag", F.lit(0)).alias("Contact_InactiveFlag"),
        F.coalesce("Default_Flag", F.lit(0)).alias("Primary_Contact"),
        "Contact_Communication_RecID",
        *(c for c in ("Company_Name",) if c in contacts.columns),
    )


def with_company_name(rows: DataFrame, views: dict[str, DataFrame], spread: str) -> DataFrame:
    """Rows of known companies with the company's name. A company with a large share of the rows
    is split."""
    names = views["company"].select("Company_RecID", "Company_Name")
    counts = heavy_keys(rows, "Company_RecID")
    return split_join(rows, names, ["Company_RecID"], counts=counts, spread=spread)


def email_data(views: dict[str, DataFrame], collation: str | None = None) -> DataFrame:
    """`contact_emails` of known companies, with the company's name.

    Contacts get the name before their communications do, so either join looks for hot keys in a
    table that is read, not in a join.
    """
    contacts = with_company_name(views["contact"], views, "Contact_RecID")
    return contact_emails(views, collation, contacts)


def addresses_with_domain(views: dict[str, DataFrame], literal_old: bool = False) -> DataFrame:
    """One row per usable address of any kind, with its raw and its normalized domain."""
    usable = (
        views["communication"]
        .where(is_usable_address(F.col("Contact_Communication_Desc"), literal_old))
        .select(
            "Contact_RecID",
            "Contact_Communication_RecID",
            F.col("Contact_Communication_Desc").alias("EmailAddress"),
        )
    )
    return (
        _of_contacts(usable, views["contact"])
        .withColumn("EmailDomain", email_domain(F.col("EmailAddress")))
        .withColumn(
            "NormalizedEmailDomain", normalized_domain(F.col("EmailDomain"), literal_old)
        )
    )
