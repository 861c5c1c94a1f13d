"""Companies that the dormant-company report looks at, and their flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import under
from ..params import ScoringParams
from .activity import active_agreements, last_invoice, last_service_activity


def _in_scope(views: dict[str, DataFrame], params: ScoringParams) -> DataFrame:
    """Companies with a status other than the excluded one; a null status is out as well."""
    status = under(F.col("Company_Status_Desc"), params.collation)
    return (
        views["company"]
        .where(status != params.company_status)
        .withColumnsRenamed(
            {
                "Location": "Company_TerritoryOrCountry",
                "Date_Entered": "Company_Date_Entered",
                "Last_Update_UTC": "Company_Last_Updated_UTC",
            }
        )
    )


def company_base(views: dict[str, DataFrame], params: ScoringParams) -> DataFrame:
    """Companies in scope without a recent invoice."""
    invoiced = (
        views["invoices"]
        .where(F.col("Date_Invoice") >= F.lit(params.exclude_invoices_after))
        .select("Company_RecID")
        .distinct()
    )
    return _in_scope(views, params).join(invoiced, "Company_RecID", "left_anti")


def cleanup_flags(views: dict[str, DataFrame], params: ScoringParams) -> DataFrame:
    """`company_base` with the last activity and 0/1 flags, invoices being read once.

    A company whose last invoice is before the cut-off has none on or after it, so the
    aggregate that gives the last invoice also decides who is left out.
    """

    def flag(condition):
        return F.when(condition, 1).otherwise(0)

    def stale(day: str):
        return flag(F.col(day).isNull() | (F.col(day) < F.lit(params.stale_since)))

    entered, invoiced = F.col("Company_Date_Entered"), F.col("Last_Invoice_Date")
    return (
        _in_scope(views, params)
        .join(last_invoice(views), "Company_RecID", "left")
        .where(invoiced.isNull() | (invoiced < F.lit(params.exclude_invoices_after)))
        .join(active_agreements(views, params), "Company_RecID", "left")
        .join(last_service_activity(views), "Company_RecID", "left")
        .withColumn("Active_Agreements", F.coalesce("Active_Agreements", F.lit(0)))
        .withColumns(
            {
                "Recently_Added_Flag": flag(
                    (entered >= F.lit(params.recent_start)) & (entered < F.lit(params.recent_end))
                ),
                "No_Invoice_Since_Stale_Flag": stale("Last_Invoice_Date"),
                "No_Ticket_Since_Stale_Flag": stale("Last_Ticket_Updated"),
                "No_Project_Since_Stale_Flag": stale("Last_Project_Updated"),
                "No_Active_Agreements_Flag": flag(F.col("Active_Agreements") == 0),
            }
        )
    )
