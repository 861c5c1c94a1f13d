"""Latest signs of life per company, each one row per company."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import under
from ..params import ScoringParams


def last_invoice(views: dict[str, DataFrame]) -> DataFrame:
    """Date and number of the latest invoice; the highest number of the latest day."""
    latest = F.max(F.struct("Date_Invoice", "Invoice_Number"))
    return (
        views["invoices"]
        .groupBy("Company_RecID")
        .agg(latest.alias("latest"))
        .select(
            "Company_RecID",
            F.col("latest.Date_Invoice").alias("Last_Invoice_Date"),
            F.col("latest.Invoice_Number").alias("Last_Invoice_Number"),
        )
    )


def active_agreements(views: dict[str, DataFrame], params: ScoringParams) -> DataFrame:
    """Number of agreements that run on the `as_of` day."""
    today = F.lit(params.as_of) if params.as_of else F.current_date()
    running = F.col("DateEnd").isNull() | (F.col("DateEnd") >= today)
    return (
        views["agreements"]
        .where((under(F.col("Agreement_Status"), params.collation) == "Active") & running)
        .groupBy("Company_RecID")
        .agg(F.count(F.lit(1)).alias("Active_Agreements"))
    )


def last_ticket(views: dict[str, DataFrame]) -> DataFrame:
    return (
        views["service"]
        .groupBy("Company_RecID")
        .agg(F.max("Last_Update").alias("Last_Ticket_Updated"))
    )


def _project_updates(views: dict[str, DataFrame]) -> DataFrame:
    """Latest project update per ticket, so that a busy ticket is one row before the join."""
    return (
        views["project"]
        .groupBy("SR_Service_RecID")
        .agg(F.max("Last_Update").alias("Project_Update"))
    )


def last_project(views: dict[str, DataFrame]) -> DataFrame:
    """A project belongs to the company of its ticket."""
    tickets = views["service"].select("SR_Service_RecID", "Company_RecID")
    return (
        tickets.join(_project_updates(views), "SR_Service_RecID")
        .groupBy("Company_RecID")
        .agg(F.max("Project_Update").alias("Last_Project_Updated"))
    )


def last_service_activity(views: dict[str, DataFrame]) -> DataFrame:
    """`last_ticket` and `last_project` in one pass over the tickets."""
    return (
        views["service"]
        .join(_project_updates(views), "SR_Service_RecID", "left")
        .groupBy("Company_RecID")
        .agg(
            F.max("Last_Update").alias("Last_Ticket_Updated"),
            F.max("Project_Update").alias("Last_Project_Updated"),
        )
    )
