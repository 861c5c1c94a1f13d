"""Report: dormant companies, scored for clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ladder, under
from ..operators.companies import cleanup_flags
from ..params import ScoringParams

# What each flag adds to the score, and the labels with the lowest score of each.
POINTS = {
    "No_Invoice_Since_Stale_Flag": 40,
    "No_Active_Agreements_Flag": 25,
    "No_Ticket_Since_Stale_Flag": 20,
    "No_Project_Since_Stale_Flag": 15,
    "Recently_Added_Flag": -15,
}
RECOMMENDATIONS = (
    (70, "Strong candidate: set Inactive/Gone (after quick check)"),
    (45, "Review: likely cleanup / confirm ownership + billing"),
    (25, "Low priority: keep, revisit later"),
)
KEEP = "Keep"
ZOMBIE = "GREEN - Zombie (no invoice/ticket/project since {day})"
NO_BILLING = "RED - 0 active agreements + no invoice since {day}"
UNBILLED = "YELLOW - Active agreements but no invoice since {day}"
FINE = "OK / Needs review"


def company_cleanup(
    views: dict[str, DataFrame], params: ScoringParams = ScoringParams(), ordered: bool = True
) -> DataFrame:
    """One row per company in scope: last activity, bucket, score and recommendation."""
    # Flags are 0/1 integers, so a weighted sum is the score.
    score = sum((F.col(f) * points for f, points in POINTS.items()), F.lit(0))
    advice = ladder(F.col("Cleanup_Score"), RECOMMENDATIONS, KEEP)
    unbilled = F.col("No_Invoice_Since_Stale_Flag") == 1
    idle = (F.col("No_Ticket_Since_Stale_Flag") == 1) & (
        F.col("No_Project_Since_Stale_Flag") == 1
    )
    day = params.stale_since.isoformat()
    bucket = (
        F.when(~unbilled, FINE)
        .when(idle, ZOMBIE.format(day=day))
        .when(F.col("Active_Agreements") == 0, NO_BILLING.format(day=day))
        .otherwise(UNBILLED.format(day=day))
    )
    recent = F.when(F.col("Recently_Added_Flag") == 1, "Recently Added").otherwise("Not Recent")
    report = (
        cleanup_flags(views, params)
        .withColumn("Cleanup_Score", score)
        .select(
            "Company_RecID",
            "Company_Name",
            "Company_Type_Desc",
            F.col("Company_Status_Desc").alias("Company_Status"),
            F.col("Account_Nbr").alias("Company_Account_Number"),
            F.col("Company_TerritoryOrCountry").alias("Company_Territory_Country"),
            "Company_Date_Entered",
            recent.alias("Recently_Added"),
            "Recently_Added_Flag",
            "Company_Last_Updated_UTC",
            F.col("Last_Invoice_Date").alias("Last_Invoice_Sent_Date"),
            "Last_Invoice_Number",
            "Active_Agreements",
            "Last_Ticket_Updated",
            "Last_Project_Updated",
            bucket.alias("Cleanup_Bucket"),
            "Cleanup_Score",
            advice.alias("Cleanup_Recommendation"),
            "No_Invoice_Since_Stale_Flag",
            "No_Active_Agreements_Flag",
            "No_Ticket_Since_Stale_Flag",
            "No_Project_Since_Stale_Flag",
        )
    )
    if not ordered:
        return report
    # The id only settles ties; it lets the sort split rows that are equal so far.
    return report.orderBy(
        F.desc("Cleanup_Score"),
        "Cleanup_Bucket",
        under(F.col("Company_Name"), params.collation),
        "Company_RecID",
    )
