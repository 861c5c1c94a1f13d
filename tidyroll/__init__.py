"""Data-hygiene reports for CRM and service-desk tables, as PySpark DataFrames."""

from .params import PUBLIC_DOMAINS, MatchParams, ScoringParams
from .plans import (
    company_cleanup,
    duplicate_contacts,
    merge_export,
    merge_plan,
    merge_schedule,
    move_export,
    move_suggestions,
    write_csv,
)
from .sources import VIEWS, JdbcSource, load_views

__all__ = [
    "PUBLIC_DOMAINS",
    "VIEWS",
    "JdbcSource",
    "MatchParams",
    "ScoringParams",
    "company_cleanup",
    "duplicate_contacts",
    "load_views",
    "merge_export",
    "merge_plan",
    "merge_schedule",
    "move_export",
    "move_suggestions",
    "write_csv",
]
