from .company_cleanup import company_cleanup
from .duplicate_contacts import duplicate_contacts
from .exports import merge_export, merge_plan, move_export, write_csv
from .merge_schedule import merge_schedule
from .move_suggestions import move_suggestions

__all__ = [
    "company_cleanup",
    "duplicate_contacts",
    "merge_export",
    "merge_plan",
    "merge_schedule",
    "move_export",
    "move_suggestions",
    "write_csv",
]
