from .rules import by_case, ladder
from .text import email_domain, is_usable_address, normalize_email, normalized_domain, under

__all__ = [
    "by_case",
    "email_domain",
    "is_usable_address",
    "ladder",
    "normalize_email",
    "normalized_domain",
    "under",
]
