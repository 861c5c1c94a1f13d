"""Arguments of the reports. Every report takes one frozen object and reads no clock or global."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

# Shared mailbox providers that never identify a company.
PUBLIC_DOMAINS = (
    "aol.com",
    "bredband.se",
    "bredband2.se",
    "caiway.nl",
    "foxmail.com",
    "gmail.com",
    "googlemail.com",
    "hetnet.nl",
    "home.nl",
    "hotmail.com",
    "hotmail.dk",
    "hotmail.fi",
    "hotmail.fr",
    "hotmail.nl",
    "hotmail.no",
    "hotmail.se",
    "icloud.com",
    "kpnmail.nl",
    "kpnplanet.nl",
    "live.co.uk",
    "live.com",
    "live.dk",
    "live.fi",
    "live.nl",
    "live.no",
    "live.se",
    "mac.com",
    "mail.dk",
    "mail.ru",
    "me.com",
    "msn.com",
    "online.no",
    "orange.com",
    "orange.fr",
    "outlook.com",
    "outlook.dk",
    "outlook.fi",
    "outlook.nl",
    "outlook.no",
    "outlook.se",
    "planet.nl",
    "proton.me",
    "protonmail.com",
    "quikcnet.nl",
    "tele2.com",
    "tele2.dk",
    "tele2.fi",
    "tele2.nl",
    "tele2.no",
    "tele2.se",
    "upcmail.nl",
    "xs4all.nl",
    "yahoo.com",
    "yahoo.dk",
    "yahoo.fi",
    "yahoo.nl",
    "yahoo.no",
    "yahoo.se",
)


@dataclass(frozen=True)
class ScoringParams:
    """Cut-off dates of the dormant-company report.

    `as_of` is the day on which an agreement has to be running; None means the current date
    of the session.
    """

    exclude_invoices_after: date = date(2025, 1, 1)
    stale_since: date = date(2024, 1, 1)
    recent_start: date = date(2025, 1, 1)
    recent_end: date = date(2027, 1, 1)
    company_status: str = "Inactive/Gone"
    as_of: date | None = None
    collation: str | None = None


@dataclass(frozen=True)
class MatchParams:
    """Company ids and domain lists of the catch-all matching report.

    The lists may have any length: short ones are literals of the plan, long ones a table. They
    are compared with lower-cased domains, so their entries are trimmed and put in lower case here. With `literal_old` the underscore in the
    `_old` marker stands for itself; by default it stands for any one character, as it does
    in SQL LIKE.
    """

    catch_all_company: int
    own_company: int
    own_domains: tuple[str, ...] = ()
    protected_domains: tuple[str, ...] = ()
    public_domains: tuple[str, ...] = PUBLIC_DOMAINS
    vendor_domains: tuple[str, ...] = ()
    literal_old: bool = False
    collation: str | None = None

    def __post_init__(self) -> None:
        for name in ("own_domains", "protected_domains", "public_domains", "vendor_domains"):
            entries = tuple(d.strip().lower() for d in getattr(self, name))
            object.__setattr__(self, name, entries)
