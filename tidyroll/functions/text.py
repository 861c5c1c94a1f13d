"""Column expressions on email addresses and their domains. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marker of a retired mailbox or domain. In LIKE the underscore matches any
# one character, which the default mode keeps.
OLD_MAILBOX = "%_old@%"
OLD_DOMAIN = "%_old"
OLD_MAILBOX_LITERAL = r"%\_old@%"
OLD_DOMAIN_LITERAL = r"%\_old"
OLD_LENGTH = 4


def normalize_email(address: Column) -> Column:
    """Address without outer spaces, in lower case."""
    return F.lower(F.trim(address))


def is_usable_address(address: Column, literal_old: bool = False) -> Column:
    """True for text with an `@` whose mailbox is not marked as old. Null stays null."""
    marker = OLD_MAILBOX_LITERAL if literal_old else OLD_MAILBOX
    return address.contains("@") & ~F.lower(address).like(marker)


def email_domain(address: Column) -> Column:
    """What follows the first `@`, normalized; the whole text when there is no `@`."""
    return normalize_email(F.substr(address, F.instr(address, "@") + F.lit(1)))


def normalized_domain(domain: Column, literal_old: bool = False) -> Column:
    """Domain without the old marker at its end."""
    marker = OLD_DOMAIN_LITERAL if literal_old else OLD_DOMAIN
    return F.when(
        domain.like(marker), F.left(domain, F.length(domain) - F.lit(OLD_LENGTH))
    ).otherwise(domain)


def under(text: Column, collation: str | None) -> Column:
    """`text` compared under `collation`, or byte by byte when there is none."""
    return F.collate(text, collation) if collation else text
