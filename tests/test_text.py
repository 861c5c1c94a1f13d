"""Address and domain expressions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidyroll import PUBLIC_DOMAINS
from tidyroll.functions import (
    by_case,
    email_domain,
    is_usable_address,
    ladder,
    normalize_email,
    normalized_domain,
)

# address: (usable, usable with a literal underscore, domain)
ADDRESSES = {
    "a@x.com": (True, True, "x.com"),
    "  A@X.Com  ": (True, True, "x.com"),
    "a@b@c.com": (True, True, "b@c.com"),
    "a@ x.com": (True, True, "x.com"),
    "a@\tx.com": (True, True, "\tx.com"),
    "no-at-sign": (False, False, "no-at-sign"),
    "": (False, False, ""),
    "@": (True, True, ""),
    "harold@x.com": (False, True, "x.com"),
    "u_old@x.com": (False, False, "x.com"),
    "U_OLD@x.com": (False, False, "x.com"),
    "old@x.com": (True, True, "x.com"),
    "a@x.com_old": (True, True, "x.com_old"),
    "a@x.com_old@y": (False, False, "x.com_old@y"),
}


def test_addresses(spark):
    df = spark.createDataFrame([(a,) for a in ADDRESSES], "a string")
    a = F.col("a")
    rows = df.select(
        a, is_usable_address(a), is_usable_address(a, literal_old=True), email_domain(a)
    ).collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == ADDRESSES


@pytest.mark.parametrize(
    ("domain", "wildcard", "literal"),
    [
        ("x.no_old", "x.no", "x.no"),
        ("marigold", "mari", "marigold"),
        ("old", "old", "old"),
        ("_old", "", ""),
        ("x.no_old.com", "x.no_old.com", "x.no_old.com"),
        ("x.no_old_old", "x.no_old", "x.no_old"),
    ],
)
def test_normalized_domain(spark, domain, wildcard, literal):
    df = spark.createDataFrame([(domain,)], "d string")
    d = F.col("d")
    assert tuple(df.select(normalized_domain(d), normalized_domain(d, True)).first()) == (
        wildcard,
        literal,
    )


def test_normalize_email_trims_spaces_only(spark):
    df = spark.createDataFrame([(" A@x ",), ("\tA@x ",), (None,)], "a string")
    found = [r[0] for r in df.select(normalize_email(F.col("a"))).collect()]
    assert found == ["a@x", "\ta@x ", None]


def test_rules(spark):
    df = spark.createDataFrame([(7,), (3,), (0,), (None,)], "n int")
    steps = ladder(F.col("n"), ((5, "high"), (3, "some")), "low")
    assert [r[0] for r in df.select(steps).collect()] == ["high", "some", "low", "low"]
    table = by_case(steps, {"high": F.col("n") * 2, "low": 1})
    assert [r[0] for r in df.select(table).collect()] == [14, None, 1, 1]


def test_public_domains():
    assert len(PUBLIC_DOMAINS) == len(set(PUBLIC_DOMAINS)) == 58
    assert all(d == d.lower().strip() for d in PUBLIC_DOMAINS)
