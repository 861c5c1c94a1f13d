"""Every query against SQL on the same rows: the sample tables, and random small views."""

from __future__ import annotations

import random
from datetime import timedelta

import duckdb
import pytest

import __spark_entry__ as entry_point
from oracle_queries import STATEMENTS, statement
from tidyroll import VIEWS, load_views
from tidyroll.operators import skew

from .conftest import SAMPLE, day, table

REPORTS = (
    "company_cleanup",
    "dup_active",
    "dup_any",
    "export_merges",
    "merge_plan",
    "merge_schedule",
    "candidates",
    "match_summary",
    "single_match",
    "candidate_arrays",
    "candidate_companies",
    "move_suggestions",
    "export_moves",
)


def comparable(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(row[i] for i in order) for row in rows]
    return sorted(picked, key=lambda r: tuple((v is not None, str(v)) for v in r))


def assert_same(df, result):
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert comparable(df.collect(), df.columns) == comparable(result.fetchall(), columns)


def random_views(seed: int) -> dict[str, list[dict]]:
    """Rows where everything that the rules tell apart is common: nulls, ties, odd addresses."""
    rng = random.Random(seed)
    pick = rng.choice

    def date(first="1997-01-01", days=2000):
        return day(first) + timedelta(days=rng.randrange(days))

    def address():
        box = pick(["a", "b", " B", "u_old", "harold", "old", "a@b", "C "])
        domain = pick(
            ["own.example", "protected.example", "gmail.com", "gmail.com_old",
             "vendormany.example", "vendormany.example_old", "vendorone.example",
             "x.example", "x.example_old", "x.exampleZold", "X.Example", "y.example ",
             "y.example", "mari", "marigold", "z.example", "lonely.example"]
        )
        return pick([f"{box}@{domain}"] * 12 + ["", "  ", "nothing", None])

    flag = [0, 0, 1, None, 2]
    companies = [0, *range(2, 14)]
    return {
        "company": [
            {
                "Company_RecID": c,
                "Company_ID": f"C{c}",
                "Company_Name": pick(["Ann", "Bob", "bob", None, f"N{c}"]),
                "Company_Type_Desc": pick(["Vendor", "Client, Vendor", "Client", "vendor", None]),
                "Company_Status_Desc": pick(
                    ["Active", "ACTIVE", "Inactive", "Inactive/Gone", None]
                ),
                "Location": pick(["NL", "NO", None]),
                "Date_Entered": pick([date(), date(), None]),
            }
            for c in companies
        ],
        "invoices": [
            {
                "Company_RecID": pick([*companies, 99]),
                "Date_Invoice": pick([date("2000-06-01", 300), date("1999-12-01", 60), None]),
                "Invoice_Number": pick(["1", "2", "10", None]),
            }
            for _ in range(25)
        ],
        "agreements": [
            {
                "Company_RecID": pick(companies),
                "Agreement_Status": pick(["Active", "active", "Expired", None]),
                "DateEnd": pick([None, day("2001-01-01"), day("2000-12-31")]),
            }
            for _ in range(25)
        ],
        "service": [
            {
                "SR_Service_RecID": k,
                "Company_RecID": pick([*companies, None]),
                "Last_Update": pick([date("1999-12-01", 60), None]),
            }
            for k in range(20)
        ],
        "project": [
            {"SR_Service_RecID": rng.randrange(25), "Last_Update": date("1999-12-01", 60)}
            for _ in range(25)
        ],
        "contact": [
            {
                "Contact_RecID": c,
                "Company_RecID": pick([0, 0, 0, *companies, 99, None]),
                "First_Name": pick(["A", "B", None]),
                "Last_Name": pick(["K", "L", None]),
                "Inactive_Flag": pick(flag),
                "Default_Flag": pick(flag),
            }
            for c in range(100, 160)
        ],
        "communication": [
            {
                "Contact_Communication_RecID": k,
                "Contact_RecID": rng.randrange(98, 160),
                "Communication_Name": pick(["Email", "Email", "Teams", None]),
                "Contact_Communication_Desc": address(),
            }
            for k in range(170)
        ],
        "address": [
            {
                "Company_RecID": pick(companies + [6, 6]),
                "Company_Address_RecID": k,
                "Site_Name": f"S{k % 3}",
                "Default_Flag": pick(flag),
                "Inactive_Flag": pick(flag),
            }
            for k in range(25)
        ],
    }


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_sample(spark, name):
    if not SAMPLE.exists():
        pytest.skip("no sample tables")
    con = duckdb.connect()
    for path in SAMPLE.glob("*.parquet"):
        con.execute(f"create view {path.stem} as from '{path}'")
    df = entry_point.queries()[name](spark, str(SAMPLE))
    assert_same(df, con.execute(entry_point.oracle_sql()[name]))


def test_every_report_has_sql():
    assert set(entry_point.REPORTS) <= set(entry_point.queries())
    assert set(entry_point.REPORTS) <= set(entry_point.oracle_sql())
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


@pytest.mark.parametrize("split", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_random_views(spark, monkeypatch, seed, split):
    """With `split`, every key with two rows or more counts as hot and is dealt to pieces."""
    if split:
        monkeypatch.setattr(skew, "MIN_ROWS", 2)
        monkeypatch.setattr(skew, "SHARE", 1_000)
    rows = random_views(seed)
    tables = {view: table(view, rows[view]) for view in VIEWS}
    views = load_views(spark, {view: spark.createDataFrame(t) for view, t in tables.items()})
    con = duckdb.connect()
    for view, t in tables.items():
        con.register(view, t)
    for name in REPORTS:
        assert_same(
            entry_point.REPORTS[name](views), con.execute(statement(name, over_sample=False))
        )
