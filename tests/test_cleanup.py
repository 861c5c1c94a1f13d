"""Dormant-company scoring."""

from __future__ import annotations

from dataclasses import replace

import pytest

from tidyroll import ScoringParams, company_cleanup

from .conftest import day, rows_of

PARAMS = ScoringParams(as_of=day("2025-06-01"))
GREEN = "GREEN - Zombie (no invoice/ticket/project since 2024-01-01)"
RED = "RED - 0 active agreements + no invoice since 2024-01-01"
YELLOW = "YELLOW - Active agreements but no invoice since 2024-01-01"
FINE = "OK / Needs review"
STRONG = "Strong candidate: set Inactive/Gone (after quick check)"
REVIEW = "Review: likely cleanup / confirm ownership + billing"
LOW = "Low priority: keep, revisit later"


@pytest.fixture(scope="module")
def views(make_views):
    status = {"H": None, "I": "Inactive/Gone"}
    entered = {"B": "2025-03-01", "J": "2027-01-01"}
    names = "ABCDEFGHIJ"
    ids = {n: i for i, n in enumerate(names, 1)}

    def invoice(name, date, number):
        return {"Company_RecID": ids[name], "Date_Invoice": day(date), "Invoice_Number": number}

    def agreement(name, end):
        return {
            "Company_RecID": ids[name],
            "Agreement_Status": "Active",
            "DateEnd": end and day(end),
        }

    tickets = [("C", 1, "2024-06-01"), ("D", 2, "2024-06-01"), ("E", 3, "2024-02-01"),
               ("F", 4, "2024-02-01"), ("E", 5, "2021-01-01")]
    return make_views(
        company=[
            {
                "Company_RecID": ids[n],
                "Company_Name": n,
                "Company_Status_Desc": status.get(n, "Active"),
                "Date_Entered": day(entered.get(n, "2020-01-01")),
            }
            for n in names
        ],
        invoices=[
            invoice("C", "2023-05-01", "1"),
            invoice("D", "2023-05-01", "2"),
            *(invoice(n, "2024-05-01", k) for n in "EF" for k in ("7", "8")),
            invoice("E", "2022-01-01", "9"),
            invoice("G", "2025-01-01", "3"),
            invoice("G", "2020-01-01", "4"),
        ],
        agreements=[
            agreement("D", None),
            agreement("E", "2025-06-01"),
            agreement("F", "2025-05-31"),
            {"Company_RecID": ids["A"], "Agreement_Status": "Expired"},
        ],
        service=[
            {"Company_RecID": ids[n], "SR_Service_RecID": k, "Last_Update": day(d)}
            for n, k, d in tickets
        ],
        # Two projects of one ticket, and one without a ticket.
        project=[
            {"SR_Service_RecID": 3, "Last_Update": day("2024-02-01")},
            {"SR_Service_RecID": 3, "Last_Update": day("2020-02-01")},
            {"SR_Service_RecID": 4, "Last_Update": day("2024-02-01")},
            {"SR_Service_RecID": 99, "Last_Update": day("2024-02-01")},
        ],
    )


def test_buckets_scores_and_recommendations(views):
    found = {
        r["Company_Name"]: (r["Cleanup_Bucket"], r["Cleanup_Score"], r["Cleanup_Recommendation"])
        for r in rows_of(company_cleanup(views, PARAMS))
    }
    assert found == {
        "A": (GREEN, 100, STRONG),
        "B": (GREEN, 85, STRONG),
        "C": (RED, 80, STRONG),
        "D": (YELLOW, 55, REVIEW),
        "E": (FINE, 0, "Keep"),
        "F": (FINE, 25, LOW),
        "J": (GREEN, 100, STRONG),
    }


def test_details(views):
    rows = {r["Company_Name"]: r for r in rows_of(company_cleanup(views, PARAMS))}
    assert rows["E"]["Last_Invoice_Number"] == "8"
    assert rows["E"]["Last_Invoice_Sent_Date"] == day("2024-05-01")
    assert rows["E"]["Last_Ticket_Updated"] == day("2024-02-01")
    assert rows["E"]["Last_Project_Updated"] == day("2024-02-01")
    assert rows["C"]["Last_Project_Updated"] is None
    assert (rows["D"]["Active_Agreements"], rows["F"]["Active_Agreements"]) == (1, 0)
    assert {n for n, r in rows.items() if r["Recently_Added"] == "Recently Added"} == {"B"}


def test_order(views):
    names = [r["Company_Name"] for r in rows_of(company_cleanup(views, PARAMS))]
    assert names == ["A", "J", "B", "C", "D", "F", "E"]


def test_default_day_is_today(views):
    # Every dated agreement of the fixture has ended by now.
    rows = rows_of(company_cleanup(views, ScoringParams()))
    assert {r["Company_Name"] for r in rows if r["Active_Agreements"]} == {"D"}


def test_collation_of_the_status(views):
    params = replace(PARAMS, company_status="INACTIVE/GONE")
    assert "I" in {r["Company_Name"] for r in rows_of(company_cleanup(views, params))}
    params = replace(params, collation="UTF8_LCASE")
    assert "I" not in {r["Company_Name"] for r in rows_of(company_cleanup(views, params))}
