"""Duplicate contacts: survivors, labels, order and the exports."""

from __future__ import annotations

import pytest

from tidyroll import duplicate_contacts, merge_export, merge_plan, write_csv

from .conftest import rows_of

# (company, address, contact, inactive, primary, communication)
CASES = [
    (1, "a@x.com", 10, 0, 1, 1),
    (1, " A@X.com ", 11, 0, 0, 2),
    (1, "a@x.com", 12, 1, 0, 3),
    (1, "b@x.com", 13, 1, 0, 4),
    (1, "B@x.com", 14, 1, 1, 5),
    (1, "c@x.com", 15, 0, 0, 6),
    (1, "c@x.com", 15, 0, 0, 7),
    (2, "a@x.com", 16, 0, 0, 8),
    (1, "d@x.com", 17, None, None, 9),
    (1, "d@x.com", 18, 0, 1, 10),
    (1, "", 19, 0, 0, 11),
    (1, "   ", 20, 0, 0, 12),
]


@pytest.fixture(scope="module")
def views(make_views):
    contacts = {
        contact: {
            "Contact_RecID": contact,
            "Company_RecID": company,
            "Inactive_Flag": inactive,
            "Default_Flag": primary,
        }
        for company, _, contact, inactive, primary, _ in CASES
    }
    emails = [
        {
            "Contact_Communication_RecID": communication,
            "Contact_RecID": contact,
            "Communication_Name": "Email",
            "Contact_Communication_Desc": address,
        }
        for _, address, contact, _, _, communication in CASES
    ]
    noise = [
        # Not an email, no address, no contact: none of them makes a duplicate.
        {**emails[7], "Contact_Communication_RecID": 20, "Communication_Name": "Phone"},
        {**emails[7], "Contact_Communication_RecID": 21, "Contact_Communication_Desc": None},
        {**emails[7], "Contact_Communication_RecID": 22, "Contact_RecID": 99},
        # A company that does not exist.
        {**emails[7], "Contact_Communication_RecID": 23, "Contact_RecID": 30},
        {**emails[7], "Contact_Communication_RecID": 24, "Contact_RecID": 31},
    ]
    strays = [{"Contact_RecID": c, "Company_RecID": 77} for c in (30, 31)]
    return make_views(
        company=[{"Company_RecID": 1, "Company_Name": "B"}, {"Company_RecID": 2, "Company_Name": "A"}],
        contact=[*contacts.values(), *strays],
        communication=emails + noise,
    )


def test_active_survivor(views):
    found = {
        r["Contact_Communication_RecID"]: r["merge_with"] for r in rows_of(duplicate_contacts(views))
    }
    assert found == {
        1: "PRIMARY",
        2: "10",
        3: "10",
        4: None,
        5: None,
        6: "PRIMARY",
        7: "PRIMARY",
        9: "18",
        10: "PRIMARY",
        11: "PRIMARY",
        12: "19",
    }


def test_any_survivor(views):
    report = duplicate_contacts(views, allow_inactive=True)
    found = {
        r["Contact_Communication_RecID"]: (r["merge_with"], r["merge_action"])
        for r in rows_of(report)
    }
    assert found == {
        1: (None, "PRIMARY"),
        2: (10, "MERGE"),
        3: (10, "MERGE"),
        4: (14, "MERGE"),
        5: (None, "PRIMARY"),
        6: (None, "PRIMARY"),
        7: (None, "PRIMARY"),
        9: (18, "MERGE"),
        10: (None, "PRIMARY"),
        11: (None, "PRIMARY"),
        12: (19, "MERGE"),
    }
    assert dict(report.dtypes)["merge_with"] == "bigint"


def test_report_order(views):
    rows = rows_of(duplicate_contacts(views))

    def key(r):
        return (
            r["Company_Name"],
            r["EmailAddress"],
            r["Contact_InactiveFlag"],
            -r["Primary_Contact"],
            r["Contact_RecID"],
        )

    assert rows == sorted(rows, key=key)
    assert [r["Contact_RecID"] for r in rows][:2] == [19, 20]


def test_merge_export_keeps_rows_and_names_conflicts(make_views):
    # 2 merges into 1 by one address and into 3 by another; 3 survives there and merges into 0.
    addresses = [(1, "a"), (2, "a"), (2, "b"), (3, "b"), (3, "c"), (9, "b"), (0, "c")]
    primaries = {1, 3, 0}
    views = make_views(
        company=[{"Company_RecID": 5, "Company_Name": "A"}],
        contact=[
            {"Contact_RecID": c, "Company_RecID": 5, "Default_Flag": int(c in primaries)}
            for c in {c for c, _ in addresses}
        ],
        communication=[
            {
                "Contact_Communication_RecID": i,
                "Contact_RecID": c,
                "Communication_Name": "Email",
                "Contact_Communication_Desc": a,
            }
            for i, (c, a) in enumerate(addresses)
        ],
    )
    expected = [
        (2, 1, "two targets"),
        (2, 3, "two targets"),
        (3, 0, "also a survivor"),
        (9, 3, None),
    ]
    for policy in (False, True):
        export = merge_export(duplicate_contacts(views, allow_inactive=policy, ordered=False))
        assert sorted(map(tuple, export.collect())) == expected


def test_merge_plan_wraps_inactive_survivors(views):
    plan = merge_plan(duplicate_contacts(views, allow_inactive=True))
    calls = [(r["EmailAddress"], r["action"], r["Contact_RecID"], r["merge_with"]) for r in rows_of(plan)]
    assert calls == [
        ("", "MERGE", 20, 19),
        ("a@x.com", "MERGE", 11, 10),
        ("a@x.com", "MERGE", 12, 10),
        ("b@x.com", "ACTIVATE", 14, None),
        ("b@x.com", "MERGE", 13, 14),
        ("b@x.com", "DEACTIVATE", 14, None),
        ("d@x.com", "MERGE", 17, 18),
    ]


def test_write_csv(spark, views, tmp_path):
    path = str(tmp_path / "merges")
    export = merge_export(duplicate_contacts(views))
    write_csv(export, path)
    back = spark.read.option("header", True).csv(path)
    assert back.columns == ["Contact_RecID", "merge_with", "conflict"]
    assert sorted(r["Contact_RecID"] for r in back.collect()) == ["11", "12", "17", "20"]


def test_collation_of_the_kind_of_communication(views, make_views):
    shouting = {
        **views,
        "communication": views["communication"].selectExpr(
            "Contact_Communication_RecID",
            "Contact_RecID",
            "upper(Communication_Name) as Communication_Name",
            "Contact_Communication_Desc",
        ),
    }
    assert duplicate_contacts(shouting).count() == 0
    assert duplicate_contacts(shouting, collation="UTF8_LCASE").count() == 11
