"""Catch-all matching on a small hand-made set of companies and contacts."""

from __future__ import annotations

from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidyroll import MatchParams, move_export, move_suggestions
from tidyroll.operators import candidates as cand
from tidyroll.operators import domains as domain_module
from tidyroll.operators import sketch, skew
from tidyroll.operators.addresses import address_choice
from tidyroll.operators.domains import domain_counts

from .conftest import rows_of

PARAMS = MatchParams(
    catch_all_company=900,
    own_company=101,
    own_domains=("own.example",),
    protected_domains=("prot.example",),
    public_domains=("gmail.com",),
    vendor_domains=("v.example", "v2.example"),
)

# company: (status, type, {domain: addresses})
COMPANIES = {
    101: ("Active", "Client", {"c1.example": 1}),
    102: ("Active", "Client", {"c2.example": 2, "c2.example_old": 2}),
    103: ("Active", "Vendor", {"v.example": 3}),
    104: ("Active", "Client", {"c4.example": 3}),
    105: ("Inactive", None, {"m.example": 3}),
    106: ("Active", "Client", {"m.example": 3}),
    107: ("ACTIVE", "Client", {"m.example": 2}),
    108: ("Active", "Client", {"w.example": 1}),
    109: ("Inactive", "Client", {"w.example": 2}),
}
PARKED = {
    1: ["p@c1.example", "q@c1.example"],
    2: ["z@c2.example"],
    3: ["s@v.example"],
    4: ["g@gmail.com", "h@c4.example"],
    5: ["harold@c1.example"],
    6: ["m@m.example"],
    7: ["n@none.example"],
    8: ["o@own.example"],
    9: ["w@w.example"],
    10: ["k@prot.example"],
    11: ["t@v2.example"],
    12: ["t@v2.example"],
}


def company_rows():
    return [
        {
            "Company_RecID": c,
            "Company_Name": f"N{c}",
            "Company_Status_Desc": status,
            "Company_Type_Desc": kind,
            "Location": f"L{c}",
        }
        for c, (status, kind, _) in COMPANIES.items()
    ] + [{"Company_RecID": 900, "Company_Name": "Parking", "Location": "L900"}]


def address_rows():
    rows = [(101, 3, 0, 0), (101, 2, 0, 1), (101, 1, 0, 1), (104, 8, 1, 1), (104, 7, 0, 0),
            (103, 6, 0, 0), (103, 5, None, None)]
    return [
        {
            "Company_RecID": c,
            "Company_Address_RecID": a,
            "Site_Name": f"S{a}",
            "Default_Flag": default,
            "Inactive_Flag": inactive,
        }
        for c, a, default, inactive in rows
    ]


@pytest.fixture(scope="module")
def views(make_views):
    contacts, mails = [], []

    def add(contact, company, addresses):
        contacts.append({"Contact_RecID": contact, "Company_RecID": company, "Last_Name": "X"})
        for a in addresses:
            mails.append(
                {
                    "Contact_Communication_RecID": len(mails) + 1,
                    "Contact_RecID": contact,
                    "Communication_Name": "Anything",
                    "Contact_Communication_Desc": a,
                }
            )

    for contact, addresses in PARKED.items():
        add(contact, 900, addresses)
    for company, (_, _, domains) in COMPANIES.items():
        for domain, count in domains.items():
            for _ in range(count):
                add(1000 + len(contacts), company, [f"u@{domain}"])
    return make_views(
        company=company_rows(), contact=contacts, communication=mails, address=address_rows()
    )


@pytest.fixture(scope="module")
def by_contact(views):
    found: dict[int, list[dict]] = {}
    for row in rows_of(move_suggestions(views, PARAMS)):
        found.setdefault(row["Contact_RecID"], []).append(row)
    return found


def test_rows_per_contact(by_contact):
    assert {c: len(rows) for c, rows in by_contact.items()} == {
        1: 8,
        2: 2,
        3: 1,
        4: 4,
        6: 1,
        7: 1,
        8: 1,
        9: 1,
        10: 1,
        11: 1,
        12: 1,
    }


@pytest.mark.parametrize(
    ("contact", "expected"),
    [
        (1, ("Single Match - Active", 101, 35, 0, "Potential Vendor / 3rd Party")),
        (2, ("Single Match - Active", 102, 35, 0, "Potential Vendor / 3rd Party")),
        (3, ("Vendor Match - Active", 103, 70, 1, "Auto-candidate")),
        (6, ("Multiple Match", None, 50, 0,
             "Manual review - suggested company based on highest hit count")),
        (7, ("No Match", None, 0, 0, "No domain match found")),
        (8, ("Own Company Match", 101, 100, 1, "Own company domain match - auto-candidate")),
        (9, ("Multiple Match", None, 35, 0, "Potential Vendor / 3rd Party")),
        (10, ("Do Not Move Domain", None, 0, 0, "Do not move - protected domain rule")),
        (11, ("Vendor / 3rd Party Domain", None, 20, 0,
              "Manual review - vendor domain with no Vendor company match")),
    ],
)
def test_decisions(by_contact, contact, expected):
    columns = (
        "MatchType",
        "MoveToCompanyRecID",
        "ConfidenceScore",
        "ReadyForApiUpdateFlag",
        "MatchResult",
    )
    assert {tuple(r[c] for c in columns) for r in by_contact[contact]} == {expected}


def test_multiple_match(by_contact):
    row = by_contact[6][0]
    assert row["MoveToCompanyRecIDArray"] == "[105,106,107]"
    assert (row["SuggestedMoveToCompanyRecID"], row["SuggestedCompanyName"]) == (106, "N106")
    assert row["CandidateContactCountOnChosenCompany"] == 3
    assert by_contact[9][0]["SuggestedMoveToCompanyRecID"] == 109


def test_pooling_shows_a_company_on_a_public_row(by_contact):
    public = [r for r in by_contact[4] if r["IsPublicDomain"] == 1]
    assert len(public) == 2
    for row in public:
        assert row["MatchType"] == "Public Domain"
        assert (row["SuggestedCompanyName"], row["CompanyStatus"]) == ("N104", "Active")
        assert row["MoveToCompanyRecID"] is None and row["SuggestedMoveToCompanyRecID"] is None
        assert (row["ConfidenceScore"], row["CandidateContactCountOnChosenCompany"]) == (0, 3)
    other = [r for r in by_contact[4] if r["IsPublicDomain"] == 0]
    assert {(r["ConfidenceScore"], r["MoveToCompanyRecID"]) for r in other} == {(70, 104)}


def test_addresses(by_contact):
    # The default one although inactive; else an active one; null flags come last.
    assert {r["MoveToCompanyAddressRecID"] for r in by_contact[4]} == {None, 8}
    assert by_contact[3][0]["MoveToCompanyAddressRecID"] == 6
    assert by_contact[8][0]["MoveToCompanyAddressRecID"] == 3
    assert by_contact[2][0]["MoveToCompanyAddressRecID"] is None


def test_own_company_row(by_contact):
    row = by_contact[8][0]
    assert row["SuggestedCompanyName"] == "Own Company Domain Override"
    assert (row["CompanyCountry"], row["CompanyStatus"]) == ("L900", None)


def test_vendor_handling(by_contact):
    assert by_contact[3][0]["VendorHandlingSuggestion"] == "Ignore or review"
    assert by_contact[11][0]["VendorHandlingSuggestion"] == "Review vendor domain usage"
    assert by_contact[7][0]["VendorHandlingSuggestion"] is None


def test_domain_counts(views):
    found = {tuple(r) for r in domain_counts(views, PARAMS).collect()}
    assert {
        ("v.example", 1, 6),
        ("m.example", 3, 8),
        ("w.example", 2, 3),
        ("c2.example", 1, 4),
    } <= found


def test_sort_tiers(views):
    rows = rows_of(move_suggestions(views, PARAMS))
    seen = list(dict.fromkeys(r["Contact_RecID"] for r in rows))
    # own, protected, single vendor, single (the public row among them by its score),
    # several, vendor without a match, nothing
    assert seen == [8, 10, 3, 4, 1, 2, 6, 9, 11, 12, 7]
    assert rows[-1]["Contact_RecID"] == 7
    tier4 = [r["ConfidenceScore"] for r in rows if r["UniqueMatchingCompanyCount"] == 1][1:]
    assert tier4 == sorted(tier4, reverse=True)


def test_one_row_per_address_on_request(views):
    rows = rows_of(move_suggestions(views, PARAMS, dedupe_output=True))
    addresses = Counter(r["Contact_Communication_RecID"] for r in rows)
    assert len(addresses) == 13 and set(addresses.values()) == {1}
    full = rows_of(move_suggestions(views, PARAMS))
    assert {tuple(r.values()) for r in rows} <= {tuple(r.values()) for r in full}


def test_move_export(views):
    for dedupe in (False, True):
        export = move_export(move_suggestions(views, PARAMS, dedupe_output=dedupe))
        assert export.columns == [
            "Contact_RecID",
            "MoveToCompanyRecID",
            "MoveToCompanyAddressRecID",
            "conflict",
        ]
        assert sorted(map(tuple, export.collect())) == [
            (3, 103, 6, None),
            (4, 104, 8, None),
            (8, 101, 3, None),
        ]


def test_move_export_names_conflicts(views, make_views):
    mail = {
        "Contact_Communication_RecID": 900,
        "Contact_RecID": 4,
        "Contact_Communication_Desc": "h@own.example",
    }
    extra = make_views(communication=[mail])["communication"]
    views = {**views, "communication": views["communication"].unionByName(extra)}
    export = move_export(move_suggestions(views, PARAMS))
    assert sorted(map(tuple, export.where("Contact_RecID = 4").collect())) == [
        (4, 101, 3, "two targets"),
        (4, 104, 8, "two targets"),
    ]


def test_literal_underscore(views):
    params = replace(PARAMS, literal_old=True)
    rows = [r for r in rows_of(move_suggestions(views, params)) if r["Contact_RecID"] == 5]
    assert [r["MatchType"] for r in rows] == ["Single Match - Active"]


def test_collation_of_status_and_type(make_views, views):
    odd = [
        {**r, "Company_Status_Desc": (r.get("Company_Status_Desc") or "").lower(),
         "Company_Type_Desc": r.get("Company_Type_Desc") and r["Company_Type_Desc"].upper()}
        for r in company_rows()
    ]
    views = {**views, "company": make_views(company=odd)["company"]}

    def types(params):
        rows = rows_of(move_suggestions(views, params))
        return {r["Contact_RecID"]: r["MatchType"] for r in rows if r["IsPublicDomain"] == 0}

    assert types(PARAMS)[3] == "Vendor / 3rd Party Domain"
    assert types(PARAMS)[1] == "Single Match - Not Active"
    loose = types(replace(PARAMS, collation="UTF8_LCASE"))
    assert (loose[3], loose[1]) == ("Vendor Match - Active", "Single Match - Active")


def test_candidate_pairs(views):
    catchall = cand.catchall_contacts(views, PARAMS)
    pairs = cand.candidates(catchall, views, PARAMS)
    found = Counter((r["Contact_RecID"], r["CandidateCompanyRecID"]) for r in pairs.collect())
    assert found == {
        (1, 101): 2,
        (2, 102): 2,
        (3, 103): 1,
        (4, 104): 1,
        (6, 105): 1,
        (6, 106): 1,
        (6, 107): 1,
        (9, 108): 1,
        (9, 109): 1,
    }


def test_no_parked_contacts(views):
    assert move_suggestions(views, replace(PARAMS, catch_all_company=5)).count() == 0


@pytest.mark.parametrize("way", ["broadcast", "shuffle", "split"])
def test_long_lists_are_tables(spark, monkeypatch, way):
    """100,000 domains give the same flags as literals, without their literals in the plan."""
    names = [f"d{i}.example" for i in range(100_000)]
    long = MatchParams(0, 1, own_domains=("d5.example",), vendor_domains=tuple(names), public_domains=tuple(names[:2000]))
    domains = [None, "", "d5.example", "d1999.example", "d2000.example", "D7.example", "other.example"]
    rows = [(i, d) for i, d in enumerate([*domains, *["d99999.example"] * 400])]
    df = spark.createDataFrame(rows, "id long, EmailDomain string")
    if way != "broadcast":
        monkeypatch.setattr(domain_module, "BROADCAST_BYTES", 1000)
    if way == "split":
        monkeypatch.setattr(skew, "MIN_ROWS", 50)
        monkeypatch.setattr(sketch, "MIN_BYTES", 0)
    found = domain_module.classify_domains(df, long, spread="id" if way == "split" else None)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "d54321.example" not in plan and len(plan) < 20_000 and ("explode" in plan) == (way == "split")
    flags = {r["id"]: tuple(r)[2:] for r in found.collect()}
    assert found.columns == ["id", "EmailDomain", "IsOwnCompanyDomain", "IsDoNotMoveDomain", "IsPublicDomain", "IsVendorDomain"]
    sets = [{"d5.example"}, set(), set(names[:2000]), set(names)]
    assert flags == {i: tuple(int(d in s) for s in sets) for i, d in rows}
    short = MatchParams(0, 1, own_domains=("d5.example",), vendor_domains=tuple(names[:50]))
    assert domain_module.classify_domains(df, short).where("IsVendorDomain = 1").count() == 1


def test_long_lists_of_companies_are_put_together_from_chunks(spark, views, monkeypatch):
    """Every list of more than two ids is joined from chunks; the cells stay the same."""
    matches = cand.contact_matches(views, PARAMS)
    arrays = sorted(map(tuple, cand.candidate_arrays(matches).collect()))
    report = sorted(map(str, move_suggestions(views, PARAMS, ordered=False).collect()))
    rows = sorted(map(tuple, cand.candidate_companies(matches).collect()))
    listed = [(c, int(i)) for c, cell in arrays for i in cell.strip("[]").split(",")]
    assert rows == sorted(listed) and max(cell.count(",") for _, cell in arrays) >= 2
    monkeypatch.setattr(cand, "IDS", 1)
    long = cand.contact_matches(views, PARAMS)
    assert long.finds.where("ids is not null").isEmpty()
    assert sorted(map(tuple, cand.candidate_arrays(long).collect())) == arrays
    assert sorted(map(str, move_suggestions(views, PARAMS, ordered=False).collect())) == report


def test_a_list_of_a_million_ids(spark, monkeypatch):
    """No array has more than IDS ids on the way."""
    n = 1_000_000
    members = spark.range(n).select((F.col("id") % 3 == 0).alias("k"), (F.col("id") * 7).alias("id"))
    found = dict(cand.id_lists(members.repartition(8), ["k"], n).collect())
    for key, ids in ((True, range(0, n, 3)), (False, (i for i in range(n) if i % 3))):
        assert found[key] == "[" + ",".join(str(7 * i) for i in ids) + "]"


def test_addresses_are_chosen_without_sorting_them(make_views):
    """The default, else an active one, else the lowest id, by a hash aggregate and one lookup."""
    sites = [(1, 5, 0, 0), (1, 6, 1, 1), (1, 7, 1, 0), (2, 9, 0, 1), (2, 8, 0, 1), (3, 4, None, None), (3, 3, 0, 0), (None, 2, 1, 0)]
    names = ("Company_RecID", "Company_Address_RecID", "Default_Flag", "Inactive_Flag")
    views = make_views(address=[dict(zip(names, s, strict=True), Site_Name=f"site {s[1]}") for s in sites])
    chosen = address_choice(views)
    rows = {r["Company_RecID"]: r for r in chosen.collect()}
    assert {c: r["Company_Address_RecID"] for c, r in rows.items()} == {1: 7, 2: 8, 3: 3, None: 2}
    assert all(r["Site_Name"] == f"site {r['Company_Address_RecID']}" for r in rows.values())
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_contacts_with_several_domains_do_not_go_through_the_largest(spark, make_views, monkeypatch):
    """Each contact has an address at one domain of many companies and one of its own: the rows that
    are put together are those of its own domain, and the rows of the large one are written nowhere."""
    contacts, companies = 40, 300
    people = [{"Contact_RecID": i, "Company_RecID": 0} for i in range(contacts)]
    people += [{"Contact_RecID": 1000 + i, "Company_RecID": 10 + i} for i in range(companies)]
    mails = [(i, "a@big.example") for i in range(contacts)] + [(i, f"b@own{i}.example") for i in range(contacts)]
    mails += [(1000 + i, "c@big.example") for i in range(companies)]
    # an own domain has one company that the large one finds too, or one that it doesn't, or both
    people += [{"Contact_RecID": 5000 + i, "Company_RecID": 9000 + i} for i in range(contacts)]
    mails += [(5000 + i, f"d@own{i}.example") for i in range(contacts) if i % 3 != 0]
    mails += [(1000 + i, f"d@own{i}.example") for i in range(contacts) if i % 3 != 1]
    views = make_views(
        company=[{"Company_RecID": c, "Company_Name": f"C{c}"} for c in [0, *range(10, 10 + companies), *range(9000, 9000 + contacts)]],
        contact=people,
        communication=[
            {"Contact_Communication_RecID": n, "Contact_RecID": i, "Contact_Communication_Desc": m}
            for n, (i, m) in enumerate(mails)
        ],
    )
    cells = {
        i: "[" + ",".join(map(str, [*range(10, 10 + companies), *([9000 + i] if i % 3 else [])])) + "]"
        for i in range(contacts)
    }
    written = []
    kept = cand.stage
    monkeypatch.setattr(cand, "stage", lambda df, *rest, **more: written.append(kept(df, *rest, **more)) or written[-1])
    # in one chunk, in chunks, and with some large domains beside each other
    for ids in (1000, 7, 100):
        monkeypatch.setattr(cand, "IDS", ids)
        del written[:]
        matches = cand.contact_matches(views, replace(PARAMS, catch_all_company=0))
        counts = {r["Contact_RecID"]: r["UniqueMatchingCompanyCount"] for r in cand.match_summary(matches).collect()}
        assert counts == {i: c.count(",") + 1 for i, c in cells.items()}
        assert max(t.count() for t in written) < contacts * companies / 10
        assert dict(cand.candidate_arrays(matches).collect()) == cells
        rows = sorted(map(tuple, cand.candidate_companies(matches).collect()))
        assert rows == sorted((i, int(c)) for i, cell in cells.items() for c in cell.strip("[]").split(","))


def test_contacts_with_several_small_or_several_large_domains(spark, make_views, monkeypatch):
    """No domain of a contact finds more than one company, or two find many."""
    finds = {"one": [10], "two": [11], "same": [10], "many": range(10, 20), "more": range(15, 30)}
    asks = {1: ["one", "two"], 2: ["one", "same"], 3: ["many", "more"], 4: ["many", "more", "one"], 5: ["one"], 6: ["more", "two"]}
    people = [{"Contact_RecID": i, "Company_RecID": 0} for i in asks]
    people += [{"Contact_RecID": 100 + c, "Company_RecID": c} for c in range(10, 30)]
    mails = [(i, d) for i, ds in asks.items() for d in ds] + [(100 + c, d) for d, cs in finds.items() for c in cs]
    views = make_views(
        company=[{"Company_RecID": c, "Company_Name": f"C{c}"} for c in [0, *range(10, 30)]],
        contact=people,
        communication=[
            {"Contact_Communication_RecID": n, "Contact_RecID": i, "Contact_Communication_Desc": f"a@{d}.example"}
            for n, (i, d) in enumerate(mails)
        ],
    )
    ids = {i: sorted({c for d in ds for c in finds[d]}) for i, ds in asks.items()}
    for limit in (4096, 3):
        monkeypatch.setattr(cand, "IDS", limit)
        matches = cand.contact_matches(views, replace(PARAMS, catch_all_company=0))
        summary = cand.match_summary(matches).collect()
        assert {(r["Contact_RecID"], r["UniqueMatchingCompanyCount"]) for r in summary} == {(i, len(c)) for i, c in ids.items()}
        assert dict(cand.candidate_arrays(matches).collect()) == {i: f"[{','.join(map(str, c))}]" for i, c in ids.items()}
        rows = sorted(map(tuple, cand.candidate_companies(matches).collect()))
        assert rows == sorted((i, c) for i, cs in ids.items() for c in cs)


def test_lists_join_a_sorted_report(spark, views, monkeypatch):
    """The report keeps its order whether lists are put beside sorted rows or sorted with them."""
    plan = move_suggestions(views, PARAMS)._jdf.queryExecution().optimizedPlan().toString()
    # no sort of rows that have their lists
    assert plan.index("Join LeftOuter") < plan.index("Sort [")
    rows = move_suggestions(views, PARAMS).collect()
    monkeypatch.setattr(cand, "CELLS", 1)
    assert move_suggestions(views, PARAMS).collect() == rows
    monkeypatch.setattr(cand, "LISTS_BYTES", -1)
    assert move_suggestions(views, PARAMS).collect() == rows


def _listing_views(make_views, contacts, companies):
    """Parked contacts of one domain that finds many companies, among others that find none."""
    people = [{"Contact_RecID": i, "Company_RecID": 0} for i in range(4 * contacts)]
    people += [{"Contact_RecID": 10_000 + c, "Company_RecID": 10 + c} for c in range(companies)]
    mails = [(i, "a@many.example" if i % 4 == 0 else f"a@none{i}.example") for i in range(4 * contacts)]
    mails += [(10_000 + c, "b@many.example") for c in range(companies)]
    return make_views(
        company=[{"Company_RecID": c, "Company_Name": f"C{c}"} for c in [0, *range(10, 10 + companies)]],
        contact=people,
        communication=[
            {"Contact_Communication_RecID": n, "Contact_RecID": i, "Contact_Communication_Desc": m}
            for n, (i, m) in enumerate(mails)
        ],
    )


def _ids_per_task(df):
    ids = F.sum(F.size(F.split("MoveToCompanyRecIDArray", ",")))
    return [r["ids"] for r in df.groupBy(F.spark_partition_id()).agg(ids.alias("ids")).collect() if r["ids"]]


@pytest.mark.parametrize("broadcast", [True, False])
def test_long_lists_are_dealt_by_what_they_print(make_views, monkeypatch, broadcast):
    """100 lists of 50 ids: no task has many more ids than CELLS, which a writer may have to hold."""
    params = replace(PARAMS, catch_all_company=0)
    views = _listing_views(make_views, 100, 50)
    whole = sorted(cand.candidate_arrays(cand.contact_matches(views, params)).collect())
    assert [tuple(r) for r in whole] == [(4 * i, f"[{','.join(map(str, range(10, 60)))}]") for i in range(100)]
    monkeypatch.setattr(cand, "CELLS", 500)
    if not broadcast:
        monkeypatch.setattr(cand, "LISTS_BYTES", -1)
    arrays = cand.candidate_arrays(cand.contact_matches(views, params))
    sizes = _ids_per_task(arrays)
    assert sum(sizes) == 5000 and len(sizes) >= 10 and max(sizes) <= 550
    assert sorted(arrays.collect()) == whole


@pytest.mark.parametrize("broadcast", [True, False])
def test_a_sorted_report_is_dealt_by_what_it_prints(make_views, monkeypatch, broadcast):
    """Rows with long lists follow each other in the order; ranges of it have few of them."""
    params = replace(PARAMS, catch_all_company=0)
    views = _listing_views(make_views, 100, 50)
    whole = move_suggestions(views, params).collect()
    assert len(whole) == 400 and len({r["MoveToCompanyRecIDArray"] for r in whole}) == 2
    monkeypatch.setattr(cand, "CELLS", 500)
    if not broadcast:
        monkeypatch.setattr(cand, "LISTS_BYTES", -1)
    sizes = _ids_per_task(move_suggestions(views, params).where("MoveToCompanyRecIDArray is not null"))
    assert sum(sizes) == 5000 and len(sizes) >= 10 and max(sizes) <= 550
    assert move_suggestions(views, params).collect() == whole
    unordered = move_suggestions(views, params, ordered=False).where("MoveToCompanyRecIDArray is not null")
    assert max(_ids_per_task(unordered)) <= 550
