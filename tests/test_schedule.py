"""The schedule of merges can be carried out call by call."""

from __future__ import annotations

import random

import pytest

from tidyroll import duplicate_contacts, merge_schedule
from tidyroll.operators import hot, skew

from .conftest import rows_of


def _views(make_views, contacts, emails):
    return make_views(
        company=[{"Company_RecID": 1, "Company_Name": "A"}],
        contact=[
            {"Contact_RecID": c, "Company_RecID": 1, "Inactive_Flag": inactive, "Default_Flag": primary}
            for c, (inactive, primary) in contacts.items()
        ],
        communication=[
            {
                "Contact_Communication_RecID": i,
                "Contact_RecID": contact,
                "Communication_Name": "Email",
                "Contact_Communication_Desc": f"{email}@x",
            }
            for i, (contact, email) in enumerate(emails)
        ],
    )


def _carry_out(calls, contacts):
    """Make the calls of each component in order; a contact that is merged away is never named."""
    gone, active = set(), {c: not inactive for c, (inactive, _) in contacts.items()}
    steps = {}
    for call in sorted((c for c in calls if c["step"]), key=lambda c: (c["component"], c["step"])):
        steps.setdefault(call["component"], []).append(call["step"])
        named = {call["Contact_RecID"], call["merge_with"]} - {None}
        assert not named & gone, call
        if call["action"] == "MERGE":
            assert active[call["merge_with"]] and not call["conflict"]
            gone.add(call["Contact_RecID"])
        else:
            assert active[call["Contact_RecID"]] == (call["action"] == "DEACTIVATE")
            active[call["Contact_RecID"]] = call["action"] == "ACTIVATE"
    assert all(s == list(range(1, len(s) + 1)) for s in steps.values())
    assert active == {c: not inactive for c, (inactive, _) in contacts.items()}
    return gone


def test_a_survivor_that_is_merged_elsewhere_comes_first(make_views):
    """3 goes into 2, and 2 into 1: in that order, though they are different groups."""
    contacts = {1: (0, 1), 2: (1, 0), 3: (1, 0)}
    views = _views(make_views, contacts, [(3, "b"), (2, "b"), (2, "a"), (1, "a")])
    calls = rows_of(merge_schedule(duplicate_contacts(views, allow_inactive=True)))
    calls.sort(key=lambda c: c["step"])
    assert [(c["component"], c["action"], c["Contact_RecID"], c["merge_with"], c["conflict"]) for c in calls] == [
        (1, "ACTIVATE", 2, None, None),
        (1, "MERGE", 3, 2, None),
        (1, "DEACTIVATE", 2, None, None),
        (1, "MERGE", 2, 1, None),
    ]
    assert _carry_out(calls, contacts) == {2, 3}


def test_two_targets_are_a_conflict(make_views):
    contacts = {1: (1, 0), 2: (0, 0), 3: (1, 0)}
    views = _views(make_views, contacts, [(3, "a"), (1, "a"), (3, "b"), (2, "b")])
    calls = rows_of(merge_schedule(duplicate_contacts(views, allow_inactive=True)))
    assert sorted((c["component"], c["step"] or 0, c["Contact_RecID"], c["merge_with"], c["conflict"]) for c in calls) == [
        (1, 0, 3, 1, "two targets"),
        (1, 1, 3, 2, None),
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_groups(make_views, monkeypatch, seed):
    rng = random.Random(seed)
    contacts = {c: (rng.choice([0, 0, 1, 2]), rng.choice([0, 0, 1])) for c in range(1, 120)}
    emails = [(rng.choice(list(contacts)), rng.randrange(90)) for _ in range(220)]
    emails += [(c, "all") for c in list(contacts)[:40]]  # a group with a large share
    views = _views(make_views, contacts, emails)
    report = duplicate_contacts(views, allow_inactive=True, ordered=False)
    told = {(r["Contact_RecID"], r["merge_with"]) for r in rows_of(report) if r["merge_with"]}
    calls = rows_of(merge_schedule(report))
    merges = {(c["Contact_RecID"], c["merge_with"]) for c in calls if c["action"] == "MERGE"}
    assert merges == told
    assert _carry_out(calls, contacts) == {c for c, _ in told}
    monkeypatch.setattr(skew, "MIN_ROWS", 5)
    monkeypatch.setattr(hot, "SHARE", 5)
    again = rows_of(merge_schedule(duplicate_contacts(views, allow_inactive=True, ordered=False)))
    assert sorted(map(str, again)) == sorted(map(str, calls))


def test_no_duplicates_no_calls(make_views):
    views = _views(make_views, {1: (0, 0)}, [(1, "a")])
    assert merge_schedule(duplicate_contacts(views, allow_inactive=True)).count() == 0
