"""SQL that gives the same rows as each query, for DuckDB.

The statements are written apart from the Spark plans: pairs are joined as they are, ranks are
ordered aggregates or windows, and repeated rows come from joins, not from counts.
"""

from __future__ import annotations

from tidyroll.sources.sample import MATCHING, SCORING, VIEW_SQL


def _in(names: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


_EXCLUDE = f"date '{SCORING.exclude_invoices_after}'"
_STALE = f"date '{SCORING.stale_since}'"
_FROM, _TO = f"date '{SCORING.recent_start}'", f"date '{SCORING.recent_end}'"
_TODAY = f"date '{SCORING.as_of}'"
_DAY = SCORING.stale_since.isoformat()
_PARKING, _OWN = MATCHING.catch_all_company, MATCHING.own_company

# Name of each building block: (blocks it reads, its SQL). Source views are blocks as well.
BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {
    "kept_company": (
        ("company", "invoices"),
        f"""
        select Company_RecID, Company_ID, Company_Name, Company_Type_Desc, Company_Status_Desc,
            Account_Nbr, Location as Company_TerritoryOrCountry,
            Date_Entered as Company_Date_Entered, Last_Update_UTC as Company_Last_Updated_UTC
        from company
        where Company_Status_Desc <> '{SCORING.company_status}'
            and Company_RecID not in
                (select Company_RecID from invoices where Date_Invoice >= {_EXCLUDE})
        """,
    ),
    "newest_invoice": (
        ("invoices",),
        """
        select distinct on (Company_RecID) Company_RecID, Date_Invoice as Last_Invoice_Date,
            Invoice_Number as Last_Invoice_Number
        from invoices
        order by Company_RecID, Date_Invoice desc nulls last, Invoice_Number desc nulls last
        """,
    ),
    "running_agreements": (
        ("agreements",),
        f"""
        select Company_RecID, count(*) as Active_Agreements from agreements
        where Agreement_Status = 'Active' and coalesce(DateEnd, date '9999-12-31') >= {_TODAY}
        group by Company_RecID
        """,
    ),
    "newest_ticket": (
        ("service",),
        "select Company_RecID, max(Last_Update) as Last_Ticket_Updated from service group by 1",
    ),
    "newest_project": (
        ("service", "project"),
        """
        select t.Company_RecID, max(p.Last_Update) as Last_Project_Updated
        from project p join service t using (SR_Service_RecID) group by 1
        """,
    ),
    "flagged": (
        ("kept_company", "newest_invoice", "running_agreements", "newest_ticket", "newest_project"),
        f"""
        select k.*, Last_Invoice_Date, Last_Invoice_Number,
            coalesce(Active_Agreements, 0) as Active_Agreements,
            Last_Ticket_Updated, Last_Project_Updated,
            coalesce(Company_Date_Entered >= {_FROM} and Company_Date_Entered < {_TO}, false)::int
                as Recently_Added_Flag,
            (coalesce(Last_Invoice_Date, date '0001-01-01') < {_STALE})::int
                as No_Invoice_Since_Stale_Flag,
            (coalesce(Last_Ticket_Updated, date '0001-01-01') < {_STALE})::int
                as No_Ticket_Since_Stale_Flag,
            (coalesce(Last_Project_Updated, date '0001-01-01') < {_STALE})::int
                as No_Project_Since_Stale_Flag,
            (Active_Agreements is null)::int as No_Active_Agreements_Flag
        from kept_company k
            left join newest_invoice using (Company_RecID)
            left join running_agreements using (Company_RecID)
            left join newest_ticket using (Company_RecID)
            left join newest_project using (Company_RecID)
        """,
    ),
    "scored": (
        ("flagged",),
        """
        select *, (40 * No_Invoice_Since_Stale_Flag + 25 * No_Active_Agreements_Flag
            + 20 * No_Ticket_Since_Stale_Flag + 15 * No_Project_Since_Stale_Flag
            - 15 * Recently_Added_Flag)::int as Cleanup_Score
        from flagged
        """,
    ),
    "cleanup": (
        ("scored",),
        f"""
        select Company_RecID, Company_Name, Company_Type_Desc,
            Company_Status_Desc as Company_Status, Account_Nbr as Company_Account_Number,
            Company_TerritoryOrCountry as Company_Territory_Country, Company_Date_Entered,
            if(Recently_Added_Flag = 1, 'Recently Added', 'Not Recent') as Recently_Added,
            Recently_Added_Flag, Company_Last_Updated_UTC,
            Last_Invoice_Date as Last_Invoice_Sent_Date, Last_Invoice_Number, Active_Agreements,
            Last_Ticket_Updated, Last_Project_Updated,
            case (No_Invoice_Since_Stale_Flag,
                  No_Ticket_Since_Stale_Flag + No_Project_Since_Stale_Flag = 2,
                  No_Active_Agreements_Flag)
                when (1, true, 0) then 'GREEN - Zombie (no invoice/ticket/project since {_DAY})'
                when (1, true, 1) then 'GREEN - Zombie (no invoice/ticket/project since {_DAY})'
                when (1, false, 1) then 'RED - 0 active agreements + no invoice since {_DAY}'
                when (1, false, 0) then 'YELLOW - Active agreements but no invoice since {_DAY}'
                else 'OK / Needs review' end as Cleanup_Bucket,
            Cleanup_Score,
            case when Cleanup_Score < 25 then 'Keep'
                when Cleanup_Score < 45 then 'Low priority: keep, revisit later'
                when Cleanup_Score < 70 then 'Review: likely cleanup / confirm ownership + billing'
                else 'Strong candidate: set Inactive/Gone (after quick check)'
                end as Cleanup_Recommendation,
            No_Invoice_Since_Stale_Flag, No_Active_Agreements_Flag, No_Ticket_Since_Stale_Flag,
            No_Project_Since_Stale_Flag
        from scored
        """,
    ),
    "emails": (
        ("communication", "contact", "company"),
        """
        select p.Company_RecID, o.Company_Name,
            lower(trim(m.Contact_Communication_Desc, ' ')) as EmailAddress,
            p.Contact_RecID, p.First_Name, p.Last_Name,
            coalesce(p.Inactive_Flag, 0)::int as Contact_InactiveFlag,
            coalesce(p.Default_Flag, 0)::int as Primary_Contact,
            m.Contact_Communication_RecID
        from contact p join company o using (Company_RecID) join communication m using (Contact_RecID)
        where m.Communication_Name = 'Email' and m.Contact_Communication_Desc is not null
        """,
    ),
    "survivor": (
        ("emails",),
        """
        select Company_RecID, EmailAddress, count(*) as members,
            first(Contact_RecID order by Contact_InactiveFlag <> 0, Primary_Contact <> 1,
                Contact_RecID) as any_one,
            first(Contact_RecID order by Primary_Contact <> 1, Contact_RecID)
                filter (where Contact_InactiveFlag = 0) as active_one
        from emails group by all
        """,
    ),
    "doubles": (
        ("emails", "survivor"),
        """
        select e.*, s.any_one, s.active_one
        from emails e join survivor s using (Company_RecID, EmailAddress) where s.members > 1
        """,
    ),
    "doubles_active": (
        ("doubles",),
        """
        select * exclude (any_one, active_one),
            if(Contact_RecID = active_one, 'PRIMARY', active_one::varchar) as merge_with
        from doubles
        """,
    ),
    "doubles_any": (
        ("doubles",),
        """
        select * exclude (any_one, active_one), nullif(any_one, Contact_RecID) as merge_with,
            if(Contact_RecID = any_one, 'PRIMARY', 'MERGE') as merge_action
        from doubles
        """,
    ),
    "merges": (
        ("doubles_active",),
        """
        select Contact_RecID, merge_with::bigint as merge_with,
            nullif(concat_ws(', ',
                case when (select count(distinct o.merge_with) from doubles_active o
                    where o.Contact_RecID = d.Contact_RecID and o.merge_with <> 'PRIMARY') > 1
                    then 'two targets' end,
                case when exists (from doubles_active o
                    where o.Contact_RecID = d.Contact_RecID and o.merge_with = 'PRIMARY')
                    then 'also a survivor' end), '') as conflict
        from doubles_active d where merge_with <> 'PRIMARY'
        """,
    ),
    "calls": (
        ("doubles_any",),
        """
        select distinct s.Company_RecID, s.EmailAddress, v.step, v.action, s.Contact_RecID,
            null::bigint as merge_with
        from doubles_any s
            join doubles_any m on m.Company_RecID = s.Company_RecID
                and m.EmailAddress = s.EmailAddress and m.merge_with = s.Contact_RecID
            cross join (values (1, 'ACTIVATE'), (3, 'DEACTIVATE')) v(step, action)
        where s.Contact_InactiveFlag <> 0
        union all
        select distinct Company_RecID, EmailAddress, 2, 'MERGE', Contact_RecID, merge_with
        from doubles_any where merge_with is not null
        """,
    ),
    "schedule": (
        ("doubles_any",),
        """
        with recursive edge as (
            select distinct Contact_RecID as x, merge_with as w from doubles_any
            where merge_with is not null),
        way as (from edge union all select w, x from edge),
        reach(n, m) as (select x, x from way union select way.w, reach.m from reach join way on way.x = reach.n),
        member as (select n, min(m) as component from reach group by n),
        flags as (select distinct Contact_RecID as w, Contact_InactiveFlag <> 0 as inactive,
            Primary_Contact <> 1 as ordinary from doubles_any),
        told as (
            select *, row_number() over (partition by x order by inactive, ordinary, w) = 1 as made
            from edge join flags using (w) join member on n = x),
        call as (
            select component, inactive, ordinary, w, 2 as phase, 'MERGE' as action, x, w as merge_with
            from told where made
            union all
            select distinct component, inactive, ordinary, w, v.phase, v.action, w, null::bigint
            from told cross join (values (1, 'ACTIVATE'), (3, 'DEACTIVATE')) v(phase, action)
            where made and inactive)
        select component, row_number() over (partition by component
                order by inactive desc, ordinary desc, w desc, phase, x) as step,
            action, x as Contact_RecID, merge_with, null::varchar as conflict
        from call
        union all
        select component, null, 'MERGE', x, w, 'two targets' from told where not made
        """,
    ),
    "mailbox": (
        ("communication", "contact"),
        """
        select p.*, m.Contact_Communication_RecID, m.Contact_Communication_Desc as EmailAddress,
            lower(trim(regexp_replace(m.Contact_Communication_Desc, '^[^@]*@', ''), ' '))
                as EmailDomain,
            regexp_replace(EmailDomain, '.old$', '') as NormalizedEmailDomain
        from communication m join contact p using (Contact_RecID)
        where m.Contact_Communication_Desc like '%@%'
            and not regexp_matches(lower(m.Contact_Communication_Desc), '.old@')
        """,
    ),
    "parked": (
        ("mailbox", "company"),
        f"""
        select b.Contact_RecID, b.Company_RecID as CurrentCompanyRecID,
            o.Company_Name as CurrentCompanyName, o.Location as CurrentCompanyCountry,
            b.First_Name, b.Last_Name, b.Inactive_Flag as ContactInactiveFlag,
            b.Contact_Communication_RecID, b.EmailAddress, b.EmailDomain, b.NormalizedEmailDomain,
            (b.EmailDomain in {_in(MATCHING.own_domains)})::int as IsOwnCompanyDomain,
            (b.EmailDomain in {_in(MATCHING.protected_domains)})::int as IsDoNotMoveDomain,
            (b.EmailDomain in {_in(MATCHING.public_domains)})::int as IsPublicDomain,
            (b.EmailDomain in {_in(MATCHING.vendor_domains)})::int as IsVendorDomain
        from mailbox b join company o using (Company_RecID) where b.Company_RecID = {_PARKING}
        """,
    ),
    "usage": (
        ("mailbox", "company"),
        f"""
        select b.Company_RecID, o.Company_Name, o.Company_Status_Desc, o.Company_Type_Desc,
            o.Location as CompanyCountry, b.EmailDomain, b.NormalizedEmailDomain,
            count(*) as CandidateContactCountOnCompany
        from mailbox b join company o using (Company_RecID)
        where b.Company_RecID <> {_PARKING} group by all
        """,
    ),
    "site": (
        ("address",),
        """
        select distinct on (Company_RecID) Company_RecID, Company_Address_RecID, Site_Name,
            Default_Flag::int as Default_Flag, Inactive_Flag::int as Inactive_Flag
        from address
        order by Company_RecID, coalesce(Default_Flag = 1, false) desc,
            coalesce(Inactive_Flag = 0, false) desc, Company_Address_RecID
        """,
    ),
    "totals": (
        ("usage",),
        """
        select MatchDomain,
            count(distinct Company_RecID) as DomainCompanyCountAcrossAllCompanies,
            sum(CandidateContactCountOnCompany)::bigint as DomainContactCountAcrossAllCompanies
        from (
            select *, NormalizedEmailDomain as MatchDomain from usage
            union all
            select *, EmailDomain as MatchDomain from usage where contains(Company_Type_Desc, 'Vendor')
        ) group by MatchDomain
        """,
    ),
    "pairs": (
        ("parked", "usage", "site"),
        """
        select k.Contact_RecID, k.EmailDomain, k.NormalizedEmailDomain,
            u.Company_RecID as CandidateCompanyRecID, u.Company_Name as CandidateCompanyName,
            u.Company_Status_Desc as CandidateCompanyStatus,
            u.Company_Type_Desc as CandidateCompanyType,
            u.CompanyCountry as CandidateCompanyCountry, u.CandidateContactCountOnCompany,
            s.Company_Address_RecID as CandidateCompanyAddressRecID
        from (from parked where IsOwnCompanyDomain + IsDoNotMoveDomain + IsPublicDomain = 0) k
            join usage u on if(k.IsVendorDomain = 1,
                u.EmailDomain = k.EmailDomain and contains(coalesce(u.Company_Type_Desc, ''), 'Vendor'),
                u.NormalizedEmailDomain = k.NormalizedEmailDomain)
            left join site s on s.Company_RecID = u.Company_RecID
        """,
    ),
    "favourite": (
        ("pairs",),
        """
        select distinct on (Contact_RecID) Contact_RecID,
            CandidateCompanyRecID as SuggestedMoveToCompanyRecID,
            CandidateCompanyName as SuggestedCompanyName,
            CandidateCompanyStatus as SuggestedCompanyStatus,
            CandidateCompanyType as SuggestedCompanyType,
            CandidateCompanyCountry as SuggestedCompanyCountry,
            CandidateCompanyAddressRecID as SuggestedMoveToCompanyAddressRecID,
            CandidateContactCountOnCompany as SuggestedCompanyHitCount
        from pairs
        order by Contact_RecID, CandidateContactCountOnCompany desc,
            coalesce(upper(CandidateCompanyStatus) = 'ACTIVE', false) desc, CandidateCompanyRecID
        """,
    ),
    "counted": (
        ("parked", "pairs"),
        """
        select k.*,
            (select count(distinct CandidateCompanyRecID) from pairs p
                where p.Contact_RecID = k.Contact_RecID) as UniqueMatchingCompanyCount,
            (select min(CandidateCompanyRecID) from pairs p
                where p.Contact_RecID = k.Contact_RecID) as SingleMatchCompanyRecID
        from parked k
        """,
    ),
    "lone": (
        ("counted", "pairs"),
        """
        select p.* exclude (EmailDomain, NormalizedEmailDomain)
        from pairs p join counted c using (Contact_RecID) where c.UniqueMatchingCompanyCount = 1
        """,
    ),
    "lists": (
        ("pairs",),
        """
        select Contact_RecID,
            '[' || array_to_string(list_sort(list(distinct CandidateCompanyRecID)), ',') || ']'
                as MoveToCompanyRecIDArray
        from pairs group by Contact_RecID
        """,
    ),
    "vendor_use": (
        ("parked",),
        """
        select EmailDomain, count(*) as VendorDomainContactCountInCatchAll
        from parked where IsVendorDomain = 1 group by 1
        """,
    ),
    "picked": (
        ("counted", "lone", "lists", "favourite", "vendor_use", "totals", "site"),
        f"""
        select c.*, a.MoveToCompanyRecIDArray as ids, t.DomainCompanyCountAcrossAllCompanies,
            t.DomainContactCountAcrossAllCompanies, v.VendorDomainContactCountInCatchAll,
            (select Company_Address_RecID from site where Company_RecID = {_OWN}) as own_site,
            if(l.Contact_RecID is null,
                {{'id': f.SuggestedMoveToCompanyRecID, 'name': f.SuggestedCompanyName,
                  'status': f.SuggestedCompanyStatus, 'type': f.SuggestedCompanyType,
                  'country': f.SuggestedCompanyCountry,
                  'site': f.SuggestedMoveToCompanyAddressRecID, 'k': f.SuggestedCompanyHitCount}},
                {{'id': l.CandidateCompanyRecID, 'name': l.CandidateCompanyName,
                  'status': l.CandidateCompanyStatus, 'type': l.CandidateCompanyType,
                  'country': l.CandidateCompanyCountry,
                  'site': l.CandidateCompanyAddressRecID,
                  'k': l.CandidateContactCountOnCompany}}) as pick,
            case when IsOwnCompanyDomain = 1 then 'O' when IsDoNotMoveDomain = 1 then 'D'
                when IsPublicDomain = 1 then 'P'
                else if(IsVendorDomain = 1, 'V', 'N') || least(UniqueMatchingCompanyCount, 2)
                end as kase
        from counted c
            left join lone l using (Contact_RecID) left join lists a using (Contact_RecID)
            left join favourite f using (Contact_RecID)
            left join vendor_use v on v.EmailDomain = c.EmailDomain
            left join totals t on t.MatchDomain =
                if(c.IsVendorDomain = 1, c.EmailDomain, c.NormalizedEmailDomain)
        """,
    ),
    "wide": (
        ("picked",),
        """
        select *, coalesce(pick.k, 0) as k, coalesce(VendorDomainContactCountInCatchAll, 0) as v,
            coalesce(upper(pick.status) = 'ACTIVE', false) as act
        from picked
        """,
    ),
    "rulebook": (
        (),
        """
        select * from (values
            ('O', 'Own Company Match', 'Own company domain match - auto-candidate'),
            ('D', 'Do Not Move Domain', 'Do not move - protected domain rule'),
            ('P', 'Public Domain', 'Public domain - manual review'),
            ('V0', 'Vendor / 3rd Party Domain',
                'Manual review - vendor domain with no Vendor company match'),
            ('V1', 'Vendor Match', 'Auto-candidate'),
            ('V2', 'Vendor Multiple Match', 'Manual review - multiple Vendor company matches'),
            ('N0', 'No Match', 'No domain match found'),
            ('N1', 'Single Match', 'Auto-candidate'),
            ('N2', 'Multiple Match', 'Manual review - suggested company based on highest hit count')
        ) r(kase, label, result)
        """,
    ),
    "moves": (
        ("wide", "rulebook"),
        f"""
        select Contact_RecID, CurrentCompanyRecID, CurrentCompanyName, CurrentCompanyCountry,
            First_Name, Last_Name, ContactInactiveFlag, Contact_Communication_RecID, EmailAddress,
            EmailDomain, NormalizedEmailDomain, IsOwnCompanyDomain, IsDoNotMoveDomain,
            IsPublicDomain, IsVendorDomain, UniqueMatchingCompanyCount,
            label || case when kase not in ('V1', 'N1') then ''
                when act then ' - Active' else ' - Not Active' end as MatchType,
            case when kase = 'O' then {_OWN} when kase in ('V1', 'N1') then pick.id end::bigint
                as MoveToCompanyRecID,
            case when kase = 'O' then own_site when kase in ('V1', 'N1') then pick.site end
                as MoveToCompanyAddressRecID,
            case when kase in ('V2', 'N2') then ids end as MoveToCompanyRecIDArray,
            if(kase = 'O', 'Own Company Domain Override', pick.name) as SuggestedCompanyName,
            case when kase = 'O' then {_OWN} when kase not in ('D', 'P') then pick.id end::bigint
                as SuggestedMoveToCompanyRecID,
            case when kase = 'O' then own_site when kase not in ('D', 'P') then pick.site end
                as SuggestedMoveToCompanyAddressRecID,
            if(kase = 'O', CurrentCompanyCountry, pick.country) as CompanyCountry,
            pick.status as CompanyStatus, pick.type as CompanyType,
            pick.k as CandidateContactCountOnChosenCompany,
            DomainCompanyCountAcrossAllCompanies, DomainContactCountAcrossAllCompanies,
            VendorDomainContactCountInCatchAll,
            case when IsVendorDomain = 0 then null when v < 2 then 'Ignore or review'
                when v < 5 then 'Review vendor domain usage'
                else 'Create Vendor company candidate' end as VendorHandlingSuggestion,
            (case kase when 'O' then 100
                when 'V0' then if(v >= 5, 35, if(v >= 2, 20, 10))
                when 'V1' then if(act, 60, 40) + if(k >= 5, 20, if(k >= 3, 10, 0))
                when 'N1' then if(act, 60, 40) + if(k >= 5, 20, if(k >= 3, 10, -25))
                when 'V2' then if(act, 35, 25) + if(k >= 5, 25, if(k >= 3, 15, if(k = 2, 10, 0)))
                when 'N2' then if(act, 35, 25) + if(k >= 5, 25, if(k >= 3, 15, if(k = 2, 10, 0)))
                else 0 end)::int as ConfidenceScore,
            (kase in ('O', 'V1') or (kase = 'N1' and k >= 3))::int as ReadyForApiUpdateFlag,
            if(kase in ('N1', 'N2') and k < 3, 'Potential Vendor / 3rd Party', result) as MatchResult
        from wide join rulebook using (kase)
        """,
    ),
    "ready": (
        ("moves",),
        """
        with r as (
            select distinct Contact_RecID, MoveToCompanyRecID, MoveToCompanyAddressRecID
            from moves where ReadyForApiUpdateFlag = 1)
        select *, case when count(*) over (partition by Contact_RecID) > 1 then 'two targets'
            when MoveToCompanyAddressRecID is null then 'no address id' end as conflict
        from r
        """,
    ),
}

# Final statement of each query, over the blocks it reads.
STATEMENTS: dict[str, tuple[tuple[str, ...], str]] = {
    "company_base": (("kept_company",), "from kept_company"),
    "last_invoice": (("newest_invoice",), "from newest_invoice"),
    "active_agreements": (("running_agreements",), "from running_agreements"),
    "last_ticket": (("newest_ticket",), "from newest_ticket"),
    "last_project": (("newest_project",), "from newest_project"),
    "cleanup_flags": (("flagged",), "from flagged"),
    "company_cleanup": (("cleanup",), "from cleanup"),
    "email_data": (("emails",), "from emails"),
    "dup_keys": (
        ("emails",),
        "select Company_RecID, EmailAddress from emails group by all having count(*) > 1",
    ),
    "winners": (
        ("survivor",),
        """select Company_RecID, EmailAddress, active_one as merge_with,
            any_one as winner_contact_recid from survivor""",
    ),
    "dup_active": (("doubles_active",), "from doubles_active"),
    "dup_any": (("doubles_any",), "from doubles_any"),
    "export_merges": (("merges",), "from merges"),
    "merge_plan": (("calls",), "from calls"),
    "merge_schedule": (("schedule",), "from schedule"),
    "email_domains": (
        ("mailbox",),
        """select Contact_RecID, Contact_Communication_RecID, EmailAddress, EmailDomain,
            NormalizedEmailDomain from mailbox""",
    ),
    "domain_classes": (
        ("mailbox",),
        f"""select distinct EmailDomain,
            (EmailDomain in {_in(MATCHING.own_domains)})::int as IsOwnCompanyDomain,
            (EmailDomain in {_in(MATCHING.protected_domains)})::int as IsDoNotMoveDomain,
            (EmailDomain in {_in(MATCHING.public_domains)})::int as IsPublicDomain,
            (EmailDomain in {_in(MATCHING.vendor_domains)})::int as IsVendorDomain
        from mailbox""",
    ),
    "catchall_contacts": (("parked",), "from parked"),
    "other_company_domains": (("usage",), "from usage"),
    "address_choice": (("site",), "from site"),
    "domain_counts": (("totals",), "from totals"),
    "candidates": (("pairs",), "from pairs"),
    "best_match": (("favourite",), "from favourite"),
    "match_summary": (("counted",), "from counted"),
    "single_match": (("lone",), "from lone"),
    "candidate_arrays": (("lists",), "from lists"),
    "candidate_companies": (
        ("pairs",),
        "select distinct Contact_RecID, CandidateCompanyRecID from pairs",
    ),
    "vendor_domain_counts": (("vendor_use",), "from vendor_use"),
    "move_suggestions": (("moves",), "from moves"),
    "export_moves": (("ready",), "from ready"),
}


def statement(name: str, over_sample: bool = True) -> str:
    """SQL of a query. `over_sample` makes the source views from the sample tables; without
    it they have to exist in the database."""
    needed: dict[str, str] = {}

    def add(block: str) -> None:
        if block in needed:
            return
        if block in VIEW_SQL:
            if over_sample:
                needed[block] = VIEW_SQL[block]
            return
        reads, sql = BLOCKS[block]
        for other in reads:
            add(other)
        needed[block] = sql

    reads, final = STATEMENTS[name]
    for block in reads:
        add(block)
    parts = ",\n".join(f"{block} as ({sql.strip()})" for block, sql in needed.items())
    body = final if not final.startswith("from ") else "select * " + final
    return f"with {parts}\n{body}"
