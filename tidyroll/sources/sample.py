"""Source views made from order-entry tables, to run and check the reports on.

The SQL text is the same for Spark and for the database that checks the results.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

from ..params import MatchParams, ScoringParams
from .views import load_views

SCORING = ScoringParams(
    exclude_invoices_after=date(2001, 1, 1),
    stale_since=date(2000, 1, 1),
    recent_start=date(1998, 1, 1),
    recent_end=date(2003, 1, 1),
    company_status="Inactive/Gone",
    as_of=date(2001, 1, 1),
)

MATCHING = MatchParams(
    catch_all_company=0,
    own_company=6,
    own_domains=("own.example",),
    protected_domains=("protected.example",),
    vendor_domains=("vendormany.example", "vendorone.example", "vendornone.example"),
)

# Columns that the views read. Given so that no job has to look into the files first.
TABLES = {
    "nation": "n_nationkey int, n_name string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_shipdate timestamp_ntz",
}

VIEW_SQL = {
    "company": """
select c.c_custkey Company_RecID, 'C'||cast(c.c_custkey as string) Company_ID, c.c_name Company_Name,
 case c.c_mktsegment when 'MACHINERY' then 'Vendor' when 'BUILDING' then 'Client, Vendor' when 'HOUSEHOLD' then null else 'Client' end Company_Type_Desc,
 case c.c_custkey%10 when 0 then 'Inactive/Gone' when 1 then 'Inactive' when 2 then null when 3 then 'ACTIVE' else 'Active' end Company_Status_Desc,
 'ACC'||cast(c.c_custkey as string) Account_Nbr, n.n_name Location, date '1995-01-01'+cast(c.c_custkey%2500 as int) Date_Entered, date '1995-01-01'+cast(c.c_custkey%2500+10 as int) Last_Update_UTC
 from customer c join nation n on n.n_nationkey=c.c_nationkey
""",
    "invoices": """
select o_custkey Company_RecID, cast(o_orderdate as date) Date_Invoice, 'INV'||cast(o_orderkey as string) Invoice_Number from orders where o_orderpriority='1-URGENT'
""",
    "agreements": """
select o_custkey Company_RecID, case when o_orderstatus='F' then 'Expired' else 'Active' end Agreement_Status, case when o_orderkey%4=0 then null else cast(o_orderdate as date)+365 end DateEnd from orders where o_orderpriority='2-HIGH' and o_orderkey%2=0
""",
    "service": """
select o_orderkey SR_Service_RecID, o_custkey Company_RecID, cast(o_orderdate as date)+30 Last_Update from orders where o_orderpriority='3-MEDIUM' and o_custkey%3<>0
""",
    "project": """
select l_orderkey SR_Service_RecID, max(cast(l_shipdate as date)) Last_Update from lineitem where l_orderkey%3=0 group by l_orderkey
""",
    "contact": """
select o_orderkey Contact_RecID, case when o_orderkey%20=7 then 0 else o_custkey end Company_RecID, 'F'||cast(o_orderkey%7 as string) First_Name, 'L'||cast(o_orderkey%13 as string) Last_Name,
 case o_orderkey%5 when 0 then 1 when 1 then null when 2 then 1 else 0 end Inactive_Flag, case o_orderkey%6 when 0 then 1 when 1 then null else 0 end Default_Flag from orders
""",
    "communication": """
select o_orderkey*2 Contact_Communication_RecID, o_orderkey Contact_RecID, 'Email' Communication_Name,
 case when o_orderkey%37=0 then null when o_orderkey%41=0 then 'no-at-sign' else case when o_orderkey%29=0 then 'harold' when o_orderkey%31=0 then 'u_old' when o_orderkey%17=0 then ' U'||cast(o_orderkey%3 as string) else 'u'||cast(o_orderkey%3 as string) end||'@'||case when o_orderkey%23=0 then 'own.example' when o_orderkey%23=1 then 'protected.example' when o_orderkey%23=2 then 'gmail.com' when o_orderkey%23=3 then 'vendormany.example'
 when o_orderkey%23=4 and (o_orderkey%20=7 or o_custkey=(select min(c_custkey) from customer where c_mktsegment='MACHINERY' and c_custkey>0)) then 'vendorone.example' when o_orderkey%23=5 and o_orderkey%20=7 then 'vendornone.example'
 when o_orderkey%23=6 then 'c'||cast(o_custkey as string)||'.example_old' when o_orderkey%23=7 then 'nomatch'||cast(o_orderkey as string)||'.example'
 when o_orderkey%23<11 then 'd'||cast(o_custkey%400 as string)||'.example' else 'c'||cast(o_custkey as string)||'.example' end end Contact_Communication_Desc from orders
 union all select o_orderkey*2+1, o_orderkey, case when o_orderkey%2=0 then 'Email' else 'Teams' end, 'x'||cast(o_orderkey%4 as string)||'@c'||cast(o_custkey as string)||'.example' from orders where o_orderkey%9=0
""",
    "address": """
select o_custkey Company_RecID, o_orderkey Company_Address_RecID, o_orderpriority Site_Name, case when o_orderkey%4=0 then 1 else 0 end Default_Flag, case when o_orderkey%3=0 then 1 else 0 end Inactive_Flag from orders where o_orderpriority='4-NOT SPECIFIED'
""",
}


def sample_views(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The eight views over the Parquet tables in `folder`."""
    for table, schema in TABLES.items():
        rows = spark.read.schema(schema).parquet(f"{folder}/{table}.parquet")
        rows.createOrReplaceTempView(table)
    return load_views(spark, {view: spark.sql(sql) for view, sql in VIEW_SQL.items()})
