"""The eight source views: their columns, and how to read them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import even_ranges

ANY = None

# Name of each view at the source, and its columns. A type is given where the
# reports rely on it (ids, 0/1 flags, text); dates stay dates or timestamps as they come.
VIEWS: dict[str, tuple[str, dict[str, str | None]]] = {
    "company": (
        "v_rpt_Company",
        {
            "Company_RecID": "bigint",
            "Company_ID": "string",
            "Company_Name": "string",
            "Company_Type_Desc": "string",
            "Company_Status_Desc": "string",
            "Account_Nbr": "string",
            "Location": "string",
            "Date_Entered": ANY,
            "Last_Update_UTC": ANY,
        },
    ),
    "invoices": (
        "v_rpt_Invoices",
        {"Company_RecID": "bigint", "Date_Invoice": ANY, "Invoice_Number": "string"},
    ),
    "agreements": (
        "v_rpt_AgreementList",
        {"Company_RecID": "bigint", "Agreement_Status": "string", "DateEnd": ANY},
    ),
    "service": (
        "v_rpt_Service",
        {"SR_Service_RecID": "bigint", "Company_RecID": "bigint", "Last_Update": ANY},
    ),
    "project": (
        "v_rpt_Project",
        {"SR_Service_RecID": "bigint", "Last_Update": ANY},
    ),
    "contact": (
        "v_rpt_Contact",
        {
            "Contact_RecID": "bigint",
            "Company_RecID": "bigint",
            "First_Name": "string",
            "Last_Name": "string",
            "Inactive_Flag": "int",
            "Default_Flag": "int",
        },
    ),
    "communication": (
        "v_rpt_ContactCommunication",
        {
            "Contact_Communication_RecID": "bigint",
            "Contact_RecID": "bigint",
            "Communication_Name": "string",
            "Contact_Communication_Desc": "string",
        },
    ),
    "address": (
        "v_rpt_CompanyAddress",
        {
            "Company_RecID": "bigint",
            "Company_Address_RecID": "bigint",
            "Site_Name": "string",
            "Default_Flag": "int",
            "Inactive_Flag": "int",
        },
    ),
}

# The id on which a JDBC read of each view is split.
SPLIT_COLUMN = {
    "company": "Company_RecID",
    "invoices": "Company_RecID",
    "agreements": "Company_RecID",
    "service": "SR_Service_RecID",
    "project": "SR_Service_RecID",
    "contact": "Contact_RecID",
    "communication": "Contact_Communication_RecID",
    "address": "Company_Address_RecID",
}

# The date by which a busy company's rows are cut, where the split column isn't a key.
DAY_COLUMN = {"invoices": "Date_Invoice", "agreements": "DateEnd"}


@dataclass(frozen=True)
class JdbcSource:
    """A database that serves the views. Each view is read in `partitions` ranges of an id.

    Views whose id is a key are read in equal steps. Invoices and agreements, of which one company
    may have most, are counted first, and read in ranges with about equal numbers of rows.
    """

    url: str
    schema: str = "dbo"
    partitions: int = 64
    fetch_size: int = 10_000
    properties: Mapping[str, str] = field(default_factory=dict)


def _conform(df: DataFrame, view: str) -> DataFrame:
    columns = VIEWS[view][1]
    present = {c.lower() for c in df.columns}
    missing = [c for c in columns if c.lower() not in present]
    if missing:
        raise ValueError(f"view {view!r} lacks the columns {missing}")
    return df.select(
        *(F.col(c).cast(t).alias(c) if t else F.col(c).alias(c) for c, t in columns.items())
    )


def _read_jdbc(spark: SparkSession, source: JdbcSource, view: str) -> DataFrame:
    table, split = f"{source.schema}.{VIEWS[view][0]}", SPLIT_COLUMN[view]
    options = {"url": source.url, "fetchsize": str(source.fetch_size), **source.properties}
    if view in DAY_COLUMN:

        def query(text: str) -> list[tuple]:
            found = spark.read.format("jdbc").options(**options).option("query", text).load()
            return [tuple(row) for row in found.collect()]

        parts = even_ranges(query, table, split, DAY_COLUMN[view], source.partitions)
        properties = {"fetchsize": str(source.fetch_size), **source.properties}
        return spark.read.jdbc(
            source.url, table, predicates=parts or [f"{split} is null"], properties=properties
        )
    reader = spark.read.format("jdbc").options(**options)
    low, high = reader.option(
        "query", f"select min({split}) as low, max({split}) as high from {table}"
    ).load().first()
    reader = spark.read.format("jdbc").options(**options).option("dbtable", table)
    if low is not None:
        reader = reader.options(
            partitionColumn=split,
            lowerBound=str(low),
            upperBound=str(high + 1),
            numPartitions=str(source.partitions),
        )
    return reader.load()


def load_views(
    spark: SparkSession, source: str | Mapping[str, DataFrame] | JdbcSource
) -> dict[str, DataFrame]:
    """Read the source views, one DataFrame each, with ids as long and flags as int.

    `source` is a folder or URL with one Parquet table per view (a string with a slash), the
    name of a catalog schema that holds the views as tables, a `JdbcSource`, or a mapping
    from the short view names to DataFrames.
    """

    def read(view: str) -> DataFrame:
        if isinstance(source, JdbcSource):
            return _read_jdbc(spark, source, view)
        if isinstance(source, str):
            name = VIEWS[view][0]
            if "/" in source:
                return spark.read.parquet(f"{source.rstrip('/')}/{name}")
            return spark.table(f"{source}.{name}")
        return source[view]

    return {view: _conform(read(view), view) for view in VIEWS}
