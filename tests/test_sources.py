"""Reading the views, and the folder for intermediate tables."""

from __future__ import annotations

from pathlib import Path
from types import SimpleNamespace

import pytest

from tidyroll import VIEWS, JdbcSource, load_views
from tidyroll.operators import staging
from tidyroll.params import MatchParams
from tidyroll.sources import views as module

from .conftest import SAMPLE, table

CONTACTS = [{"Contact_RecID": 1, "Company_RecID": 2, "Inactive_Flag": 1}]


def frames(spark):
    rows = {"contact": CONTACTS}
    return {v: spark.createDataFrame(table(v, rows.get(v, []))) for v in VIEWS}


def test_parquet_folder(spark, tmp_path):
    for view, df in frames(spark).items():
        # Flags and ids come in other types, and there are columns that no report reads.
        odd = df.selectExpr(
            *(f"cast({c} as boolean) as {c}" if c.endswith("_Flag") else c for c in df.columns),
            "1 as extra",
        )
        odd.write.parquet(str(tmp_path / VIEWS[view][0]))
    views = load_views(spark, str(tmp_path))
    assert views["contact"].dtypes == [
        ("Contact_RecID", "bigint"),
        ("Company_RecID", "bigint"),
        ("First_Name", "string"),
        ("Last_Name", "string"),
        ("Inactive_Flag", "int"),
        ("Default_Flag", "int"),
    ]
    row = views["contact"].first()
    assert (row["Inactive_Flag"], row["Default_Flag"]) == (1, None)


def test_only_used_columns_and_filters_reach_the_scan(spark, tmp_path):
    for view, df in frames(spark).items():
        df.write.parquet(str(tmp_path / VIEWS[view][0]))
    views = load_views(spark, str(tmp_path))
    plan = views["communication"].where("Communication_Name = 'Email'").select("Contact_RecID")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(Communication_Name,Email)" in text
    assert "ReadSchema: struct<Contact_RecID:bigint,Communication_Name:string>" in text


def test_catalog(spark, tmp_path):
    spark.sql(f"create database crm location '{tmp_path}'")
    try:
        for view, df in frames(spark).items():
            df.write.saveAsTable(f"crm.{VIEWS[view][0]}")
        assert load_views(spark, "crm")["contact"].count() == 1
    finally:
        spark.sql("drop database crm cascade")


def test_missing_column(spark):
    views = frames(spark)
    views["contact"] = views["contact"].drop("First_Name")
    with pytest.raises(ValueError, match="First_Name"):
        load_views(spark, views)


class FakeReader:
    """Records the options of a JDBC read and gives prepared rows."""

    def __init__(self, log, frames):
        self.log, self.frames, self.seen = log, frames, {}

    def format(self, name):
        self.seen["format"] = name
        return self

    def option(self, key, value):
        self.seen[key] = value
        return self

    def options(self, **values):
        self.seen.update(values)
        return self

    def load(self):
        self.log.append(self.seen)
        if "query" in self.seen:
            text = self.seen["query"]
            if "Invoices" in text:
                rows = [(None, None, 0, 0)]
            elif "Agreement" in text:
                rows = [(5, 90, 40, 40)] if "keyed" in text else [(0, 25), (85, 15)]
                rows = [("2020-01-01", 25)] if "as day" in text else rows
            else:
                rows = [(5, 90)]
            return SimpleNamespace(first=lambda: rows[0], collect=lambda: rows)
        name = self.seen["dbtable"].split(".")[1]
        return next(df for v, df in self.frames.items() if VIEWS[v][0] == name)

    def jdbc(self, url, name, predicates, properties):
        return self.options(
            url=url, dbtable=name, predicates=predicates, properties=properties
        ).load()


def test_jdbc_reads_in_ranges(spark):
    log: list[dict] = []
    prepared = frames(spark)

    class FakeSession:
        @property
        def read(self):
            return FakeReader(log, prepared)

    source = JdbcSource("jdbc:some:url", partitions=7, properties={"user": "u"})
    views = load_views(FakeSession(), source)
    assert set(views) == set(VIEWS)
    reads = {s["dbtable"]: s for s in log if "dbtable" in s}
    contact = reads["dbo.v_rpt_Contact"]
    assert contact["format"] == "jdbc" and contact["user"] == "u"
    assert contact["partitionColumn"] == "Contact_RecID"
    assert (contact["lowerBound"], contact["upperBound"]) == ("5", "91")
    assert contact["numPartitions"] == "7"
    # An empty table has no bounds.
    assert "partitionColumn" not in reads["dbo.v_rpt_Invoices"]
    assert set(module.SPLIT_COLUMN) == set(VIEWS)
    agreements = reads["dbo.v_rpt_AgreementList"]
    assert agreements["properties"] == {"user": "u", "fetchsize": "10000"}
    assert agreements["predicates"] == [
        "Company_RecID = 5",
        "Company_RecID = 90",
    ]
    assert reads["dbo.v_rpt_Invoices"]["predicates"] == ["Company_RecID is null"]


@pytest.mark.parametrize("busy", [0.0, 0.5, 0.9])
def test_ranges_are_even(busy):
    """A database in the test's own process counts; one company has up to 90 % of the invoices."""
    import duckdb

    from tidyroll.sources.ranges import even_ranges

    db = duckdb.connect()
    db.execute("select setseed(0.5)")
    db.execute(
        f"""create table invoices as select
            case when random() < {busy} then 70000 when random() < 0.3 then (random() * 50)::bigint
                when random() < 0.01 then 4000000000 when random() < 0.01 then null
                else (random() * 1000000)::bigint end as company,
            case when random() < 0.02 then null
                else timestamp '2000-01-01' + to_hours((random() * 50000)::int) end as day
        from range(40000)"""
    )
    seen = []

    def query(text):
        rows = db.execute(text).fetchall()
        seen.append(len(rows))
        return rows

    parts = even_ranges(query, "invoices", "company", "day", 20)
    sizes = [db.execute(f"select count(*) from invoices where {p}").fetchone()[0] for p in parts]
    once = " + ".join(f"coalesce(({p})::int, 0)" for p in parts)
    assert db.execute(f"select count(*) from invoices where {once} <> 1").fetchone()[0] == 0
    assert sum(sizes) == 40_000 and max(sizes) <= 2.5 * 40_000 / 20 and len(parts) <= 60
    assert len(seen) < 80 and max(seen) < 3000


def test_ranges_of_small_tables():
    import duckdb

    from tidyroll.sources.ranges import even_ranges

    db = duckdb.connect()
    db.execute("create table t (k bigint, d date)")
    run = lambda text: db.execute(text).fetchall()
    assert even_ranges(run, "t", "k", "d", 8) == []
    db.execute("insert into t values (null, null)")
    assert even_ranges(run, "t", "k", "d", 8) == ["k is null"]
    db.execute("insert into t values (3, null), (3, null), (-9, date '2020-01-01')")
    parts = even_ranges(run, "t", "k", "d", 8)
    assert [run(f"select count(*) from t where {p}")[0][0] for p in parts] == [1, 1, 2]


def test_stage_writes_to_the_shared_folder(spark):
    df = spark.range(5)
    back = staging.stage(df, "numbers")
    folder = spark.conf.get("spark.checkpoint.dir")
    assert back.inputFiles()[0].removeprefix("file://").startswith(folder)
    assert back.count() == 5 and back.dtypes == df.dtypes


def test_released_tables_are_gone(spark):
    kept = staging.stage(spark.range(3), "kept")
    one = staging.stage(spark.range(4), "one")
    paths = [Path(t.inputFiles()[0].removeprefix("file://")).parent for t in (kept, one)]
    staging.release(spark, one)
    assert paths[0].exists() and not paths[1].exists()
    with staging.released(spark):
        inner = staging.stage(spark.range(2), "inner")
        inside = Path(inner.inputFiles()[0].removeprefix("file://")).parent
        assert inside.exists()
    assert not inside.exists() and paths[0].exists()
    staging.release(spark)
    assert not paths[0].exists()


def _session(**settings):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, *_: settings.get(k.replace(".", "_"))))


def test_staging_needs_no_machine_local_folder():
    """Without a checkpoint folder tables lie in the warehouse, on any kind of master."""
    session = _session(spark_sql_warehouse_dir="hdfs://store/warehouse", spark_master="yarn")
    assert staging.shared_folder(session) == "hdfs://store/warehouse/_staged"


@pytest.mark.parametrize("folder", ["file:/work/warehouse", "/work/warehouse", "spark-warehouse"])
def test_a_local_warehouse_is_refused_on_a_cluster(folder):
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://host"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            staging.shared_folder(_session(spark_sql_warehouse_dir=folder, spark_master=master))
        named = _session(spark_checkpoint_dir="file:///shared/", spark_master=master)
        assert staging.shared_folder(named) == "file:///shared"
    for master in ("local", "local[8]", "local[*]", "local[2,3]"):
        session = _session(spark_sql_warehouse_dir=folder, spark_master=master)
        assert staging.shared_folder(session) == f"{folder}/_staged"


def test_settled_results_leave_nothing_else(spark):
    staging.release(spark)
    kept = staging.stage(spark.range(3), "kept")
    source = staging.stage(spark.range(4), "source")
    folder = Path(staging.shared_folder(spark)) / "tidyroll"

    def step():
        inner = staging.stage(source.where("id > 1"), "inner")
        staging.new_path(spark, "never-written")
        return inner.selectExpr("id * 2 as id")

    result = staging.settled(spark, step, "result", source)
    names = sorted(p.name.rsplit("-", 1)[0] for p in folder.iterdir())
    assert names == ["kept", "result"]
    assert [r["id"] for r in result.orderBy("id").collect()] == [4, 6] and kept.count() == 3
    staging.release(spark)
    assert not list(folder.iterdir())


@pytest.mark.parametrize("report", ["company_cleanup", "dup_any", "export_merges", "merge_schedule", "move_suggestions"])
def test_reports_leave_no_table(spark, report):
    """What a report has staged is gone when its result was written and the block has ended."""
    import __spark_entry__ as entry_point

    staging.release(spark)
    folder = Path(staging.shared_folder(spark)) / "tidyroll"
    with staging.released(spark):
        entry_point.queries()[report](spark, str(SAMPLE)).write.format("noop").mode("overwrite").save()
    assert not list(folder.iterdir())


def test_domain_lists_are_compared_in_lower_case():
    params = MatchParams(0, 1, own_domains=(" Own.Example ",), public_domains=("GMAIL.com",))
    assert params.own_domains == ("own.example",) and params.public_domains == ("gmail.com",)
