"""Hot keys are split, and nothing else changes."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidyroll import MatchParams, duplicate_contacts, move_suggestions
from tidyroll.operators import candidates, mailboxes, repeats, sketch, skew


@pytest.fixture
def keyed(spark):
    """9,000 rows: one key has a third, one is null in a ninth, the others have 10 each."""
    key = F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") % 9 != 1, F.col("id") % 500)
    left = spark.range(9_000).select(key.alias("k"), F.col("id"))
    right = left.where("k is not null").groupBy("k").agg(F.sum("id").alias("s"))
    return left, right


def measured(left):
    counts = left.groupBy("k").agg(F.count(F.lit(1)).alias("rows"))
    return skew.key_counts(counts, "rows")["rows"]


def plain(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_split_join_is_the_join(keyed, monkeypatch, how):
    left, right = keyed
    expected = plain(left.join(right, ["k"], how))
    monkeypatch.setattr(skew, "MIN_ROWS", 100)
    monkeypatch.setattr(skew, "SHARE", 50)
    counts = measured(left)
    assert counts.size == 180
    split = skew.split_join(left, right, ["k"], counts, spread="id", how=how)
    assert "explode" in split._jdf.queryExecution().optimizedPlan().toString()
    assert split.columns == ["k", "id", "s"]
    assert plain(split) == expected


def test_split_pairs_are_the_join(keyed, monkeypatch):
    """Hot keys on either side, and on both."""
    left = keyed[0].where("id < 900")
    right = keyed[0].where("id % 7 = 0").withColumnRenamed("id", "other")
    expected = plain(left.join(right, ["k"]))
    monkeypatch.setattr(skew, "SHARE", 10)
    for most in (50, 150, 350, 10_000):
        monkeypatch.setattr(skew, "MIN_ROWS", most)
        counts = measured(left), measured(right)
        pairs = skew.split_pairs(left, right, ["k"], counts, ("id", "other"))
        assert pairs.columns == ["k", "id", "other"]
        assert plain(pairs) == expected


def test_no_hot_key_is_a_plain_join(keyed):
    left, right = keyed
    joined = skew.split_join(left, right, ["k"], measured(left), spread="id")
    assert "explode" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert plain(joined) == plain(left.join(right, ["k"]))


def test_few_keys_are_hot(keyed, monkeypatch):
    """No more than SHARE keys, and no more than 2 * SHARE pieces, whatever the data."""
    left, _ = keyed
    monkeypatch.setattr(skew, "MIN_ROWS", 1)
    for share in (2, 10, 600):
        monkeypatch.setattr(skew, "SHARE", share)
        hot = skew.hot_keys(measured(left), ["k"]).collect()
        assert len(hot) <= share
        assert sum(r[skew._PIECES] for r in hot) <= 2 * share


def test_a_third_in_one_group_is_spread(spark, make_views, monkeypatch):
    """One address of one company has a third of all rows; its rows reach many tasks."""
    rows = 3_000
    n = F.col("id")
    views = make_views(company=[{"Company_RecID": 1, "Company_Name": "A"}])
    views["contact"] = spark.range(rows).select(
        n.alias("Contact_RecID"),
        F.lit(1).cast("bigint").alias("Company_RecID"),
        F.lit("F").alias("First_Name"),
        F.lit("L").alias("Last_Name"),
        (n % 2).cast("int").alias("Inactive_Flag"),
        F.lit(None).cast("int").alias("Default_Flag"),
    )
    address = F.when(n % 3 == 0, "info@x").otherwise(F.concat(F.lit("u"), F.floor(n / 6), F.lit("@x")))
    views["communication"] = spark.range(rows).select(
        n.alias("Contact_Communication_RecID"),
        n.alias("Contact_RecID"),
        F.lit("Email").alias("Communication_Name"),
        address.alias("Contact_Communication_Desc"),
    )
    settings = {
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "20",
    }
    before = {name: spark.conf.get(name) for name in settings}
    whole = plain(duplicate_contacts(views, ordered=False))
    monkeypatch.setattr(skew, "MIN_ROWS", 50)
    monkeypatch.setattr(skew, "SHARE", 100)
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        report = duplicate_contacts(views, ordered=False)
        sizes = [r["count"] for r in report.groupBy(F.spark_partition_id()).count().collect()]
        split = plain(report)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert split == whole
    assert sum(1 for r in whole if r[2] == "info@x") == rows / 3
    assert max(sizes) < rows / 6


def _busy_contact(spark, make_views, addresses):
    """One parked contact with many addresses of one company's domain, and a few others."""
    views = make_views(
        company=[{"Company_RecID": 1, "Company_Name": "Parked"}, {"Company_RecID": 2, "Company_Name": "Two"}],
        contact=[
            {"Contact_RecID": 1, "Company_RecID": 1},
            {"Contact_RecID": 2, "Company_RecID": 2},
            {"Contact_RecID": 3, "Company_RecID": 1},
        ],
    )
    n = F.col("id")
    contact = F.when(n < addresses, 1).when(n < addresses + 3, 2).otherwise(3)
    domain = F.when(n == addresses + 2, "@two.example_old").otherwise("@two.example")
    views["communication"] = spark.range(addresses + 5).select(
        n.alias("Contact_Communication_RecID"),
        contact.cast("bigint").alias("Contact_RecID"),
        F.lit("Email").alias("Communication_Name"),
        F.concat(F.lit("u"), n, domain).alias("Contact_Communication_Desc"),
    )
    return views, MatchParams(catch_all_company=1, own_company=9, own_domains=("own.example",))


@pytest.fixture
def twenty_partitions(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "20"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def _per_task(df):
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


def test_rows_of_a_contact_with_many_addresses_are_dealt(spark, make_views, monkeypatch, twenty_partitions):
    """300 addresses of one contact see two rows of one company: 180,000 rows, in many tasks."""
    views, params = _busy_contact(spark, make_views, 300)
    matches = candidates.contact_matches(views, params)
    assert matches.per_contact.most == 300
    rows = candidates.single_match(matches, views).where("Contact_RecID = 1")
    counts = rows.groupBy("CandidateContactCountOnCompany").count().collect()
    assert sorted(map(tuple, counts)) == [(1, 90_000), (2, 90_000)]
    assert len(_per_task(rows)) == 1  # less than IN_PLACE
    monkeypatch.setattr(repeats, "IN_PLACE", 50_000)
    dealt = candidates.single_match(matches, views)
    sizes = _per_task(dealt.where("Contact_RecID = 1"))
    assert sum(sizes) == 180_000 and len(sizes) > 10 and max(sizes) < 180_000 / 5
    assert dealt.exceptAll(candidates.single_match(matches, views)).isEmpty()


def test_dealt_report_is_the_report(spark, make_views, monkeypatch, twenty_partitions):
    views, params = _busy_contact(spark, make_views, 25)
    whole = plain(move_suggestions(views, params, ordered=False))
    assert len(whole) == 2 * (25**3 + 2**3)
    monkeypatch.setattr(repeats, "IN_PLACE", 100)
    monkeypatch.setattr(repeats, "COPIES", 50)
    report = move_suggestions(views, params, ordered=False)
    sizes = _per_task(report)
    assert len(sizes) > 10 and max(sizes) < len(whole) / 5
    assert plain(report) == whole
    ordered = [tuple(r) for r in move_suggestions(views, params).collect()]
    assert sorted(ordered, key=str) == whole


def test_ordinals_of_dealt_copies(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 1), (2, 9), (3, 10), (4, 11), (5, 95)], "k long, n long")
    expected = [(k, n, i) for k, n in map(tuple, rows.collect()) for i in range(1, n + 1)]
    monkeypatch.setattr(repeats, "COPIES", 10)
    for most in (95, 1 << 30):
        found = repeats.repeat_rows(rows, F.col("n"), "i", most, ["k"])
        assert sorted(map(tuple, found.collect())) == expected


@pytest.mark.parametrize("kind", ["long", "string"])
def test_heavy_keys_are_found(spark, monkeypatch, kind):
    """Keys over the share are found with their counts, whatever the many others are."""
    monkeypatch.setattr(skew, "MIN_ROWS", 100)
    monkeypatch.setattr(sketch, "MIN_BYTES", 0)
    n = F.col("id")
    key = F.when(n % 3 == 0, -1).when(n % 7 == 0, -2).when(n % 5 == 0, None).otherwise(n)
    rows = spark.range(200_000).repartition(9).select(key.cast(kind).alias("k"), "id")
    found = sketch.heavy_keys(rows, "k")
    assert found.size == 100 and found.most == 66_667
    expected = rows.groupBy("k").count().where("k is not null and count >= 100").collect()
    assert sorted(map(tuple, found.keys.collect())) == sorted(map(tuple, expected))
    assert len(expected) == 2
    monkeypatch.setattr(skew, "MIN_ROWS", 70_000)
    assert sketch.heavy_keys(rows, "k").size is None
    assert sketch.heavy_keys(rows.where("id < 0"), "k").size is None
    monkeypatch.setattr(skew, "MIN_ROWS", 100)
    monkeypatch.setattr(sketch, "MIN_BYTES", 64 << 20)
    assert sketch.heavy_keys(rows, "k").size is None  # small enough for one task


def test_a_company_with_a_third_of_the_rows_is_spread(spark, make_views, monkeypatch, twenty_partitions):
    """One company has a third of the contacts, and one contact a third of the communications."""
    rows, n = 6_000, F.col("id")
    views = make_views(company=[{"Company_RecID": c, "Company_Name": f"C{c}"} for c in range(1000)])
    views["contact"] = spark.range(rows).select(
        n.alias("Contact_RecID"),
        F.when(n % 3 == 0, 7).otherwise(n % 999).cast("bigint").alias("Company_RecID"),
        F.lit("F").alias("First_Name"),
        F.lit("L").alias("Last_Name"),
        F.lit(0).alias("Inactive_Flag"),
        F.lit(0).alias("Default_Flag"),
    )
    views["communication"] = spark.range(rows).select(
        n.alias("Contact_Communication_RecID"),
        F.when(n % 3 == 1, 12).otherwise(n).cast("bigint").alias("Contact_RecID"),
        F.lit("Email").alias("Communication_Name"),
        F.concat(F.lit("u"), n % 2500, F.lit("@x")).alias("Contact_Communication_Desc"),
    )
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        whole = plain(mailboxes.email_data(views))
        monkeypatch.setattr(skew, "MIN_ROWS", 40)
        monkeypatch.setattr(sketch, "MIN_BYTES", 0)
        emails = mailboxes.email_data(views)
        sizes = _per_task(emails)
        assert plain(emails) == whole and len(whole) == rows
        assert max(sizes) < 2 * rows / 20
        named = mailboxes.with_company_name(views["contact"], views, "Contact_RecID")
        assert max(_per_task(named)) < 2 * rows / 20
        duplicates = duplicate_contacts(views, ordered=False)
        split = plain(duplicates)
        assert max(_per_task(duplicates)) < 2 * len(split) / 20
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    monkeypatch.undo()
    assert plain(duplicate_contacts(views, ordered=False)) == split


def test_few_rows_that_make_many_pairs_are_dealt(spark, monkeypatch):
    """A key with 300 rows on either side makes 90,000 pairs; no task gets more than a part."""
    left = spark.range(300).select(F.lit(1).alias("k"), F.col("id").alias("a"))
    right = spark.range(300).select(F.lit(1).alias("k"), F.col("id").alias("b"))
    monkeypatch.setattr(skew, "MIN_PAIRS", 2_000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pairs = skew.split_pairs(left, right, ["k"], (measured(left), measured(right)), ("a", "b"))
        sizes = pairs.groupBy(F.spark_partition_id()).count().collect()
        assert pairs.distinct().count() == pairs.count() == 90_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(r["count"] for r in sizes) < 60_000


def test_pairs_stay_dealt_where_partitions_are_merged(spark, monkeypatch):
    """Few rows make many pairs; the partitions aren't merged by the size of these rows."""
    left = spark.createDataFrame([(1, i) for i in range(300)], "k long, a long")
    right = left.withColumnRenamed("a", "b")
    monkeypatch.setattr(skew, "MIN_PAIRS", 2_000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = skew.split_pairs(left, right, ["k"], (measured(left), measured(right)), ("a", "b"))
        sizes = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
        assert pairs.distinct().count() == sum(sizes) == 90_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) >= 4 and max(sizes) < 45_000
