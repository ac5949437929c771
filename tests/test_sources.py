"""Table scans, sinks and the older layout."""

from decimal import Decimal as D

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ridelake.operators import aggregates, audit
from ridelake.schema import TABLES, table_schema
from ridelake.sources.legacy import upgrade_legacy_schema
from ridelake.sources.tables import load_tables, table_profile, write_report, write_tables


def test_adapter_matches_the_declared_schemas(tables):
    for name in TABLES:
        assert [(f.name, f.dataType) for f in tables[name].schema] == [(f.name, f.dataType) for f in table_schema(name)]


def test_tables_round_trip(spark, seed, folder):
    write_tables(seed, folder)
    loaded = load_tables(spark, folder)
    assert set(loaded) == set(TABLES) and len(loaded) == 14
    assert rows(table_profile(loaded)) == rows(table_profile(seed))
    assert rows(aggregates.revenue_by_city(loaded)) == rows(aggregates.revenue_by_city(seed))


def test_clustered_facts_have_separate_time_ranges(spark, tables, folder):
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    write_tables(tables, folder, ["payments"], cluster=True)
    spark.conf.set("spark.sql.adaptive.enabled", before)
    back = load_tables(spark, folder)["payments"]
    assert back.count() == tables["payments"].count()
    spans = back.groupBy(F.input_file_name()).agg(
        F.min("transaction_date").alias("low"), F.max("transaction_date").alias("high")
    ).orderBy("low").collect()
    assert len(spans) > 1 and all(a.high <= b.low for a, b in zip(spans, spans[1:]))


@pytest.mark.parametrize("fmt", ["parquet", "json", "orc"])
def test_reports_are_written(spark, tables, folder, fmt):
    report = aggregates.platform_revenue(tables)
    write_report(report, f"{folder}/r", fmt, partition_by="date")
    back = spark.read.format(fmt).load(f"{folder}/r")
    assert back.count() == report.count() and "date" in back.columns


def test_unknown_report_format(seed, folder):
    with pytest.raises(ValueError):
        write_report(seed["users"], folder, "xls")


def test_legacy_tables_upgrade(spark, seed):
    old = seed["promo_code"].drop("usage_count", "max_uses").withColumnRenamed("code", "CODE")
    new = upgrade_legacy_schema(old, "promo_code")
    assert [f.dataType for f in new.schema] == [f.dataType for f in table_schema("promo_code")]
    assert rows(new, "promo_id", "code", "usage_count", "max_uses")[0] == (1, "WELCOME50", 0, None)
    places = upgrade_legacy_schema(seed["location"].drop("city"), "location")
    assert rows(places, "city") == [(None,)] * 4


def test_audit_finds_each_kind_of_fault(spark, seed):
    broken = seed.replace(
        users=seed["users"].unionByName(
            seed["users"].where("user_id = 2").withColumn("wallet_balance", F.lit(-1).cast("decimal(10,2)"))
            .withColumn("role", F.lit("pilot")).withColumn("fname", F.lit(None).cast("string"))
        ),
        rides=seed["rides"].withColumn("driver_id", F.lit(77).cast("bigint")),
        location=seed["location"].withColumn("latitude", F.lit(0).cast("decimal(10,7)")).withColumn(
            "longitude", F.lit(0).cast("decimal(10,7)")),
    )
    found = {(r.table_name, r.rule): r.violations for r in audit.constraint_audit(broken).where("violations > 0").collect()}
    assert found == {
        ("users", "not_null fname"): 1, ("users", "check wallet_balance >= 0"): 1, ("users", "domain role"): 1,
        ("users", "unique user_id"): 1, ("users", "unique email"): 1, ("users", "unique phone_number"): 1,
        ("rides", "foreign_key driver_id"): 3, ("location", "check NOT (latitude = 0 AND longitude = 0)"): 4,
    }
    clean = audit.constraint_audit(seed)
    assert clean.where("violations > 0").count() == 0 and clean.count() > 100


def test_report_amounts_stay_decimal(tables):
    types = dict(aggregates.platform_revenue(tables).dtypes)
    assert types["gross_revenue"] == "decimal(38,2)" and types["driver_payouts"] == "decimal(38,4)"
    assert isinstance(aggregates.platform_summary(tables).first().total_revenue, D)
