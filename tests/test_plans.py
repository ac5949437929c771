"""Shapes of physical plans, with broadcasts off as for tables beyond any threshold."""

import re
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ridelake import registry
from ridelake.operators import aggregates, common, decisions, events, lifecycle, lists, matching, pricing, ranked, wide
from ridelake.plans import keyed
from ridelake.plans.session import shared_dir
from ridelake.plans.session import stored as store
from ridelake.registry import all_queries
from ridelake.sources import ingest
from ridelake.sources.adapter import spread
from ridelake.sources.feeds import feed
from ridelake.sources.tables import load_tables, write_tables


@pytest.fixture(scope="module")
def stored(spark, tables, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    write_tables(tables, path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    yield load_tables(spark, path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> int:
    return len(re.findall(r"\bExchange ", plan(df)))


def test_no_nested_loops(stored):
    frames = [getattr(module, name)(stored) for module, name in [
        (lists, "driver_profile_complete"), (lists, "users_list"), (wide, "ride_summary"),
        (wide, "full_trip_report"), (wide, "rider_active_ride"), (wide, "rider_ride_history"),
        (wide, "flagged_accounts"), (aggregates, "platform_summary"), (aggregates, "driver_performance"),
        (aggregates, "all_riders_report"), (ranked, "ride_status_timeline"),
    ]]
    pickups = feed(stored, "open_pickups")
    frames += [
        matching.drivers_within_radius(stored, pickups),
        pricing.fare_quote(pricing.trip_estimate(feed(stored, "trips")), stored["fare_rules"]),
        ingest.ingest_registrations(feed(stored, "registrations"), stored["users"])["decided"],
        events.rating_alerts(events.running_ratings(stored["ratings"]), stored["driver"]),
    ]
    for frame in frames:
        text = plan(frame)
        assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_filters_and_columns_reach_the_scan(stored):
    text = plan(aggregates.revenue_report_range(stored, "1997-01-01", "1998-06-30"))
    scan = next(line for line in text.splitlines() if "FileScan" in line)
    assert "EqualTo(payment_status,paid)" in scan and "GreaterThanOrEqual(transaction_date" in scan
    assert "user_id" not in scan and "promo_id" not in scan
    keyed = plan(wide.driver_rides(stored, driver_id=3))
    assert "EqualTo(driver_id,3)" in keyed


def test_payments_combine_before_the_shuffle(stored):
    text = plan(aggregates.paid_per_ride(stored))
    assert text.index("functions=[count") < text.index("Exchange") < text.index("partial_count")


def test_top_per_key_prunes_before_the_shuffle(stored):
    text = plan(ranked.latest_driver_location(stored))
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_leaderboard_is_a_top_k(stored):
    assert "TakeOrderedAndProject" in plan(ranked.driver_leaderboard(stored))


def test_ordinary_keys_take_one_shuffle(stored):
    assert exchanges(events.running_ratings(stored["ratings"])) == 1


def test_hot_keys_are_sliced(stored, monkeypatch):
    """Hot rows are shuffled once, by (key, slice); three small shuffles carry slice summaries."""
    monkeypatch.setattr(keyed, "MIN_HOT_ROWS", 1)
    running = events.running_ratings(stored["ratings"])
    text = re.sub(r"#\d+L?", "", plan(running))
    assert exchanges(running) == 1 + 4
    hot = text[text.index("SortMergeJoin"):]
    moved = [part for part in hot.split("Exchange hashpartitioning")[1:] if "rating_id" in part.split("Exchange")[0]]
    assert len(moved) == 1 and moved[0].startswith("(rated_user_id, _slice")


def test_settlement_deals_requests_by_ride_once(stored, monkeypatch):
    """Joined rides, the paid mark and the first request per ride share a shuffle; nothing is checkpointed."""
    kept = []
    monkeypatch.setattr(decisions, "cut", lambda df: pytest.fail("checkpoint"))
    monkeypatch.setattr(lifecycle, "stored", lambda df: kept.append(df) or df)
    asked = store(feed(stored, "payment_requests"))
    lifecycle.settle_payments(asked, stored["rides"], stored["payments"], stored["promo_code"], "1998-08-02")
    text = re.sub(r"#\d+L?", "", plan(kept[0]))
    window = text[text.index("Window ["):]
    assert "Exchange" not in window[: window.index("SortMergeJoin [ride_id], [_ride], LeftOuter")]
    assert text.count("Exchange hashpartitioning(ride_id, ") == 1


def test_audit_events_read_the_stored_decisions(stored, monkeypatch):
    """What settlement wrote is kept once; its entries and payments are not materialised again to be parsed."""
    for module in (registry, decisions, lifecycle):
        monkeypatch.setattr(module, "cut", lambda df: pytest.fail("checkpoint"))
    parsed = all_queries()["audit_events"].run(stored)
    assert parsed.count() > 0 and parsed.where("NOT reconciled").isEmpty()


def test_stored_rows_are_whole_and_leave_no_shuffle_files(spark):
    files = lambda: {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(
        spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles())}
    before = files()
    some = spark.range(5000).select("id", F.struct((F.col("id") % 7).alias("a")).alias("_key"), F.lit(None).cast("decimal(18,2)").alias("d"))
    kept = store(some.repartition(5, "id"))
    assert kept.dtypes == some.dtypes and rows(kept) == rows(some)
    assert rows(store(some.limit(0))) == []
    for _ in range(40):
        left = [f for f in files() - before if f.startswith("shuffle_")]
        if not left:
            break
        time.sleep(0.5)
    assert left == []
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_only_the_share_window_is_unpartitioned(stored):
    for frame in (ranked.ride_status_timeline(stored), wide.driver_recent_payments(stored), wide.rider_active_ride(stored)):
        assert "Exchange SinglePartition" not in plan(frame)
    assert "Exchange SinglePartition" in plan(ranked.payment_method_breakdown(stored))


def test_no_python_in_plans(stored):
    for frame in (wide.ride_summary(stored), ranked.ride_status_timeline(stored),
                  matching.drivers_within_radius(stored, feed(stored, "open_pickups"))):
        assert "Python" not in plan(frame)


def test_checkpoint_folder_comes_from_the_session(spark):
    folder = shared_dir(spark)
    assert spark.sparkContext.getCheckpointDir() is not None
    assert folder


def test_rider_history_joins_each_dimension_once(stored):
    text = plan(wide.rider_ride_history(stored))
    assert text.count("/vehicles]") == 1


def test_users_are_not_sorted_for_all_keys(stored):
    assert "rangepartitioning" not in plan(wide.payment_history(stored))
    assert "rangepartitioning" in plan(wide.payment_history(stored, user_id=3))


def test_a_deep_page_by_key_sorts_no_row_before_it(stored):
    last = wide.all_rides_page(stored, limit=1, offset=699).first()
    by_key = wide.all_rides_page(stored, limit=50, after=(last.request_time, last.ride_id))
    assert {r.ride_id for r in by_key.collect()} == {r.ride_id for r in wide.all_rides_page(stored, limit=50, offset=700).collect()}
    text = by_key._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(Or(LessThan(request_time" in text
    assert "limit=50" in text and "limit=750" not in text and "Offset" not in text


def test_pages_by_key_reach_every_ride_once(spark):
    rides = spark.createDataFrame(
        [(i, None if i % 4 == 0 else f"2024-01-0{1 + i % 3} 10:00:00") for i in range(25)], "ride_id long, at string"
    ).withColumn("at", F.col("at").cast("timestamp_ntz"))
    order, after, seen = [F.desc("at"), F.asc("ride_id")], None, []
    while True:
        page = common.paginate(rides if after is None else rides.where(common.past("at", "ride_id", after)), order, 4).collect()
        if not page:
            break
        seen += [r.ride_id for r in page]
        after = (page[-1].at, page[-1].ride_id)
    assert seen == [r.ride_id for r in rides.orderBy(*order).collect()]


@pytest.mark.parametrize("name, vehicle_type", [
    ("drivers_within_radius", "economy"), ("premium_drivers_within_10_km", "premium"),
])
def test_registered_radius_searches_ask_for_every_open_pickup(spark, seed, name, vehicle_type):
    first = seed["rides"].first().asDict()
    rides = [first | {"ride_id": i, "ride_status": "requested" if i != 4 else "completed"} for i in (1, 2, 4, 99, 100, 101, 200)]
    t = seed.replace(
        rides=spark.createDataFrame([tuple(r.values()) for r in rides], seed["rides"].schema),
        vehicles=seed["vehicles"].withColumn("vehicle_type", F.lit(vehicle_type)),
    )
    found = rows(all_queries()[name].run(t), "request_id", "driver_id")
    assert sorted(found) == [(i, 1) for i in (1, 2, 99, 100, 101, 200)]
    assert "searched_pickups" not in all_queries()[name].sql and "ride_id % 100 =" not in all_queries()[name].sql


def test_lines_are_dealt_to_more_tasks_as_they_grow(spark):
    lines = spark.range(1000).withColumnRenamed("id", "l_orderkey")
    assert spread(lines, "l_orderkey", 500) is lines
    assert spread(lines, "l_orderkey", 10).rdd.getNumPartitions() == 100
    assert spread(lines, "l_orderkey", 5).rdd.getNumPartitions() == 200


def test_payouts_are_summed_by_driver_and_week_alone(tables):
    plan = tables["driver_payouts"]._jdf.queryExecution().optimizedPlan().toString()
    keys = [re.sub(r"#\d+L?", "", k) for k in re.findall(r"Aggregate \[([^\]]*)\], \[", plan)]
    assert keys == ["driver_id, week"]


def test_refund_decisions_derive_the_payments_once(spark, tables):
    seen = spark.sparkContext.accumulator(0)

    def see(payment):
        seen.add(1)
        return True

    payments = tables["payments"]
    watched = payments.where(F.udf(see, "boolean").asNondeterministic()("payment_id"))
    decided = all_queries()["refund_decisions"].run(tables.replace(payments=watched))
    assert decided.count() == 2 * payments.count()
    assert seen.value == payments.count()
