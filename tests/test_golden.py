"""Hand-derived results on the seed rows."""

from decimal import Decimal as D

from conftest import NOW, rows
from pyspark.sql import functions as F

from ridelake.operators import aggregates, lists, matching, pricing, ranked, wide
from ridelake.schema import TABLES, table_schema


def test_seed_has_all_tables(seed):
    counts = {name: seed[name].count() for name in TABLES}
    assert counts["users"] == 6 and counts["ride_history"] == 12 and counts["ratings"] == 4
    for name in TABLES:
        assert [f.dataType for f in seed[name].schema] == [f.dataType for f in table_schema(name)]


def test_platform_summary(seed):
    row = aggregates.platform_summary(seed).first().asDict()
    assert row == {
        "total_users": 6, "total_riders": 3, "total_rides": 3, "completed_rides": 2,
        "cancelled_rides": 1, "active_rides": 0, "total_revenue": D("850.00"),
        "platform_commission": D("170.0000"), "driver_payouts": D("680.0000"), "total_drivers": 2,
        "verified_drivers": 2, "pending_verification": 0, "online_drivers": 1,
    }


def test_top_drivers(seed):
    assert rows(wide.top_drivers(seed), "driver_id") == [(1,)]
    before = seed.replace(
        driver=seed["driver"].withColumn("average_rating", F.lit("4.5").cast("decimal(3,2)"))
    )
    assert rows(wide.top_drivers(before)) == []


def test_leaderboard(seed):
    got = ranked.driver_leaderboard(seed).select("driver_id", "average_rating", "total_trips").collect()
    assert [tuple(r) for r in got] == [(1, D("5.00"), 120), (2, D("4.00"), 85)]


def test_rides(seed):
    assert wide.active_rides(seed).count() == 0
    assert rows(wide.ride_summary(seed), "ride_id", "duration_minutes") == [(1, 20), (2, 27), (3, None)]


def test_revenue_by_city(seed):
    assert rows(aggregates.revenue_by_city(seed), "city", "total_rides", "total_revenue") == [
        (None, 2, D("850.00"))
    ]
    assert aggregates.revenue_by_city(seed, include_null=False).count() == 0


def test_driver_performance(seed):
    assert rows(aggregates.driver_performance(seed), "driver_id", "total_complaints", "total_earnings") == [
        (1, 1, D("280.0000")), (2, 0, D("400.0000"))
    ]


def test_all_riders_report(seed):
    got = rows(aggregates.all_riders_report(seed), "user_id", "total_rides", "completed_rides", "total_spent")
    assert got == [(2, 2, 1, D("350.00")), (3, 1, 1, D("500.00")), (6, 0, 0, D("0.00"))]


def test_low_rated_and_methods(seed):
    assert aggregates.low_rated_drivers(seed).count() == 0
    assert rows(ranked.payment_method_breakdown(seed)) == [
        ("cash", 1, D("350.00"), 50.0), ("wallet", 1, D("500.00"), 50.0)
    ]


def test_nearest_driver_at_a_drivers_position(spark, seed):
    requests = spark.createDataFrame([(7, "24.8607", "67.0011")], "request_id BIGINT, pickup_lat STRING, pickup_lng STRING")
    assert rows(matching.nearest_driver(seed, requests)) == [(7, 1, D("0.00"))]


def test_trip_estimates(spark, seed):
    at = {r.location_id: (r.latitude, r.longitude) for r in seed["location"].collect()}
    trips = spark.createDataFrame(
        [(1, *at[1], *at[2]), (2, *at[3], *at[4])],
        "trip_id BIGINT, pickup_lat DECIMAL(10,7), pickup_lng DECIMAL(10,7), "
        "dropoff_lat DECIMAL(10,7), dropoff_lng DECIMAL(10,7)",
    )
    assert rows(pricing.trip_distances(trips), "trip_id", "haversine_km") == [
        (1, D("11.0297")), (2, D("7.1572"))
    ]
    assert rows(pricing.trip_estimate(trips), "trip_id", "distance_km", "duration_min") == [
        (1, D("11.0"), 26), (2, D("7.2"), 17)
    ]


def _trips(spark, *items):
    return spark.createDataFrame(
        [(i, kind, D(km) if km else None, minutes, at) for i, (kind, km, minutes, at) in enumerate(items)],
        "trip_id BIGINT, vehicle_type STRING, distance_km DECIMAL(10,2), duration_min INT, "
        "requested_at TIMESTAMP_NTZ",
    )


def test_fares(spark, seed):
    quiet, rush = NOW, NOW.replace(hour=8)
    trips = _trips(
        spark, ("economy", "10", 20, quiet), ("Premium", "10", 20, quiet), ("bike", "10", 20, quiet),
        ("economy", "10", 20, rush), ("hovercraft", "10", 20, quiet), ("economy", None, None, rush),
    )
    quote = pricing.fare_quote(trips, seed["fare_rules"], F.lit(10))
    assert rows(quote, "trip_id", "fare", "surge_applied", "fallback") == [
        (0, D("290.00"), False, False), (1, D("580.00"), False, False), (2, D("170.00"), False, False),
        (3, D("435.00"), True, False), (4, D("290.00"), False, False), (5, D("300.00"), False, True),
    ]
    busy = pricing.fare_quote(trips, seed["fare_rules"], F.lit(11))
    assert rows(busy.where("trip_id IN (0, 3)"), "fare") == [(D("522.00"),), (D("522.00"),)]


def test_peak_hours(spark, seed):
    times = [(7, 0), (9, 59), (10, 0), (20, 59), (21, 0), (17, 0), (6, 59)]
    trips = _trips(spark, *[("economy", "1", 1, NOW.replace(hour=h, minute=m)) for h, m in times])
    got = [r.is_peak for r in pricing.peak_surge(trips, seed["fare_rules"]).orderBy("trip_id").collect()]
    assert got == [True, True, False, True, False, True, False]


def test_fare_rules_in_enum_order(seed):
    assert [r.vehicle_type for r in lists.fare_rules(seed).collect()] == ["economy", "premium", "bike"]


def test_every_list_and_report_runs_on_the_seed(seed):
    for module in (wide, aggregates, ranked):
        for name in ("rider_ride_history", "driver_rides", "payment_history", "flagged_accounts",
                     "driver_earnings_admin", "rider_stats", "refund_totals", "latest_driver_location"):
            if hasattr(module, name):
                getattr(module, name)(seed).collect()


def test_empty_tables_give_null_sums(seed):
    empty = seed.replace(payments=seed["payments"].limit(0))
    row = aggregates.refund_totals(empty).first()
    assert row.total_refunded is None and row.refund_count is None
    assert aggregates.revenue_totals(empty).first().gross_revenue == D("0.00")
