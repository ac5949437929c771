"""Rules of the model that are easy to get wrong, on small hand-made rows."""

import datetime as dt
from decimal import Decimal as D

from conftest import NOW, rows
from pyspark.sql import functions as F

from ridelake.functions.geo import cosine_distance_km, cosine_km
from ridelake.functions.money import less_discount, rating2
from ridelake.functions.text import leading_int, plain_number
from ridelake.functions.timeops import minutes_between
from ridelake.operators import aggregates, changes, events, lifecycle, matching, pricing, ranked, wide
from ridelake.sources.ingest import ingest_registrations, ingest_vehicles


def at(minutes):
    return NOW + dt.timedelta(minutes=minutes)


def test_discount_keeps_null_and_floor(spark):
    df = spark.createDataFrame(
        [(D("100"), D("30")), (D("20"), D("30")), (D("20"), None), (None, D("30"))],
        "fare DECIMAL(10,2), off DECIMAL(10,2)",
    )
    got = [r[0] for r in df.select(less_discount(F.col("fare"), F.col("off"))).collect()]
    assert got == [D("70.00"), D("0.00"), D("20.00"), None]


def test_minutes_truncate_toward_zero(spark):
    df = spark.createDataFrame(
        [(NOW, NOW + dt.timedelta(seconds=90)), (NOW, NOW - dt.timedelta(seconds=90)), (NOW, None)],
        "a TIMESTAMP_NTZ, b TIMESTAMP_NTZ",
    )
    assert [r[0] for r in df.select(minutes_between(F.col("a"), F.col("b"))).collect()] == [1, -1, None]


def test_range_end_day(spark, seed):
    late = seed["payments"].withColumn("transaction_date", F.lit("2026-03-10 23:59:00").cast("timestamp_ntz"))
    t = seed.replace(payments=late)
    assert aggregates.revenue_report_range(t, "2026-03-10", "2026-03-10").count() == 2
    assert aggregates.revenue_report_finance(t, "2026-03-10", "2026-03-10").count() == 2
    assert aggregates.revenue_report_admin(t, "2026-03-10", "2026-03-10").count() == 0


def test_coincident_points_are_zero_km_apart(spark):
    df = spark.range(2000).select(
        (F.col("id") * 0.089 - 89).alias("lat"), (F.col("id") * 0.17 - 170).alias("lng")
    )
    here = [F.col(c) for c in ("lat", "lng", "lat", "lng")]
    assert df.where(F.isnan(cosine_km(*here)) | (cosine_distance_km(*here) != 0)).count() == 0


def test_radius_uses_the_rounded_distance(spark, seed):
    # 0.0450 degrees of latitude are 5.0038 km: rounded 5.00, still within 5 km.
    lat = D("24.8607") + D("0.0450")
    requests = spark.createDataFrame([(1, lat, D("67.0011"))], "request_id BIGINT, pickup_lat DECIMAL(10,7), pickup_lng DECIMAL(10,7)")
    km = rows(matching.drivers_within_radius(seed, requests, 50), "driver_id", "distance_km")
    assert km == [(1, D("5.00"))]
    assert matching.drivers_within_radius(seed, requests, 5).count() == 1
    assert matching.drivers_within_radius(seed, requests, 4.99).count() == 0
    assert matching.drivers_within_radius(seed, requests, 50, "bike").count() == 0
    assert matching.drivers_within_radius(seed, requests, 50, "rocket").count() == 1


def test_bad_coordinates_are_no_request(spark):
    raw = spark.createDataFrame([(1, "abc", "67"), (2, "24.5", "67.1"), (3, None, "1")], "request_id BIGINT, pickup_lat STRING, pickup_lng STRING")
    assert rows(matching.valid_pickups(raw), "request_id") == [(2,)]


def test_latest_ping_tie(spark, seed):
    extra = spark.createDataFrame([(9, 1, D("1"), D("1"), NOW), (8, 1, D("2"), D("2"), NOW)], seed["driver_location"].schema)
    t = seed.replace(driver_location=seed["driver_location"].unionByName(extra))
    assert rows(ranked.latest_driver_location(t), "driver_id", "location_id") == [(1, 9), (2, 2)]


def test_fan_out_and_deduped(spark, seed):
    more_paid = seed["payments"].unionByName(seed["payments"].withColumn("payment_id", F.col("payment_id") + 10))
    more_complaints = seed["complaints"].unionByName(
        seed["complaints"].withColumn("complaint_id", F.col("complaint_id") + 10)
    )
    t = seed.replace(payments=more_paid, complaints=more_complaints)
    picked = ("driver_id", "total_complaints", "total_earnings")
    assert rows(aggregates.driver_performance(t), *picked) == [(1, 4, D("1120.0000")), (2, 0, D("800.0000"))]
    assert rows(aggregates.driver_performance_deduped(t), *picked) == [(1, 2, D("560.0000")), (2, 0, D("800.0000"))]
    assert rows(aggregates.trips_per_driver(t), "driver_id", "completed_trips") == [(1, 2), (2, 2)]
    assert rows(wide.rider_ride_history(t), "ride_id", "payment_id", "already_rated") == [
        (1, 1, 1), (1, 11, 1), (2, 12, 1), (2, 2, 1), (3, None, 0)
    ]


def test_timeline_collapses_repeats(spark, seed):
    feed = spark.createDataFrame(
        [(1, 5, "requested", at(0)), (2, 5, "requested", at(3)), (3, 5, "accepted", at(130)),
         (4, 5, "accepted", at(131)), (5, 5, "completed", at(400)), (6, 6, "requested", at(1))],
        seed["ride_history"].schema,
    )
    got = rows(ranked.ride_status_timeline(seed.replace(ride_history=feed)), "history_id", "previous_status", "seconds_in_status")
    assert got == [(1, None, 7800), (3, "requested", 16200), (5, "accepted", None), (6, None, None)]


def test_stored_mean_rounds_before_the_threshold(spark, seed):
    # 437 of 125 ratings is 3.496: below 3.5 as it is, 3.50 as stored.
    scores = [4] * 62 + [3] * 63
    assert sum(scores) == 437
    ratings = spark.createDataFrame(
        [(i, 1, 2, 4, s, None, at(i)) for i, s in enumerate(scores)], seed["ratings"].schema
    )
    t = seed.replace(ratings=ratings)
    assert rows(aggregates.low_rated_drivers(t), "driver_id", "avg_rating") == [(1, 3.496)]
    last = events.running_ratings(ratings).where("rating_id = 124")
    assert rows(last, "average") == [(D("3.50"),)]
    assert events.rating_alerts(last, t["driver"]).count() == 0


def test_rating2_half_up(spark):
    df = spark.createDataFrame([(121, 40), (601, 200), (7, 2), (10, 3)], "s BIGINT, n BIGINT")
    assert [r[0] for r in df.select(rating2(F.col("s"), F.col("n"))).collect()] == [
        D("3.03"), D("3.01"), D("3.50"), D("3.33")
    ]


def test_text_numbers(spark):
    df = spark.createDataFrame([("4.7",), ("4x",), ("x",), (" 5",), (None,), ("-2",)], "v STRING")
    assert [r[0] for r in df.select(leading_int(F.col("v"))).collect()] == [4, 4, None, 5, None, -2]
    df = spark.createDataFrame([(D("280.00"),), (D("280.50"),), (D("0.07"),), (D("100.00"),)], "v DECIMAL(10,2)")
    assert [r[0] for r in df.select(plain_number(F.col("v"))).collect()] == ["280", "280.5", "0.07", "100"]


def test_cities_fold_case(spark, seed):
    places = seed["location"].withColumn("city", F.when(F.col("location_id") == 1, " karachi").otherwise("Karachi"))
    got = rows(aggregates.revenue_by_city(seed.replace(location=places)), "total_rides", "total_revenue")
    assert got == [(2, D("850.00"))]


def test_promo_reject_or_ignore(spark, seed):
    fares = spark.createDataFrame(
        [(1, D("120"), "welcome50"), (2, D("60"), "SAVE100"), (3, D("60"), "NOPE"), (4, D("60"), ""), (5, D("60"), None)],
        "ride_id BIGINT, fare DECIMAL(10,2), promo_code STRING",
    )
    strict = pricing.apply_promo(fares, seed["promo_code"], "2026-07-01")
    assert rows(strict, "ride_id", "final_fare", "reject_reason") == [
        (1, D("70.00"), None), (2, D("0.00"), None), (3, None, "invalid_promo"), (4, D("60.00"), None),
        (5, D("60.00"), None),
    ]
    expired = pricing.apply_promo(fares, seed["promo_code"], "2027-01-01", "ignore")
    assert rows(expired.where("ride_id IN (2, 3)"), "final_fare") == [(D("60.00"),), (D("60.00"),)]


def test_settlement_first_valid_request_wins(spark, seed):
    unpaid = seed.replace(payments=seed["payments"].where("ride_id <> 1"))
    requests = spark.createDataFrame(
        [(11, 1, 2, "cash", "NOPE", at(0)), (12, 1, 2, "card", "WELCOME50", at(1)), (13, 1, 2, "cash", None, at(2)),
         (14, 2, 3, "cash", None, at(0)), (15, 3, 2, "cash", None, at(0)), (16, 1, 3, "cash", None, at(0)),
         (17, 1, 2, "gold", None, at(0))],
        "request_id BIGINT, ride_id BIGINT, user_id BIGINT, payment_method STRING, promo_code STRING, requested_at TIMESTAMP_NTZ",
    )
    out = lifecycle.settle_payments(requests, unpaid["rides"], unpaid["payments"], unpaid["promo_code"], "2026-03-10")
    assert rows(out["decided"], "request_id", "reject_reason") == [
        (11, "invalid_promo"), (12, None), (13, "already_paid"), (14, "already_paid"),
        (15, "not_completed"), (16, "ride_not_found"), (17, "invalid_method"),
    ]
    assert rows(out["payments"], "payment_id", "amount", "promo_id") == [(12, D("300.00"), 1)]
    assert rows(out["history"], "status") == [("payment_completed:card:driver_net_240",)]
    parsed = lifecycle.parse_audit_events(out["history"], out["payments"])
    assert rows(parsed, "payment_method", "driver_net", "reconciled") == [("card", D("240.00"), True)]
    assert rows(lifecycle.parse_audit_events(out["history"], unpaid["payments"]), "reconciled") == [(False,)]


def test_actions_in_order(spark, seed):
    rides = seed["rides"].withColumn("ride_status", F.lit("requested"))
    actions = spark.createDataFrame(
        [(1, 1, "reject", 4, at(0)), (2, 1, "cancel", 2, at(1)), (3, 1, "accept", 4, at(2)), (4, 1, "cancel", 2, at(200)),
         (5, 1, "cancel", 2, at(201)), (6, 2, "cancel", 2, at(0)), (7, 9, "accept", 4, at(0)), (8, 2, "fly", 5, at(0)),
         (9, None, "accept", 4, at(0))],
        "action_id BIGINT, ride_id BIGINT, action STRING, actor_user_id BIGINT, acted_at TIMESTAMP_NTZ",
    )
    out = lifecycle.accept_reject_cancel(actions, rides, seed["driver"])
    assert rows(out["decided"], "action_id", "reject_reason") == [
        (1, None), (2, "wrong_status"), (3, None), (4, None), (5, "wrong_status"), (6, "not_your_ride"),
        (7, "ride_not_found"), (8, "unknown_action"), (9, "ride_not_found"),
    ]
    assert rows(out["rides"], "ride_id", "ride_status") == [(1, "cancelled"), (2, "requested"), (3, "requested")]
    assert rows(out["driver"], "driver_id", "availability_status") == [(1, "available"), (2, "offline")]


def test_payouts(spark, seed):
    payouts = lifecycle.weekly_payouts(seed, NOW)
    assert rows(payouts["payouts"], "driver_id", "amount", "notes") == [
        (1, D("280.00"), "Weekly payout request — net 80% of Rs.350.00 gross"),
        (2, D("400.00"), "Weekly payout request — net 80% of Rs.500.00 gross"),
    ]
    waiting = spark.createDataFrame(
        [(1, 1, D("1"), "pending", NOW.date(), NOW.date() - dt.timedelta(days=7), None, NOW, None),
         (2, 2, D("1"), "pending", NOW.date(), NOW.date() - dt.timedelta(days=8), None, NOW, None)],
        seed["driver_payouts"].schema,
    )
    again = lifecycle.weekly_payouts(seed.replace(driver_payouts=waiting), NOW)
    assert rows(again["decided"], "driver_id", "reject_reason") == [(1, "payout_waiting"), (2, None)]
    old = lifecycle.weekly_payouts(seed, NOW + dt.timedelta(days=8))
    assert rows(old["rejected"], "reject_reason") == [("no_earnings",), ("no_earnings",)]


def test_flag_low_rated(seed):
    low = seed.replace(driver=seed["driver"].withColumn("average_rating", F.lit("3.49").cast("decimal(3,2)")))
    out = lifecycle.flag_low_rated_drivers(low)
    assert out["count"].first()[0] == 2
    assert rows(out["users"].where("account_status = 'suspended'"), "user_id") == [(4,), (5,)]


def test_complete_ride(spark, seed):
    requests = spark.createDataFrame(
        [(1, 3, D("10"), 20, "cash", "NOPE", at(0)), (2, 3, D("10"), 20, "card", "RIDE25", at(5)),
         (3, 99, D("10"), 20, "cash", None, at(0))],
        "request_id BIGINT, ride_id BIGINT, distance_km DECIMAL(10,2), duration_min INT, payment_method STRING, "
        "promo_code STRING, requested_at TIMESTAMP_NTZ",
    )
    out = lifecycle.complete_rides(seed, requests, "2026-03-10")
    assert rows(out["decided"], "request_id", "final_fare", "reject_reason")[:2] == [
        (1, D("290.00"), None), (2, D("265.00"), None)
    ]
    assert rows(out["rides"].where("ride_id = 3"), "ride_status", "fare", "end_time") == [
        ("completed", D("265.00"), at(5))
    ]
    assert rows(out["driver"], "driver_id", "total_trips") == [(1, 122), (2, 85)]


def test_changes_are_last_write_wins_and_idempotent(spark, seed):
    feed = spark.createDataFrame(
        [(1, 1, "delete", None, None, at(0)), (2, 1, "upsert", "BACK", D("9"), at(1)), (3, 2, "upsert", None, D("1"), at(0)),
         (4, 2, "upsert", "NEW2", None, at(-1)), (5, 3, "delete", None, None, at(9)), (6, 3, "upsert", "LOST", D("2"), at(8)),
         (7, 4, "upsert", "FOUR", D("4"), at(0)), (8, 4, "upsert", "BAD", D("0"), at(3))],
        "change_id BIGINT, promo_id BIGINT, op STRING, code STRING, discount_amount DECIMAL(10,2), changed_at TIMESTAMP_NTZ",
    )
    out = changes.change_promos(seed["promo_code"], feed)
    picked = ("promo_id", "code", "discount_amount", "expiry_date", "usage_count")
    expected = [
        (1, "BACK", D("9.00"), None, 0), (2, "NEW2", D("1.00"), dt.date(2026, 12, 31), 0),
        (4, "FOUR", D("4.00"), None, 0),
    ]
    assert rows(out["snapshot"], *picked) == expected
    assert rows(out["rejected"], "change_id", "reject_reason") == [(8, "invalid_discount")]
    assert rows(changes.change_promos(out["snapshot"], feed)["snapshot"], *picked) == expected


def test_vehicle_year_and_plate(spark, seed):
    raw = spark.createDataFrame(
        [(1, 1, " abc-1 ", "M", "X", "2020", "Red", "Bike", None, None, at(0)), (2, 2, "ABC-1", "M", "X", "2020", "Red", "bike", None, None, at(1)),
         (3, 1, "lea-123", "M", "X", "2020", "Red", "bike", None, None, at(0)), (4, 1, "Q", "M", "X", "2027", "Red", "bike", None, None, at(0)),
         (5, 1, "R", "M", "X", "20x", "Red", "bike", None, None, at(0)), (6, 1, "S", " ", "X", "2020", "Red", "bike", None, None, at(0)),
         (7, 8, "T", "M", "X", "2020", "Red", "bike", None, None, at(0)), (8, 1, "U", "M", "X", "2000", "Red", "bike", D("1"), D("2"), at(0))],
        "request_id BIGINT, driver_id BIGINT, license_plate STRING, make STRING, model STRING, year STRING, color STRING, "
        "vehicle_type STRING, latitude DECIMAL(10,7), longitude DECIMAL(10,7), submitted_at TIMESTAMP_NTZ",
    )
    out = ingest_vehicles(raw, seed["driver"], seed["vehicles"], completing=True)
    assert rows(out["decided"], "request_id", "license_plate", "reject_reason") == [
        (1, "ABC-1", None), (2, "ABC-1", "duplicate_plate"), (3, "LEA-123", "duplicate_plate"),
        (4, "Q", "invalid_year"), (5, "R", "invalid_year"), (6, "S", "missing_fields"), (7, "T", "unknown_driver"),
        (8, "U", None),
    ]
    assert rows(out["pings"], "location_id") == [(8,)]
    assert {r.verification_status for r in out["vehicles"].collect()} == {"verified"}


def test_registrations_in_order(spark, seed):
    raw = spark.createDataFrame(
        [(1, "a@x", "1", at(0)), (2, "A@x", "2", at(1)), (3, "c@x", "2", at(2)), (4, "c@x", "9", at(3)), (5, "ALI@example.com", "7", at(0)),
         (6, "z@x", "03002222222", at(0))],
        "request_id BIGINT, email STRING, phone_number STRING, submitted_at TIMESTAMP_NTZ",
    ).select("*", *[F.lit("v").alias(c) for c in ("fname", "lname", "cnic", "license_number")], F.lit("driver").alias("role"))
    out = ingest_registrations(raw, seed["users"])
    # 2 loses to 1, so 3 may have the phone that 2 asked for; 4 then loses to 3.
    assert rows(out["decided"], "request_id", "reject_reason") == [
        (1, None), (2, "duplicate"), (3, None), (4, "duplicate"), (5, "duplicate"), (6, "duplicate")
    ]
    assert rows(out["driver"], "driver_id") == [(1,), (3,)]
