"""Wide joins of rides, payments, ratings and complaints (survey JN1-JN20).

Ride facts are filtered and narrowed before the first join. Every join is an equi-join whose
right side has one row per key; Spark chooses broadcast or sort-merge from measured sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelake.functions.money import commission2, driver_net2
from ridelake.functions.timeops import minutes_between
from ridelake.operators.common import (
    ADDRESSES, Tables, driver_person, only, paginate, past, per_key_order, person, place, vehicle,
    with_places,
)
from ridelake.plans.keyed import left_join_many, top_per_key
from ridelake.schema import (
    ACTIVE_RIDE_STATUSES, DRIVER_BUSY_STATUSES, PAGE_SIZE, TOP_DRIVER_RATING, TOP_K,
)

_PICKUP = {"pickup_address": "address", "pickup_city": "city"}
_DROPOFF = {"dropoff_address": "address", "dropoff_city": "city"}
_RIDER = {"rider_fname": "fname", "rider_lname": "lname", "rider_phone": "phone_number"}
_DRIVER_NAME = {"driver_fname": "fname", "driver_lname": "lname"}
_DRIVER = {**_DRIVER_NAME, "driver_phone": "phone_number"}
_VEHICLE = {
    "vehicle_make": "make", "vehicle_model": "model", "license_plate": "license_plate",
    "vehicle_type": "vehicle_type",
}
_CAR = {
    "make": "make", "model": "model", "license_plate": "license_plate", "vehicle_type": "vehicle_type",
}


def _duration():
    return minutes_between(F.col("start_time"), F.col("end_time")).alias("duration_minutes")


def _ride_parties(rides: DataFrame, t: Tables, driver: dict) -> DataFrame:
    return (
        with_places(rides, t, _PICKUP, _DROPOFF)
        .join(person(t, "user_id", rider_id="user_id", **_RIDER), "user_id", "left")
        .join(driver_person(t, **driver), "driver_id", "left")
        .join(vehicle(t, **_VEHICLE), "vehicle_id", "left")
    )


def active_rides(t: Tables) -> DataFrame:
    """Rides under way with rider, driver and vehicle."""
    rides = t["rides"].where(F.col("ride_status").isin(*ACTIVE_RIDE_STATUSES))
    return _ride_parties(rides, t, _DRIVER).select(
        "ride_id", "ride_status", "request_time", *_PICKUP, *_DROPOFF, "rider_id", *_RIDER,
        *_DRIVER, *_VEHICLE,
    )


def ride_summary(t: Tables) -> DataFrame:
    return _ride_parties(t["rides"], t, _DRIVER_NAME).select(
        "ride_id", "ride_status", "fare", "request_time", "start_time", "end_time", _duration(),
        *_PICKUP, *_DROPOFF, "rider_id", *_RIDER, *_DRIVER_NAME, *_VEHICLE,
    )


def full_trip_report(t: Tables, status: str | None = None, with_cities: bool = False) -> DataFrame:
    """Trips that have rider, driver and vehicle; ``with_cities`` adds the admin form's columns."""
    rides = only(t["rides"], ride_status=status)
    rider = {**_RIDER, "rider_city": "city"} if with_cities else _RIDER
    pickup = _PICKUP if with_cities else ADDRESSES[0]
    trips = (
        rides.join(driver_person(t, "inner", **_DRIVER), "driver_id")
        .join(vehicle(t, **_VEHICLE), "vehicle_id")
        .join(person(t, "user_id", rider_id="user_id", **rider), "user_id")
    )
    return (
        with_places(trips, t, pickup, ADDRESSES[1])
        .select(
            "ride_id", "ride_status", "fare", "request_time", "start_time", "end_time", _duration(),
            "rider_id", *rider, *_DRIVER, *_VEHICLE, *pickup, "dropoff_address",
        )
        .orderBy(F.desc("request_time"), "ride_id")
    )


def ride_detail(t: Tables, ride_id: int | None = None) -> DataFrame:
    rides = only(t["rides"], ride_id=ride_id)
    pickup = {"pickup_address": "address", "pickup_lat": "latitude", "pickup_lng": "longitude"}
    dropoff = {"dropoff_address": "address", "dropoff_lat": "latitude", "dropoff_lng": "longitude"}
    return (
        with_places(rides, t, pickup, dropoff)
        .join(person(t, "user_id", rider_fname="fname", rider_lname="lname"), "user_id", "left")
        .join(driver_person(t, driver={"driver_rating": "average_rating"}, **_DRIVER_NAME), "driver_id", "left")
        .join(vehicle(t, **_CAR), "vehicle_id", "left")
        .select(
            *t["rides"].columns, *pickup, *dropoff, "rider_fname", "rider_lname", *_DRIVER_NAME,
            "driver_rating", *_CAR,
        )
    )


def all_rides_page(
    t: Tables, status: str | None = None, limit: int = PAGE_SIZE, offset: int = 0, after: tuple | None = None
) -> DataFrame:
    """One page of rides, newest first: the rows from ``offset`` on, or those behind ``after``.

    ``after`` is the (request_time, ride_id) of the last row seen; with it no row before the page is sorted or kept.
    The page is cut on the rides that have a rider, before the name and address joins.
    """
    rides = only(t["rides"], ride_status=status)
    if after is not None:
        rides = rides.where(past("request_time", "ride_id", after))
    known = rides.join(t["users"].select("user_id"), "user_id", "left_semi")
    page = paginate(known, [F.desc("request_time"), F.asc("ride_id")], limit, offset)
    return (
        with_places(page, t, _PICKUP, ADDRESSES[1])
        .join(person(t, "user_id", rider_fname="fname", rider_lname="lname"), "user_id")
        .join(driver_person(t, **_DRIVER_NAME), "driver_id", "left")
        .select(
            "ride_id", "ride_status", "fare", "request_time", *_PICKUP, "dropoff_address",
            "rider_fname", "rider_lname", *_DRIVER_NAME,
        )
        .orderBy(F.desc("request_time"), "ride_id")
    )


def completed_rides_by_rider(t: Tables, user_id: int | None = None) -> DataFrame:
    rides = only(t["rides"].where("ride_status = 'completed'"), user_id=user_id)
    out = (
        with_places(rides, t, *ADDRESSES)
        .join(driver_person(t, **_DRIVER_NAME), "driver_id", "left")
        .select(
            "user_id", "ride_id", "fare", "request_time", "start_time", "end_time",
            "pickup_address", "dropoff_address", *_DRIVER_NAME,
        )
    )
    return per_key_order(out, user_id, F.desc("request_time"), "ride_id")


def _ratings_by_rater(t: Tables) -> DataFrame:
    """Ratings per (ride, rater), combined before the shuffle."""
    return t["ratings"].groupBy("ride_id", F.col("rated_by").alias("user_id")).agg(
        F.count(F.lit(1)).alias("already_rated")
    )


def rider_ride_history(t: Tables, user_id: int | None = None) -> DataFrame:
    """Rides of each rider with driver, vehicle and payments (one row per payment)."""
    rides = only(t["rides"], user_id=user_id).select(
        "ride_id", "user_id", "driver_id", "vehicle_id", "pickup_location_id",
        "dropoff_location_id", "ride_status", "fare", "request_time", "start_time", "end_time",
    )
    driver = {"driver_user_id": "user_id", "driver_rating": "average_rating"}
    trips = (
        with_places(rides, t, *ADDRESSES)
        .join(driver_person(t, driver=driver, **_DRIVER_NAME), "driver_id", "left")
        .join(vehicle(t, vehicle_type="vehicle_type", make="make", model="model"), "vehicle_id", "left")
        .join(_ratings_by_rater(t), ["ride_id", "user_id"], "left")
    )
    payments = t["payments"].select("ride_id", "user_id", "payment_status", "payment_method", "payment_id")
    keys = ["ride_id", "user_id"]
    out = left_join_many(trips, rides.select(*keys), payments, keys).select(
        "user_id", "ride_id", "ride_status", "fare", "request_time", "start_time", "end_time",
        "pickup_address", "dropoff_address", *_DRIVER_NAME, "driver_user_id", "driver_id",
        "driver_rating", "vehicle_type", "make", "model", "payment_status", "payment_method",
        "payment_id", F.coalesce("already_rated", F.lit(0)).cast("bigint").alias("already_rated"),
    )
    return per_key_order(out, user_id, F.desc("request_time"), "ride_id", "payment_id")


def driver_rides(t: Tables, driver_id: int | None = None) -> DataFrame:
    rides = only(t["rides"], driver_id=driver_id).where("driver_id IS NOT NULL")
    out = (
        with_places(rides, t, *ADDRESSES)
        .join(person(t, "user_id", rider_fname="fname", rider_lname="lname"), "user_id")
        .select(
            "driver_id", "ride_id", "ride_status", "fare", "request_time", "start_time", "end_time",
            "pickup_address", "dropoff_address", "rider_fname", "rider_lname",
        )
    )
    return per_key_order(out, driver_id, F.desc("request_time"), "ride_id")


def rider_active_ride(t: Tables, user_id: int | None = None) -> DataFrame:
    """Newest ride per rider that is open, rejected, or completed but not yet rated by the rider."""
    rides = only(t["rides"], user_id=user_id)
    open_ride = F.col("ride_status").isin(*ACTIVE_RIDE_STATUSES, "rejected_by_driver")
    completed = F.col("ride_status") == "completed"
    candidates = (
        rides.where(open_ride | completed)
        .join(_ratings_by_rater(t), ["ride_id", "user_id"], "left")
        .where(open_ride | F.col("already_rated").isNull())
    )
    newest = top_per_key(candidates, ["user_id"], [F.desc("request_time"), F.desc("ride_id")])
    driver = {"driver_user_id": "user_id", "driver_rating": "average_rating"}
    return (
        with_places(newest, t, *ADDRESSES)
        .join(driver_person(t, driver=driver, **_DRIVER), "driver_id", "left")
        .join(vehicle(t, **_CAR, color="color"), "vehicle_id", "left")
        .select(
            *t["rides"].columns, "pickup_address", "dropoff_address", *_DRIVER, "driver_user_id",
            "driver_rating", *_CAR, "color",
        )
    )


def driver_active_ride(t: Tables, driver_id: int | None = None) -> DataFrame:
    """Newest accepted, en-route or in-progress ride per driver."""
    rides = only(t["rides"], driver_id=driver_id).where(
        F.col("ride_status").isin(*DRIVER_BUSY_STATUSES) & F.col("driver_id").isNotNull()
    )
    newest = top_per_key(rides, ["driver_id"], [F.desc("request_time"), F.desc("ride_id")])
    return (
        with_places(newest, t, *ADDRESSES)
        .join(person(t, "user_id", **_RIDER), "user_id", "left")
        .join(vehicle(t, **_CAR, color="color"), "vehicle_id", "left")
        .select(
            *t["rides"].columns, "pickup_address", "dropoff_address", *_RIDER, *_CAR, "color"
        )
    )


def _promo(t: Tables, **columns: str) -> DataFrame:
    return t["promo_code"].select(
        "promo_id", *[F.col(source).alias(name) for name, source in columns.items()]
    )


def payments_with_promo(t: Tables, ride_id: int | None = None) -> DataFrame:
    promos = _promo(t, promo_code="code", discount_amount="discount_amount")
    return only(t["payments"], ride_id=ride_id).join(promos, "promo_id", "left").select(
        *t["payments"].columns, "promo_code", "discount_amount"
    )


def payment_history(t: Tables, user_id: int | None = None) -> DataFrame:
    payments = only(t["payments"], user_id=user_id)
    rides = t["rides"].select("ride_id", "pickup_location_id", "dropoff_location_id")
    out = (
        payments.join(with_places(rides, t, *ADDRESSES), "ride_id")
        .join(_promo(t, promo_code="code", promo_discount="discount_amount"), "promo_id", "left")
        .select(
            *payments.columns, "promo_code", "promo_discount", "pickup_address", "dropoff_address",
            commission2(F.col("amount")).alias("platform_fee"),
        )
    )
    return per_key_order(out, user_id, F.desc("transaction_date"), "payment_id")


def promo_usage_report(t: Tables) -> DataFrame:
    """Paid payments that used a promo."""
    paid = t["payments"].where("payment_status = 'paid' AND promo_id IS NOT NULL")
    promos = _promo(
        t, promo_code="code", discount_amount="discount_amount", usage_count="usage_count",
        max_uses="max_uses",
    )
    return (
        paid.join(promos, "promo_id")
        .join(person(t, "user_id", rider_fname="fname", rider_lname="lname"), "user_id")
        .select(
            "payment_id", "ride_id", "rider_fname", "rider_lname", "promo_code", "discount_amount",
            "usage_count", "max_uses", F.col("amount").alias("amount_paid"), "payment_method",
            "transaction_date",
        )
        .orderBy(F.desc("transaction_date"), "payment_id")
    )


def ratings_given(t: Tables, user_id: int | None = None) -> DataFrame:
    ratings = only(t["ratings"], rated_by=user_id)
    rides = t["rides"].select("ride_id", "pickup_location_id", "dropoff_location_id")
    out = (
        ratings.join(with_places(rides, t, *ADDRESSES), "ride_id", "left")
        .join(person(t, "rated_user_id", **_DRIVER_NAME), "rated_user_id", "left")
        .select(
            "rated_by", "rating_id", "score", "comment", "timestamp", "ride_id", *_DRIVER_NAME,
            "pickup_address", "dropoff_address",
        )
    )
    return per_key_order(out, user_id, F.desc("timestamp"), "rating_id")


def driver_ratings(t: Tables, driver_id: int | None = None) -> DataFrame:
    """Ratings received by drivers, matched through the driver's user id."""
    drivers = only(t["driver"], driver_id=driver_id).select(
        "driver_id", F.col("user_id").alias("rated_user_id")
    )
    raters = person(t, "rated_by", rated_by_fname="fname", rated_by_lname="lname")
    out = (
        t["ratings"].join(drivers, "rated_user_id").join(raters, "rated_by")
        .select(
            "driver_id", "rating_id", "score", "comment", "timestamp", "rated_by_fname",
            "rated_by_lname",
        )
    )
    return per_key_order(out, driver_id, F.desc("timestamp"), "rating_id")


def complaints_with_pickup(t: Tables, user_id: int | None = None) -> DataFrame:
    complaints = only(t["complaints"], user_id=user_id)
    rides = t["rides"].select("ride_id", "pickup_location_id")
    out = (
        complaints.join(rides, "ride_id")
        .join(place(t, "pickup", **ADDRESSES[0]), "pickup_location_id", "left")
        .select(*complaints.columns, "pickup_address")
    )
    return per_key_order(out, user_id, F.desc("timestamp"), "complaint_id")


def notifications_feed(t: Tables, limit: int = PAGE_SIZE) -> DataFrame:
    newest = paginate(
        t["admin_notifications"], [F.desc("created_at"), F.desc("notification_id")], limit
    )
    people = person(t, "ref_user_id", fname="fname", lname="lname")
    return (
        newest.join(people, "ref_user_id", "left")
        .select(*newest.columns, "fname", "lname")
        .orderBy(F.desc("created_at"), F.desc("notification_id"))
    )


def top_drivers(t: Tables) -> DataFrame:
    best = t["driver"].where("verification_status = 'verified'").where(
        F.col("average_rating") > F.lit(TOP_DRIVER_RATING)
    )
    people = person(t, "user_id", fname="fname", lname="lname", email="email", city="city")
    return (
        best.join(people, "user_id")
        .select(
            "driver_id", "fname", "lname", "email", "city", "average_rating", "total_trips",
            "availability_status", "verification_status",
        )
        .orderBy(F.desc("average_rating"), F.desc("total_trips"), "driver_id")
    )


def flagged_accounts(t: Tables) -> DataFrame:
    """Suspended users with the stored rating (drivers) or the mean of received scores."""
    suspended = t["users"].where("account_status = 'suspended'")
    received = t["ratings"].groupBy(F.col("rated_user_id").alias("user_id")).agg(
        F.round(F.avg("score"), 6).alias("_received")
    )
    stored = t["driver"].select("user_id", "driver_id", "average_rating")
    return (
        suspended.join(stored, "user_id", "left").join(received, "user_id", "left")
        .select(
            "user_id", "fname", "lname", "email", "role", "account_status",
            F.when(F.col("driver_id").isNotNull(), F.col("average_rating").cast("double"))
            .otherwise(F.col("_received")).alias("avg_rating"),
        )
    )


def driver_recent_payments(t: Tables, driver_id: int | None = None, k: int = TOP_K) -> DataFrame:
    """Last ``k`` paid payments per driver; addresses are joined to those only."""
    rides = only(t["rides"], driver_id=driver_id).where("driver_id IS NOT NULL").select(
        "ride_id", "driver_id", "pickup_location_id", "dropoff_location_id"
    )
    paid = t["payments"].where("payment_status = 'paid'").select(
        "payment_id", "ride_id", "amount", "payment_method", "transaction_date"
    )
    recent = top_per_key(
        paid.join(rides, "ride_id"), ["driver_id"], [F.desc("transaction_date"), F.desc("payment_id")], k
    )
    return with_places(recent, t, *ADDRESSES).select(
        "driver_id", "payment_id", "amount", driver_net2(F.col("amount")).alias("driver_net"),
        "payment_method", "transaction_date", "pickup_address", "dropoff_address",
    )
