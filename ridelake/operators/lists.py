"""Filtered lists and profiles (survey FL1-FL14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelake.functions.text import fold
from ridelake.functions.timeops import as_date
from ridelake.operators.common import (
    ADDRESSES, Tables, enum_rank, only, only_folded, per_key_order, person, with_places,
)
from ridelake.schema import LOW_DRIVER_RATING, VEHICLE_TYPES


def _driver_users(t: Tables, *user_columns: str) -> DataFrame:
    return t["driver"].join(t["users"].select("user_id", *user_columns), "user_id")


def users_list(t: Tables, role: str | None = None, status: str | None = None) -> DataFrame:
    users = only(t["users"], role=role, account_status=status)
    return users.select(
        "user_id", "fname", "lname", "email", "phone_number", "role", "account_status", "city",
        "wallet_balance", "registration_date",
    ).orderBy(F.desc("registration_date"), "user_id")


def pending_drivers(t: Tables) -> DataFrame:
    waiting = _driver_users(t, "fname", "lname", "email", "city")
    return waiting.where("verification_status = 'pending'").select(
        "driver_id", "fname", "lname", "email", "city", "cnic", "license_number",
        "verification_status", "profile_photo",
    )


def flagged_drivers(t: Tables) -> DataFrame:
    drivers = _driver_users(t, "fname", "lname", "email", "city", "account_status")
    rating = F.col("average_rating")
    return (
        drivers.where((rating > 0) & (rating < F.lit(LOW_DRIVER_RATING)))
        .select(
            "driver_id", "user_id", "fname", "lname", "email", "city", "average_rating",
            "total_trips", "account_status",
        )
        .orderBy("average_rating", "driver_id")
    )


def promo_list(t: Tables) -> DataFrame:
    return t["promo_code"].orderBy(F.desc("expiry_date"), "promo_id")


def valid_promos(
    t: Tables, as_of, codes: DataFrame | None = None, enforce_max_uses: bool = False
) -> DataFrame:
    """Promos usable on ``as_of``; ``codes`` (column ``code``) narrows to those asked about."""
    promos = t["promo_code"].where(F.col("expiry_date") >= as_date(as_of))
    if enforce_max_uses:
        promos = promos.where("max_uses IS NULL OR usage_count < max_uses")
    if codes is not None:
        asked = codes.select(fold(F.col("code")).alias("_asked")).distinct()
        promos = promos.join(asked, fold(F.col("code")) == F.col("_asked"), "left_semi")
    return promos.select("promo_id", "code", "discount_amount", "expiry_date")


def fare_rules(t: Tables) -> DataFrame:
    return t["fare_rules"].orderBy(enum_rank("vehicle_type", VEHICLE_TYPES))


def pending_rides(t: Tables) -> DataFrame:
    waiting = t["rides"].where("ride_status = 'requested'").select(
        "ride_id", "fare", "request_time", "user_id", "pickup_location_id", "dropoff_location_id"
    )
    riders = person(t, "user_id", fname="fname", lname="lname", phone_number="phone_number")
    return (
        with_places(waiting, t, *ADDRESSES).join(riders, "user_id")
        .select(
            "ride_id", "fare", "request_time", "pickup_address", "dropoff_address", "fname",
            "lname", "phone_number",
        )
        .orderBy("request_time", "ride_id")
    )


def complaints_list(t: Tables, status: str | None = None) -> DataFrame:
    people = person(t, "user_id", fname="fname", lname="lname", email="email")
    return (
        only(t["complaints"], status=status).join(people, "user_id")
        .orderBy(F.desc("timestamp"), "complaint_id")
    )


def drivers_in_city(t: Tables, city: str | None = None) -> DataFrame:
    """Verified drivers of a city (of every city when none is named) by rating."""
    drivers = _driver_users(t, "fname", "lname", "email", "phone_number", "city")
    verified = only_folded(drivers.where("verification_status = 'verified'"), "city", city)
    return verified.select(
        "driver_id", "fname", "lname", "email", "phone_number", "city", "average_rating",
        "total_trips", "availability_status", "verification_status",
    ).orderBy(F.desc("average_rating"), "driver_id")


def driver_profiles(t: Tables, user_id: int | None = None) -> DataFrame:
    drivers = _driver_users(t, "fname", "lname", "email", "phone_number", "account_status")
    return only(drivers, user_id=user_id).select(
        "fname", "lname", "email", "phone_number", "account_status", "driver_id", "cnic",
        "license_number", "profile_photo", "verification_status", "availability_status",
        "average_rating", "total_trips",
    )


def rider_profiles(t: Tables, user_id: int | None = None) -> DataFrame:
    return only(t["users"], user_id=user_id).select(
        "user_id", "fname", "lname", "email", "phone_number", "role", "account_status",
        "registration_date",
    )


def vehicles_by_driver(t: Tables, driver_id: int | None = None) -> DataFrame:
    drivers = only(t["driver"].select("driver_id"), driver_id=driver_id)
    return t["vehicles"].join(drivers, "driver_id", "left_semi")


def driver_profile_complete(t: Tables) -> DataFrame:
    """Per user: riders and admins are complete, drivers once they have a vehicle."""
    with_vehicle = t["vehicles"].select("driver_id").distinct()
    owners = t["driver"].join(with_vehicle, "driver_id").select("user_id", F.lit(True).alias("_owns"))
    return t["users"].join(owners, "user_id", "left").select(
        "user_id", "role",
        F.when(F.col("role") == "driver", F.coalesce("_owns", F.lit(False)))
        .otherwise(F.lit(True)).alias("profile_complete"),
    )


def payout_history(t: Tables, driver_id: int | None = None) -> DataFrame:
    drivers = t["driver"].select("driver_id")
    payouts = only(t["driver_payouts"], driver_id=driver_id).join(drivers, "driver_id", "left_semi")
    payouts = payouts.select(
        "driver_id", "payout_id", "amount", "status", "requested_at", "processed_at",
        "period_start", "period_end", "notes",
    )
    return per_key_order(payouts, driver_id, F.desc("requested_at"), "payout_id")
