"""Shares, latest rows, timelines and leaderboards (survey WN1-WN6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridelake.functions.money import total_money
from ridelake.functions.text import fold
from ridelake.functions.timeops import seconds_between
from ridelake.operators.common import Tables, count_rows, only, paginate, person
from ridelake.plans.keyed import hot_keys, neighbours, top_per_key
from ridelake.schema import TOP_K


def payment_method_breakdown(t: Tables) -> DataFrame:
    """Count, total and share of paid payments by method.

    The window without partitions runs over the aggregate: one row per payment method.
    """
    by_method = (
        t["payments"].where("payment_status = 'paid'").groupBy("payment_method")
        .agg(count_rows("transactions"), total_money(F.sum("amount")).alias("total_amount"))
    )
    share = F.col("transactions").cast("double") * 100 / F.sum("transactions").over(Window.partitionBy())
    return by_method.withColumn("percentage", F.round(share, 2)).orderBy(
        F.desc("total_amount"), "payment_method"
    )


def latest_driver_location(t: Tables, driver_id: int | None = None) -> DataFrame:
    """Newest ping per driver; the higher location id wins a tie."""
    pings = only(t["driver_location"], driver_id=driver_id)
    return top_per_key(pings, ["driver_id"], [F.desc("timestamp"), F.desc("location_id")])


def first_verified_vehicle(t: Tables, vehicle_type: str | None = None) -> DataFrame:
    """Lowest verified vehicle id per driver, optionally of one type."""
    verified = t["vehicles"].where("verification_status = 'verified'")
    if vehicle_type is not None:
        verified = verified.where(fold(F.col("vehicle_type")) == fold(F.lit(vehicle_type)))
    return top_per_key(verified, ["driver_id"], [F.asc("vehicle_id")])


def ride_status_timeline(t: Tables, ride_id: int | None = None) -> DataFrame:
    """Status changes per ride in time order, repeats of the same status collapsed.

    Adds the time the status was left and the whole seconds spent in it.
    """
    feed = only(t["ride_history"], ride_id=ride_id)
    order, hot = ["timestamp", "history_id"], hot_keys(feed, ["ride_id"])
    changes = (
        neighbours(feed, ["ride_id"], order, previous={"previous_status": "status"}, hot=hot)
        .where("previous_status IS NULL OR previous_status <> status")
    )
    spans = neighbours(changes, ["ride_id"], order, following={"left_at": "timestamp"}, hot=hot)
    return spans.select(
        "history_id", "ride_id", "status", "previous_status", "timestamp", "left_at",
        seconds_between(F.col("timestamp"), F.col("left_at")).alias("seconds_in_status"),
    )


def driver_leaderboard(t: Tables, k: int = TOP_K) -> DataFrame:
    """Best ``k`` verified drivers; names are joined to those only."""
    known = t["driver"].where("verification_status = 'verified'").join(
        t["users"].select("user_id"), "user_id", "left_semi"
    )
    order = [F.desc("average_rating"), F.desc("total_trips"), F.asc("driver_id")]
    best = paginate(known, order, k)
    return (
        best.join(person(t, "user_id", fname="fname", lname="lname"), "user_id")
        .select("driver_id", "fname", "lname", "average_rating", "total_trips")
        .orderBy(*order)
    )
