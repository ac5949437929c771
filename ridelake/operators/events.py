"""Batch forms of the event-driven rules; the streaming jobs share their parts (ST2-ST8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelake.functions.money import rating2
from ridelake.functions.text import low_rating_message
from ridelake.operators.common import Tables, place
from ridelake.plans.keyed import join_per_key, neighbours, running_totals, top_per_key
from ridelake.plans.session import cut
from ridelake.schema import DRIVER_BUSY_STATUSES, LOW_DRIVER_RATING, LOW_RIDER_RATING


# --- ratings -----------------------------------------------------------------------------------

def running_ratings(ratings: DataFrame) -> DataFrame:
    """Each rating with the two-place mean of its user's ratings so far."""
    totals = running_totals(
        ratings.select("rating_id", "rated_user_id", "score", "timestamp"), ["rated_user_id"],
        ["timestamp", "rating_id"], {"total": F.coalesce("score", F.lit(0)), "n": F.lit(1)},
    )
    return totals.select(
        "rating_id", "rated_user_id", "timestamp", F.col("n").cast("bigint").alias("n"),
        rating2(F.col("total"), F.col("n")).alias("average"),
    )


def _judged_by_role(low: DataFrame, drivers: DataFrame) -> DataFrame:
    """Low running means with whether the rated user is a driver."""
    rated_drivers = drivers.select(F.col("user_id").alias("rated_user_id"), F.lit(True).alias("is_driver"))
    return join_per_key(cut(low), rated_drivers, ["rated_user_id"])


def rating_alerts(running: DataFrame, drivers: DataFrame) -> DataFrame:
    """A notification for every rating after which a driver's mean is below 3.5."""
    low = running.where((F.col("average") < F.lit(LOW_DRIVER_RATING)) & (F.col("average") > 0))
    return _judged_by_role(low, drivers).where("is_driver").select(
        F.col("rating_id").alias("notification_id"), F.lit("low_driver_rating").alias("type"),
        low_rating_message(F.col("rated_user_id"), F.col("average")).alias("message"),
        F.col("rated_user_id").alias("ref_user_id"), F.lit(False).alias("is_read"),
        F.col("timestamp").alias("created_at"),
    )


def rider_flags(running: DataFrame, drivers: DataFrame) -> DataFrame:
    """Ratings after which the mean of somebody who is not a driver is below 3.0."""
    low = running.where(F.col("average") < F.lit(LOW_RIDER_RATING))
    return _judged_by_role(low, drivers).where("is_driver IS NULL").select(
        "rating_id", "rated_user_id", "average", "timestamp"
    )


def suspensions(rows: DataFrame, user_column: str, time_column: str) -> DataFrame:
    """The users that alerts or flags suspend, one row each with the first time."""
    return rows.groupBy(F.col(user_column).alias("user_id")).agg(
        F.lit("suspended").alias("account_status"), F.min(time_column).alias("changed_at")
    )


def suspend(users: DataFrame, flagged: DataFrame, user_column: str) -> DataFrame:
    """Users snapshot with the active accounts among ``flagged`` suspended."""
    hit = flagged.select(F.col(user_column).alias("user_id")).distinct().withColumn("_hit", F.lit(True))
    low = F.coalesce("_hit", F.lit(False)) & (F.col("account_status") == "active")
    return users.join(hit, "user_id", "left").select(
        *[
            F.when(low, F.lit("suspended")).otherwise(F.col(c)).alias(c) if c == "account_status" else F.col(c)
            for c in users.columns
        ]
    )


# --- status feeds ------------------------------------------------------------------------------


def status_steps(feed: DataFrame, key: str, event: str) -> DataFrame:
    """Feed rows with the status of their key before them."""
    return neighbours(feed, [key], ["timestamp", event], previous={"previous_status": "status"})


def only_paid(steps: DataFrame) -> DataFrame:
    """Changes of a payment from another status to paid. A first insert as paid is none."""
    return steps.where("status = 'paid' AND previous_status <> 'paid'").select(
        "change_id", "payment_id", "ride_id", "timestamp"
    )


def paid_transitions(feed: DataFrame) -> DataFrame:
    return only_paid(status_steps(feed, "payment_id", "change_id"))


def rides_after_payments(rides: DataFrame, transitions: DataFrame) -> DataFrame:
    """Rides completed by a payment; the first one sets a missing end time."""
    first_paid = transitions.groupBy("ride_id").agg(F.min("timestamp").alias("_paid_at"))
    hit = F.col("_paid_at").isNotNull() & (F.col("ride_status") != "completed")
    new = {
        "ride_status": F.when(hit, F.lit("completed")).otherwise(F.col("ride_status")),
        "end_time": F.when(hit, F.coalesce("end_time", "_paid_at")).otherwise(F.col("end_time")),
    }
    return rides.join(first_paid, "ride_id", "left").select(
        *[new[c].alias(c) if c in new else F.col(c) for c in rides.columns]
    )


def ended_rides(ends: DataFrame, t: Tables) -> DataFrame:
    """Status rows with the driver and the drop-off point of their ride."""
    rides = t["rides"].select("ride_id", "driver_id", "dropoff_location_id").where("driver_id IS NOT NULL")
    dropoff = place(t, "dropoff", latitude="latitude", longitude="longitude")
    return ends.join(rides.join(dropoff, "dropoff_location_id", "left"), "ride_id")


def dropoffs(completed: DataFrame, t: Tables) -> DataFrame:
    """A ping of the driver at the drop-off point for each completion, batch or stream."""
    return _as_pings(ended_rides(completed, t))


def _as_pings(ended: DataFrame) -> DataFrame:
    return ended.where((F.col("status") == "completed") & F.col("latitude").isNotNull()).select(
        F.col("history_id").alias("location_id"), "driver_id", "latitude", "longitude", "timestamp"
    )


def positions(t: Tables, steps: DataFrame) -> DataFrame:
    """Newest position per driver from pings and drop-offs."""
    pings = t["driver_location"].select("location_id", "driver_id", "latitude", "longitude", "timestamp")
    order = [F.desc("timestamp"), F.desc("location_id"), F.desc("latitude"), F.desc("longitude")]
    return top_per_key(pings.unionByName(ride_effects(steps, t)["pings"]), ["driver_id"], order)


def ride_effects(steps: DataFrame, t: Tables) -> dict[str, DataFrame]:
    """What ride status changes bring about: history rows, freed drivers, drop-off pings."""
    closed = ("completed", "cancelled")
    status, before = F.col("status"), F.col("previous_status")
    changed = cut(steps.where(before.isNotNull() & (before != status)))
    ends = changed.where(status.isin(*closed))
    touched = t["rides"].select("ride_id", "driver_id", "dropoff_location_id").where(
        "driver_id IS NOT NULL"
    ).join(ends.select("ride_id").distinct(), "ride_id", "left_semi")
    dropoff = place(t, "dropoff", latitude="latitude", longitude="longitude")
    ended = join_per_key(ends, touched.join(dropoff, "dropoff_location_id", "left"), ["ride_id"], "inner")
    return {
        "history": changed.select("history_id", "ride_id", "status", "timestamp"),
        "freed": ended.where(~before.isin(*closed)).select(
            "history_id", "driver_id", F.lit("available").alias("availability_status"), "timestamp"
        ),
        "pings": _as_pings(ended),
    }


# --- double booking ----------------------------------------------------------------------------

def open_step() -> Column:
    """+1 when a ride becomes open, -1 when it stops being so, else 0."""
    def is_open(column: str) -> Column:
        return F.coalesce(F.col(column).isin(*DRIVER_BUSY_STATUSES), F.lit(False)).cast("int")

    return is_open("status") - is_open("previous_status")


def open_steps(feed: DataFrame) -> DataFrame:
    """Feed rows with their step: 'update' rows are status changes of existing rides, 'insert' rows ask for a new one."""
    updates = status_steps(feed.where("kind = 'update'"), "ride_id", "event_id")
    moved = updates.select(*feed.columns, open_step().alias("step"))
    return moved.unionByName(feed.where("kind = 'insert'").withColumn("step", F.lit(0)))


def guarded(totals: DataFrame) -> DataFrame:
    """Decision per asked-for ride: refused while its driver has ``open`` rides.

    A ride asked for without a driver has nobody to double-book and passes.
    """
    open_rides = F.when(F.col("driver_id").isNull(), F.lit(0)).otherwise(F.col("open")).cast("bigint")
    return totals.where("kind = 'insert'").select("event_id", "driver_id", "timestamp", open_rides.alias("open_rides")).select(
        "*", F.when(F.col("open_rides") > 0, F.lit("driver_on_active_ride")).alias("reject_reason")
    )


def double_booking_guard(steps: DataFrame) -> DataFrame:
    """``guarded`` over a whole feed. Open rides are a running sum per driver of the feed's steps, not a self-join."""
    with_driver = cut(
        steps.where("driver_id IS NOT NULL").select("event_id", "driver_id", "timestamp", "kind", "step")
    )
    totals = running_totals(with_driver, ["driver_id"], ["timestamp", "event_id"], {"open": F.col("step")})
    free = steps.where("driver_id IS NULL").select(*with_driver.columns, F.lit(0).alias("open"))
    return guarded(totals.unionByName(free))


# --- demand ------------------------------------------------------------------------------------


def with_pickup_city(feed: DataFrame, t: Tables) -> DataFrame:
    """Attach the pickup city to a ride feed, batch or stream."""
    rides = t["rides"].select("ride_id", F.col("pickup_location_id").alias("location_id"))
    cities = t["location"].select("location_id", "city")
    return feed.join(rides.join(cities, "location_id").select("ride_id", "city"), "ride_id")


def demand_windows(requests: DataFrame, threshold: int, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Requests per time window and city against the threshold; ``event_time`` is a timestamp."""
    window = F.window("event_time", width, slide) if slide else F.window("event_time", width)
    return requests.groupBy(window, "city").agg(F.count(F.lit(1)).alias("requests")).select(
        F.col("window.start").cast("timestamp_ntz").alias("window_start"), "city", "requests",
        (F.col("requests") > threshold).alias("high_demand"),
    )
