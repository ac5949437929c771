"""Request jobs over whole batches: booking, status changes, payment, payout, rating (survey LC1-LC8, LC10).

Each job takes a frame of requests and returns frames: rows to write and ``rejected`` requests with
a reason. New row ids come from the request ids. Requests of one batch are applied in time order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridelake.functions.money import commission2, driver_net2
from ridelake.functions.text import (
    AUDIT_PATTERN, audit_status, fold, is_blank, leading_int, payout_note,
)
from ridelake.functions.timeops import as_timestamp
from ridelake.operators.aggregates import received_scores
from ridelake.operators.common import Tables
from ridelake.operators.decisions import accepted, first_reason, fixed, rejected, with_first
from ridelake.operators.pricing import attach_promo, booking_fare, discount, fare_quote
from ridelake.plans.keyed import HotKeys, deal, hot_keys, is_hot, join_per_key, running_totals
from ridelake.plans.session import cut, stored
from ridelake.schema import (
    DEMAND_THRESHOLD, DRIVER_BUSY_STATUSES, LOW_DRIVER_RATING, MIN_TRIPS_TO_FLAG, PAYMENT_METHODS, PAYOUT_DAYS,
)

Frames = dict[str, DataFrame]


def match_ride_requests(requests: DataFrame, vehicles: DataFrame, rides: DataFrame | None = None) -> Frames:
    """Book requests on the chosen driver's first verified vehicle of the wanted type.

    With ``rides``, a driver who is on one of them is refused.
    """
    verified = vehicles.where("verification_status = 'verified'")
    any_type = F.lit("*")
    first_cars = (
        verified.select(
            "driver_id", "vehicle_id",
            F.explode(F.array(fold(F.col("vehicle_type")), any_type)).alias("_type"),
        )
        .groupBy("driver_id", "_type").agg(F.min("vehicle_id").alias("vehicle_id"))
    )
    wanted = F.when(is_blank(F.col("vehicle_type")), any_type).otherwise(fold(F.col("vehicle_type")))
    missing = is_blank(F.col("pickup_address")) | is_blank(F.col("dropoff_address")) | F.col("driver_id").isNull()
    joined = join_per_key(requests.withColumn("_type", wanted), first_cars, ["driver_id", "_type"])
    busy = F.lit(False)
    if rides is not None:
        on_ride = rides.where(F.col("ride_status").isin(*DRIVER_BUSY_STATUSES) & F.col("driver_id").isNotNull())
        joined = join_per_key(joined, on_ride.groupBy("driver_id").agg(F.lit(True).alias("_busy")), ["driver_id"])
        busy = F.coalesce("_busy", F.lit(False))
    decided = joined.select(
        *requests.columns, "vehicle_id", booking_fare(F.col("vehicle_type")).alias("fare"),
        first_reason(
            ("missing_fields", missing), ("no_verified_vehicle", F.col("vehicle_id").isNull()),
            ("driver_on_active_ride", busy),
        ).alias("reject_reason"),
    )
    decided = fixed(decided)
    booked = accepted(decided).withColumn("pickup_location_id", F.col("request_id") * 2).withColumn(
        "dropoff_location_id", F.col("request_id") * 2 + 1
    )
    no_time = F.lit(None).cast("timestamp_ntz")
    rides = booked.select(
        F.col("request_id").alias("ride_id"), "user_id", "driver_id", "vehicle_id",
        "pickup_location_id", "dropoff_location_id", F.col("requested_at").alias("request_time"),
        "scheduled_time", no_time.alias("start_time"), no_time.alias("end_time"),
        F.lit("requested").alias("ride_status"), "fare",
    )
    zero = F.lit(0).cast("decimal(10,7)")
    end = F.explode(
        F.array(
            F.struct(F.col("pickup_location_id").alias("id"), F.col("pickup_address").alias("address")),
            F.struct(F.col("dropoff_location_id").alias("id"), F.col("dropoff_address").alias("address")),
        )
    ).alias("end")
    locations = booked.select(end).select(
        F.col("end.id").alias("location_id"), zero.alias("latitude"), zero.alias("longitude"),
        F.col("end.address").alias("address"), F.lit(None).cast("string").alias("city"),
    )
    history = booked.select(
        F.col("request_id").alias("history_id"), F.col("request_id").alias("ride_id"),
        F.lit("requested").alias("status"), F.col("requested_at").alias("timestamp"),
    )
    return {
        "decided": decided, "rides": rides, "locations": locations, "history": history,
        "rejected": rejected(decided),
    }


# Statuses that the status job may set.
SETTABLE_STATUSES = ("accepted", "driver_en_route", "in_progress", "completed", "cancelled")


def _with_actor(requests: DataFrame, rides: DataFrame, drivers: DataFrame) -> DataFrame:
    """Attach the ride and the driver id of the acting user."""
    ride = rides.select(
        F.col("ride_id").alias("_ride"), F.col("user_id").alias("rider_id"), "driver_id", "vehicle_id",
        "ride_status",
    )
    actor = drivers.select(F.col("user_id").alias("_actor"), F.col("driver_id").alias("actor_driver_id"))
    return requests.join(ride, F.col("ride_id") == F.col("_ride"), "left").join(
        actor, F.col("actor_user_id") == F.col("_actor"), "left"
    ).drop("_actor")


def _bumped(table: DataFrame, counts: DataFrame, key: str, **changes) -> DataFrame:
    """Snapshot with ``total_trips`` raised by ``trips`` and further columns replaced."""
    joined = table.join(counts, key, "left")
    new = {"total_trips": (F.col("total_trips") + F.coalesce("trips", F.lit(0))).cast("int"), **changes}
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in table.columns])


def apply_status_changes(changes: DataFrame, rides: DataFrame, drivers: DataFrame, vehicles: DataFrame) -> Frames:
    """Apply ride status changes; a completed ride counts a trip, and one that ends frees its driver.

    A cancel frees the driver only if the ride was not over already.
    """
    joined = _with_actor(changes, rides, drivers)
    not_owner = (F.col("actor_role") == "driver") & ~F.coalesce(
        F.col("driver_id") == F.col("actor_driver_id"), F.lit(False)
    )
    decided = joined.withColumn(
        "reject_reason",
        first_reason(
            ("invalid_status", ~F.col("status").isin(*SETTABLE_STATUSES)),
            ("ride_not_found", F.col("_ride").isNull()),
            ("not_your_ride", not_owner),
        ),
    ).select(*changes.columns, "driver_id", "vehicle_id", "reject_reason")
    decided = fixed(decided)
    done = accepted(decided)
    position = F.struct("changed_at", "change_id")
    status = F.col("status")

    def latest(value: str, when_status: str | None = None):
        place = position if when_status is None else F.when(status == when_status, position)
        return F.max_by(F.col(value), place)

    final = done.groupBy("ride_id").agg(
        latest("status").alias("_status"), latest("changed_at", "in_progress").alias("_start"),
        latest("changed_at", "completed").alias("_end"),
    )
    new = {
        "ride_status": F.coalesce("_status", "ride_status"),
        "start_time": F.coalesce("_start", "start_time"),
        "end_time": F.coalesce("_end", "end_time"),
    }
    ride_rows = rides.join(final, "ride_id", "left").select(
        *[new[c].alias(c) if c in new else F.col(c) for c in rides.columns]
    )
    completed = done.where("status = 'completed'")
    before = Window.partitionBy("ride_id").orderBy("changed_at", "change_id")  # a ride has a handful of changes
    was = rides.select("ride_id", F.col("ride_status").alias("_first"))
    steps = done.join(was, "ride_id").withColumn("_was", F.coalesce(F.lag("status").over(before), "_first"))
    frees = (status == "completed") | ((status == "cancelled") & ~F.col("_was").isin("completed", "cancelled"))
    by_driver = steps.groupBy("driver_id").agg(
        F.count(F.when(status == "completed", 1)).alias("trips"), F.max(frees).alias("_freed")
    )
    by_vehicle = completed.groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("trips"))
    freed = F.when(F.col("_freed"), F.lit("available")).otherwise(F.col("availability_status"))
    return {
        "decided": decided,
        "rides": ride_rows,
        "history": done.select(
            F.col("change_id").alias("history_id"), "ride_id", "status", F.col("changed_at").alias("timestamp")
        ),
        "driver": _bumped(drivers, by_driver, "driver_id", availability_status=freed),
        "vehicles": _bumped(vehicles, by_vehicle, "vehicle_id"),
        "rejected": rejected(decided),
    }


# Status after each ride action, and the driver's availability after it.
ACTION_STATUS = {"accept": "accepted", "reject": "rejected_by_driver", "cancel": "cancelled"}
ACTION_AVAILABILITY = {"accept": "busy", "cancel": "available"}


def _mapped(column, mapping: dict[str, str]):
    value = F.lit(None).cast("string")
    for key, result in mapping.items():
        value = F.when(column == key, F.lit(result)).otherwise(value)
    return value


def accept_reject_cancel(requests: DataFrame, rides: DataFrame, drivers: DataFrame) -> Frames:
    """Apply accept, reject and cancel actions in time order.

    A driver may accept their ride in any status, reject it while requested; a rider may cancel
    theirs while requested or accepted. Every accept starts a new segment of the ride's actions in
    the state 'accepted'; within a segment at most one reject or cancel, the first allowed, succeeds.
    """
    joined = _with_actor(requests, rides, drivers)
    action = F.col("action")
    mine = F.when(action == "cancel", F.col("rider_id") == F.col("actor_user_id")).otherwise(
        F.col("driver_id") == F.col("actor_driver_id")
    )
    owned = F.coalesce(mine, F.lit(False)) & action.isin(*ACTION_STATUS)
    flagged = cut(
        joined.withColumn("owned", owned).withColumn("accepting", owned & (action == "accept"))
        .withColumn("ride_key", F.struct("ride_id"))
    )
    order = ["acted_at", "action_id"]
    segmented = running_totals(flagged, ["ride_key"], order, {"segment": F.col("accepting").cast("int")})
    state = F.when(F.col("segment") > 0, F.lit("accepted")).otherwise(F.col("ride_status"))
    allowed = F.col("owned") & (
        ((action == "reject") & (state == "requested"))
        | ((action == "cancel") & state.isin("requested", "accepted"))
    )
    ranked = with_first(
        segmented.withColumn("allowed", F.coalesce(allowed, F.lit(False))), ["ride_key", "segment"],
        order, F.col("allowed"),
    )
    decided = ranked.withColumn(
        "reject_reason",
        first_reason(
            ("unknown_action", ~action.isin(*ACTION_STATUS)),
            ("ride_not_found", F.col("_ride").isNull()),
            ("not_your_ride", ~F.col("owned")),
            ("wrong_status", ~(F.col("accepting") | F.coalesce(F.col("is_first"), F.lit(False)))),
        ),
    ).select(*requests.columns, "driver_id", "reject_reason")
    decided = fixed(decided)
    done = accepted(decided)
    position = F.struct("acted_at", "action_id")
    final = done.groupBy("ride_id").agg(_mapped(F.max_by("action", position), ACTION_STATUS).alias("_status"))
    ride_rows = rides.join(final, "ride_id", "left").select(
        *[F.coalesce("_status", c).alias(c) if c == "ride_status" else F.col(c) for c in rides.columns]
    )
    touched = done.where(F.col("driver_id").isNotNull() & action.isin(*ACTION_AVAILABILITY))
    availability = touched.groupBy("driver_id").agg(
        _mapped(F.max_by("action", position), ACTION_AVAILABILITY).alias("_availability")
    )
    driver_rows = drivers.join(availability, "driver_id", "left").select(
        *[
            F.coalesce("_availability", c).alias(c) if c == "availability_status" else F.col(c)
            for c in drivers.columns
        ]
    )
    history = done.select(
        F.col("action_id").alias("history_id"), "ride_id", _mapped(action, ACTION_STATUS).alias("status"),
        F.col("acted_at").alias("timestamp"),
    )
    return {
        "decided": decided, "rides": ride_rows, "driver": driver_rows, "history": history,
        "rejected": rejected(decided),
    }


def settle_payments(requests: DataFrame, rides: DataFrame, payments: DataFrame, promos: DataFrame, as_of) -> Frames:
    """Pay completed rides; the first valid request per unpaid ride wins.

    Requests without a code skip the join of promos. The others go by ride once: the rides, which know whether they are
    paid, are joined and the first request is found where the requests of a ride meet. Those of a hot ride are dealt instead.
    """
    paid = payments.where("payment_status = 'paid'").select(F.col("ride_id").alias("_ride")).distinct()
    ride = rides.where("ride_id IS NOT NULL").select(
        F.col("ride_id").alias("_ride"), F.col("user_id").alias("_rider"), "driver_id",
        (F.col("ride_status") != "completed").alias("_open"),
        F.coalesce(F.col("fare").cast("decimal(18,2)"), F.lit(0)).alias("fare"),
    ).join(paid.withColumn("paid", F.lit(True)), "_ride", "left")
    plain = is_blank(F.col("promo_code"))
    no_promo = [F.lit(None).cast(promos.schema[c].dataType).alias(c) for c in ("promo_id", "discount_amount")]
    promoed = attach_promo(requests.where(~plain), promos, as_of).unionByName(requests.where(plain).select("*", *no_promo))

    def ranked(joined: DataFrame, hot: HotKeys | None) -> DataFrame:
        priced = discount(joined, "reject").withColumnRenamed("reject_reason", "promo_reason")
        bad_method = ~F.coalesce(F.col("payment_method").isin(*PAYMENT_METHODS), F.lit(False))
        rules = [
            ("invalid_method", bad_method),
            ("ride_not_found", F.col("_ride").isNull()),
            ("not_completed", F.col("_open")),
            ("already_paid", F.col("paid").isNotNull()),
        ]
        checked = priced.withColumn("_reason", first_reason(*rules))
        eligible = F.col("_reason").isNull() & F.col("promo_reason").isNull()
        return with_first(checked, ["ride_id"], ["requested_at", "request_id"], eligible, hot)

    hot = hot_keys(requests, ["ride_id"])
    heat = is_hot(["ride_id"], hot)
    # Not an equality of users, by which the requests would be dealt once more.
    owned = (F.col("ride_id") == F.col("_ride")) & F.col("user_id").between(F.col("_rider"), F.col("_rider"))
    by_ride = deal(promoed.where(~heat) if hot else promoed, ["ride_id"], requests.count())
    first = ranked(by_ride.join(ride, owned, "left"), {})
    if hot:
        of_user = ride.withColumns({"ride_id": F.col("_ride"), "user_id": F.col("_rider")})
        first = first.unionByName(ranked(join_per_key(promoed.where(heat), of_user, ["ride_id", "user_id"]), None))
    late = F.when(F.col("_reason").isNull() & F.col("after_first"), F.lit("already_paid"))
    amount = F.col("final_fare")
    decided = first.withColumn("reject_reason", F.coalesce("_reason", late, "promo_reason")).select(
        *requests.columns, "driver_id", F.col("fare").cast("decimal(18,2)").alias("original_fare"),
        "promo_id", "discount_applied", amount.alias("amount"),
        commission2(amount).alias("platform_commission"), driver_net2(amount).alias("driver_net"),
        "reject_reason",
    )
    decided = stored(decided)
    done = accepted(decided)
    return {
        "decided": decided,
        "payments": done.select(
            F.col("request_id").alias("payment_id"), "ride_id", "user_id",
            F.col("amount").cast("decimal(10,2)").alias("amount"), "payment_method",
            F.lit("paid").alias("payment_status"), F.col("requested_at").alias("transaction_date"),
            "promo_id",
        ),
        "history": done.where("driver_id IS NOT NULL").select(
            F.col("request_id").alias("history_id"), "ride_id",
            audit_status(F.col("payment_method"), F.col("driver_net")).alias("status"),
            F.col("requested_at").alias("timestamp"),
        ),
        "rejected": rejected(decided),
    }


def complete_rides(t: Tables, requests: DataFrame, as_of, threshold: int = DEMAND_THRESHOLD, pending=None) -> Frames:
    """Complete rides with a measured distance and duration: price, discount, pay, free the driver.

    Unlike settlement, an unknown promo code gives no discount and no rejection.
    """
    ride = t["rides"].select(F.col("ride_id").alias("_ride"), "user_id", "driver_id", "vehicle_id")
    car = t["vehicles"].select("vehicle_id", "vehicle_type")
    promoed = attach_promo(requests, t["promo_code"], as_of)
    joined = promoed.join(ride, F.col("ride_id") == F.col("_ride"), "left").join(car, "vehicle_id", "left")
    quoted = fare_quote(joined, t["fare_rules"], pending, threshold)
    priced = discount(quoted, "ignore").drop("reject_reason")
    decided = priced.withColumn(
        "reject_reason",
        first_reason(
            ("ride_not_found", F.col("_ride").isNull()),
            ("missing_fields", F.col("distance_km").isNull() | F.col("duration_min").isNull()),
            ("invalid_method", ~F.coalesce(F.col("payment_method").isin(*PAYMENT_METHODS), F.lit(False))),
        ),
    ).select(
        *requests.columns, "user_id", "driver_id", "promo_id", "final_fare", "surge_applied",
        "discount_applied", "reject_reason",
    )
    decided = fixed(decided)
    done = accepted(decided)
    position = F.struct("requested_at", "request_id")
    final = done.groupBy("ride_id").agg(
        F.max_by("final_fare", position).cast("decimal(10,2)").alias("_fare"),
        F.max("requested_at").alias("_end"),
    )
    new = {
        "ride_status": F.when(F.col("_end").isNotNull(), F.lit("completed")).otherwise(F.col("ride_status")),
        "end_time": F.coalesce("_end", "end_time"),
        "fare": F.coalesce("_fare", "fare"),
    }
    rides = t["rides"].join(final, "ride_id", "left").select(
        *[new[c].alias(c) if c in new else F.col(c) for c in t["rides"].columns]
    )
    trips = done.where("driver_id IS NOT NULL").groupBy("driver_id").agg(F.count(F.lit(1)).alias("trips"))
    freed = F.when(F.col("trips") > 0, F.lit("available")).otherwise(F.col("availability_status"))
    return {
        "decided": decided,
        "rides": rides,
        "payments": done.select(
            F.col("request_id").alias("payment_id"), "ride_id", "user_id",
            F.col("final_fare").cast("decimal(10,2)").alias("amount"), "payment_method",
            F.lit("paid").alias("payment_status"), F.col("requested_at").alias("transaction_date"),
            "promo_id",
        ),
        "driver": _bumped(t["driver"], trips, "driver_id", availability_status=freed),
        "rejected": rejected(decided),
    }


def weekly_payouts(t: Tables, as_of) -> Frames:
    """Payout rows for every driver's net earnings of the seven days up to ``as_of``."""
    now = as_timestamp(as_of)
    since = now - F.expr(f"INTERVAL {PAYOUT_DAYS} DAYS")
    paid_at = F.col("transaction_date")
    recent = (
        t["payments"].where((F.col("payment_status") == "paid") & (paid_at >= since) & (paid_at <= now))
        .groupBy("ride_id").agg(F.sum("amount").alias("gross"))
    )
    rides = t["rides"].where("driver_id IS NOT NULL").select("ride_id", "driver_id")
    earned = recent.join(rides, "ride_id").groupBy("driver_id").agg(
        driver_net2(F.sum("gross")).alias("amount")
    )
    start, end = F.to_date(since), F.to_date(now)
    waiting = (
        t["driver_payouts"].where(F.col("status").isin("pending", "processing") & (F.col("period_end") >= start))
        .select("driver_id").distinct().withColumn("waiting", F.lit(True))
    )
    decided = (
        t["driver"].select("driver_id").join(earned, "driver_id", "left").join(waiting, "driver_id", "left")
        .select(
            "driver_id", "amount", F.lit("pending").alias("status"), start.alias("period_start"),
            end.alias("period_end"),
            payout_note(F.round(F.col("amount") * F.lit("1.25").cast("decimal(3,2)"), 2)).alias("notes"),
            now.alias("requested_at"),
            first_reason(
                ("payout_waiting", F.col("waiting").isNotNull()),
                ("no_earnings", F.coalesce("amount", F.lit(0)) <= 0),
            ).alias("reject_reason"),
        )
    )
    decided = fixed(decided)
    return {
        "decided": decided, "payouts": accepted(decided).drop("reject_reason"), "rejected": rejected(decided),
    }


def accept_ratings(raw: DataFrame, rides: DataFrame, ratings: DataFrame) -> Frames:
    """Ratings of completed rides, one per ride and rater."""
    score = leading_int(F.col("score"))
    ride = rides.select(F.col("ride_id").alias("_ride"), "ride_status")
    rated = ratings.select("ride_id", "rated_by").distinct().withColumn("rated", F.lit(True))
    checked_once = join_per_key(raw.withColumn("score", score), rated, ["ride_id", "rated_by"])
    joined = checked_once.join(ride, F.col("ride_id") == F.col("_ride"), "left")
    bad_score = ~F.coalesce(F.col("score").between(1, 5), F.lit(False))
    checked = joined.withColumn(
        "_reason",
        first_reason(
            ("invalid_score", bad_score), ("ride_not_found", F.col("_ride").isNull()),
            ("not_completed", F.col("ride_status") != "completed"),
            ("already_rated", F.col("rated").isNotNull()),
        ),
    )
    ranked = with_first(
        checked, ["ride_id", "rated_by"], ["submitted_at", "request_id"], F.col("_reason").isNull()
    )
    late = F.when(F.col("_reason").isNull() & F.col("after_first"), F.lit("already_rated"))
    decided = ranked.withColumn("reject_reason", F.coalesce("_reason", late)).select(
        *raw.columns, "reject_reason"
    )
    decided = fixed(decided)
    new_ratings = accepted(decided).select(
        F.col("request_id").alias("rating_id"), "ride_id", "rated_by", "rated_user_id", "score",
        F.when(~is_blank(F.col("comment")), F.col("comment")).alias("comment"),
        F.col("submitted_at").alias("timestamp"),
    )
    return {"decided": decided, "ratings": new_ratings, "rejected": rejected(decided)}


def ratings_after(t: Tables, new_ratings: DataFrame) -> DataFrame:
    """Stored rating of every driver once ``new_ratings`` are in."""
    grown = {"ratings": t["ratings"].unionByName(new_ratings)}
    scores = received_scores(grown).select("user_id", F.col("stored_rating").alias("average_rating"))
    return t["driver"].select("driver_id", "user_id").join(scores, "user_id").select("driver_id", "average_rating")


def flag_low_rated_drivers(t: Tables) -> Frames:
    """Suspend active accounts of drivers rated above 0 and below 3.5 after five trips."""
    rating = F.col("average_rating")
    low = t["driver"].where(
        (rating > 0) & (rating < F.lit(LOW_DRIVER_RATING)) & (F.col("total_trips") >= MIN_TRIPS_TO_FLAG)
    ).select("user_id", "driver_id", "average_rating", "total_trips")
    active = t["users"].where("account_status = 'active'").select("user_id")
    flagged = low.join(active, "user_id", "left_semi")
    marked = t["users"].join(flagged.select("user_id", F.lit(True).alias("_low")), "user_id", "left")
    users = marked.select(
        *[
            F.when(F.col("_low"), F.lit("suspended")).otherwise(F.col(c)).alias(c)
            if c == "account_status" else F.col(c)
            for c in t["users"].columns
        ]
    )
    return {
        "flagged": flagged, "users": users,
        "count": flagged.agg(F.count(F.lit(1)).alias("drivers_flagged")),
    }


def parse_audit_events(history: DataFrame, payments: DataFrame) -> DataFrame:
    """Payment audit entries of the ride history as columns, checked against paid payments."""
    status = F.col("status")
    events = history.where(status.rlike(AUDIT_PATTERN)).select(
        "history_id", "ride_id", F.regexp_extract(status, AUDIT_PATTERN, 1).alias("payment_method"),
        F.regexp_extract(status, AUDIT_PATTERN, 2).cast("decimal(18,2)").alias("driver_net"), "timestamp",
    )
    paid = payments.where("payment_status = 'paid'").select(
        "ride_id", "payment_method", driver_net2(F.col("amount")).alias("driver_net")
    ).distinct().withColumn("_match", F.lit(True))
    return join_per_key(events, paid, ["ride_id", "payment_method", "driver_net"]).select(
        "history_id", "ride_id", "payment_method", "driver_net", "timestamp",
        F.col("_match").isNotNull().alias("reconciled"),
    )
