"""Trip estimates, fares, surge, promos and commission (survey GP1, GP2, GP5-GP13)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelake.functions.geo import cosine_distance_km, haversine_km
from ridelake.functions.money import commission2, driver_net2, less_discount, money
from ridelake.functions.text import fold, is_blank
from ridelake.functions.timeops import as_date, is_peak
from ridelake.operators.common import Tables
from ridelake.plans.keyed import join_per_key, neighbours, running_totals
from ridelake.plans.session import cut
from ridelake.schema import (
    BOOKING_FARE, CITY_SPEED_KMH, DEFAULT_VEHICLE_TYPE, DEMAND_THRESHOLD, FALLBACK_FARE,
    MIN_TRIP_MINUTES, SEED_FARE_RULES, VEHICLE_TYPES,
)

_ENDS = ("pickup_lat", "pickup_lng", "dropoff_lat", "dropoff_lng")
_RATES = ("base_fare", "per_km_rate", "per_min_rate", "surge_peak_mult", "surge_demand_mult")


def trip_distances(trips: DataFrame) -> DataFrame:
    """Both distance formulas between the two ends of each trip."""
    ends = [F.col(c) for c in _ENDS]
    return trips.select(
        "trip_id", haversine_km(*ends).cast("decimal(12,4)").alias("haversine_km"),
        cosine_distance_km(*ends).alias("cosine_km"),
    )


def estimated_km(trips_columns=_ENDS) -> Column:
    """Trip length to 0.1 km; NULL when a coordinate is missing."""
    return F.round(haversine_km(*[F.col(c) for c in trips_columns]), 1).cast("decimal(10,1)")


def estimated_minutes(distance_km: Column) -> Column:
    """Minutes at city speed, at least five."""
    minutes = F.round(distance_km * F.lit(60) / F.lit(CITY_SPEED_KMH)).cast("int")
    return F.when(distance_km.isNotNull(), F.greatest(F.lit(MIN_TRIP_MINUTES), minutes))


def trip_estimate(trips: DataFrame) -> DataFrame:
    """Add ``distance_km`` and ``duration_min`` from the coordinates of both ends."""
    return trips.withColumn("distance_km", estimated_km()).withColumn(
        "duration_min", estimated_minutes(F.col("distance_km"))
    )


def pending_requests(t: Tables) -> Column:
    """Number of rides waiting for a driver, as a scalar subquery."""
    return t["rides"].where("ride_status = 'requested'").agg(F.count(F.lit(1))).scalar()


def with_rates(trips: DataFrame, rules: DataFrame) -> DataFrame:
    """Attach the fare rule of each trip's vehicle type, default rates where there is none.

    Reduced to one rule per known type, the rules have at most three rows, so they are broadcast.
    """
    one_per_type = (
        rules.select(fold(F.col("vehicle_type")).alias("_type"), F.struct(*_RATES).alias("_rule"), "rule_id")
        .where(F.col("_type").isin(*VEHICLE_TYPES)).groupBy("_type").agg(F.min_by("_rule", "rule_id").alias("_rule"))
    )
    keyed = F.broadcast(one_per_type.select("_type", *[F.col(f"_rule.{r}").alias(f"_{r}") for r in _RATES]))
    defaults = dict(zip(_RATES, SEED_FARE_RULES[DEFAULT_VEHICLE_TYPE]))
    joined = trips.join(keyed, fold(F.col("vehicle_type")) == F.col("_type"), "left")
    return joined.select(
        *trips.columns,
        *[
            F.coalesce(F.col(f"_{rate}"), F.lit(value).cast("decimal(10,2)")).alias(rate)
            for rate, value in defaults.items()
        ],
    )


def surge_multiplier(requested_at: Column, pending: Column | None, threshold: int, tz: str) -> Column:
    """Peak-hour multiplier, raised to the demand multiplier above ``threshold`` open requests."""
    surge = F.when(is_peak(requested_at, tz), F.col("surge_peak_mult")).otherwise(F.lit(1))
    if pending is not None:
        surge = F.when(pending > threshold, F.greatest(surge, F.col("surge_demand_mult"))).otherwise(surge)
    return surge.cast("decimal(10,2)")


def fare_quote(
    trips: DataFrame,
    rules: DataFrame,
    pending: Column | None = None,
    threshold: int = DEMAND_THRESHOLD,
    tz: str = "UTC",
) -> DataFrame:
    """Fare of trips with ``vehicle_type``, ``distance_km``, ``duration_min``, ``requested_at``.

    A trip without distance gets the fallback fare without surge.
    """
    priced = with_rates(trips, rules).withColumn(
        "surge_multiplier", surge_multiplier(F.col("requested_at"), pending, threshold, tz)
    )
    known = F.col("distance_km").isNotNull() & F.col("duration_min").isNotNull()
    km_cost = F.col("per_km_rate") * F.col("distance_km").cast("decimal(10,2)")
    min_cost = F.col("per_min_rate") * F.col("duration_min").cast("decimal(10,0)")
    fare = F.round((F.col("base_fare") + km_cost + min_cost) * F.col("surge_multiplier"), 2)
    surge = F.when(known, F.col("surge_multiplier")).otherwise(F.lit(1)).cast("decimal(10,2)")
    return priced.select(
        *trips.columns,
        money(F.when(known, fare).otherwise(F.lit(FALLBACK_FARE))).alias("fare"),
        surge.alias("surge_multiplier"),
        (surge > 1).alias("surge_applied"),
        (~known).alias("fallback"),
        F.when(known, money(F.col("base_fare"))).alias("base_fare"),
        F.when(known, money(F.round(km_cost, 2))).alias("distance_cost"),
        F.when(known, money(F.round(min_cost, 2))).alias("time_cost"),
    )


def fare_breakdown(trips: DataFrame, rules: DataFrame) -> DataFrame:
    """Base, distance and time parts of each quote, before surge."""
    return fare_quote(trips, rules).select("trip_id", "base_fare", "distance_cost", "time_cost")


def booking_fare(vehicle_type: Column) -> Column:
    """Flat estimate at booking; the economy one for an unknown or missing type."""
    kind = fold(vehicle_type)
    fare = F.lit(BOOKING_FARE[DEFAULT_VEHICLE_TYPE])
    for name, value in BOOKING_FARE.items():
        fare = F.when(kind == name, F.lit(value)).otherwise(fare)
    return fare.cast("decimal(10,2)")


def peak_surge(rides: DataFrame, rules: DataFrame, tz: str = "UTC") -> DataFrame:
    """Peak-hour multiplier of each ride's request time."""
    priced = with_rates(rides, rules)
    return priced.select(
        "trip_id", is_peak(F.col("requested_at"), tz).alias("is_peak"),
        surge_multiplier(F.col("requested_at"), None, 0, tz).alias("surge_multiplier"),
    )


def demand_snapshot(t: Tables, threshold: int = DEMAND_THRESHOLD) -> DataFrame:
    """One row: open requests and whether they exceed the threshold."""
    waiting = t["rides"].where("ride_status = 'requested'").agg(F.count(F.lit(1)).alias("pending_requests"))
    return waiting.withColumn("high_demand", F.col("pending_requests") > threshold)


def _demand_steps(t: Tables) -> DataFrame:
    """Status feed as +1/-1 steps of open requests, with the pickup city."""
    order = ["timestamp", "history_id"]
    feed = neighbours(t["ride_history"], ["ride_id"], order, previous={"previous_status": "status"})
    was_open = F.coalesce(F.col("previous_status") == "requested", F.lit(False)).cast("int")
    is_open = (F.col("status") == "requested").cast("int")
    steps = feed.withColumn("step", is_open - was_open)
    pickup = t["rides"].select("ride_id", F.col("pickup_location_id").alias("location_id"))
    cities = t["location"].select("location_id", fold(F.col("city")).alias("city"))
    return steps.join(pickup, "ride_id").join(cities, "location_id").select(
        "history_id", "ride_id", "status", "timestamp", "step", "city"
    )


def demand_history(t: Tables, threshold: int = DEMAND_THRESHOLD) -> DataFrame:
    """Open requests in the pickup city just after each new request of the status feed.

    The sum runs per city; a city with much of the traffic is cut into time slices.
    """
    placed = cut(_demand_steps(t).withColumn("city_key", F.struct("city")))
    totals = running_totals(
        placed, ["city_key"], ["timestamp", "history_id"], {"pending": F.col("step")}
    )
    opened = totals.where("status = 'requested' AND step = 1")
    return opened.select(
        "history_id", "ride_id", "city", "timestamp", F.col("pending").cast("bigint").alias("pending"),
        (F.col("pending") > threshold).alias("high_demand"),
    )


def demand_at(trips: DataFrame, t: Tables, threshold: int = DEMAND_THRESHOLD) -> DataFrame:
    """Add the open requests in ``city`` as of each trip's ``requested_at``.

    Trips and steps are merged into one timeline per city, so no trip is paired with all earlier
    steps. The column ``pending`` can be passed on to ``fare_quote``.
    """
    steps = _demand_steps(t).select(
        F.col("timestamp"), F.lit(0).alias("kind"), F.col("history_id").alias("id"), "step", "city"
    )
    marks = trips.select(
        F.col("requested_at").alias("timestamp"), F.lit(1).alias("kind"), F.col("trip_id").alias("id"),
        F.lit(0).alias("step"), fold(F.col("city")).alias("city"),
    )
    merged = cut(steps.unionByName(marks).withColumn("city_key", F.struct("city")))
    totals = running_totals(merged, ["city_key"], ["timestamp", "kind", "id"], {"pending": F.col("step")})
    return totals.where("kind = 1").select(
        F.col("id").alias("trip_id"), "city", F.col("timestamp").alias("requested_at"),
        F.col("pending").cast("bigint").alias("pending"), (F.col("pending") > threshold).alias("high_demand"),
    )


def resolve_addresses(trips: DataFrame, locations: DataFrame) -> DataFrame:
    """Coordinates for pickup and dropoff addresses from known locations; NULL where unknown.

    Of several locations with one address the lowest id counts; (0, 0) is no position.
    """
    known = locations.where("address IS NOT NULL AND NOT (latitude = 0 AND longitude = 0)")
    places = known.groupBy(fold(F.col("address")).alias("_address")).agg(
        F.min_by(F.struct("latitude", "longitude"), "location_id").alias("_at")
    )
    out = trips
    for end in ("pickup", "dropoff"):
        here = places.select(
            "_address", F.col("_at.latitude").alias(f"{end}_lat"), F.col("_at.longitude").alias(f"{end}_lng")
        )
        asked = out.withColumn("_address", fold(F.col(f"{end}_address")))
        out = cut(join_per_key(asked, here, ["_address"]).drop("_address"))
    return out


def attach_promo(requests: DataFrame, promos: DataFrame, as_of) -> DataFrame:
    """Add ``promo_id`` and ``discount_amount`` of the valid promo named by ``promo_code``, else NULL.

    Most requests name no code or one popular code; both are hot keys of this join.
    """
    valid = promos.where(F.col("expiry_date") >= as_date(as_of)).select(
        fold(F.col("code")).alias("_code"), "promo_id", "discount_amount"
    )
    code = F.when(~is_blank(F.col("promo_code")), fold(F.col("promo_code")))
    return join_per_key(requests.withColumn("_code", code), valid, ["_code"]).drop("_code")


def discount(fares: DataFrame, on_invalid: str = "reject") -> DataFrame:
    """Fares with an attached promo, discounted: adds ``discount_applied``, ``final_fare`` and
    ``reject_reason``."""
    if on_invalid not in ("reject", "ignore"):
        raise ValueError("on_invalid must be 'reject' or 'ignore'")
    unknown = ~is_blank(F.col("promo_code")) & F.col("promo_id").isNull()
    rejected = unknown if on_invalid == "reject" else F.lit(False)
    kept = [c for c in fares.columns if c not in ("promo_id", "discount_amount")]
    return fares.select(
        *kept, "promo_id", money(F.coalesce("discount_amount", F.lit(0))).alias("discount_applied"),
        F.when(~rejected, money(less_discount(F.col("fare"), F.col("discount_amount")))).alias("final_fare"),
        F.when(rejected, F.lit("invalid_promo")).alias("reject_reason"),
    )


def apply_promo(fares: DataFrame, promos: DataFrame, as_of, on_invalid: str = "reject") -> DataFrame:
    """Discount fares that carry a ``promo_code``.

    An unknown or expired code gets a ``reject_reason`` (``on_invalid='reject'``) or is ignored.
    """
    return discount(attach_promo(fares, promos, as_of), on_invalid)


def commission_split(amounts: DataFrame, column: str = "amount") -> DataFrame:
    return amounts.withColumn("platform_commission", commission2(F.col(column))).withColumn(
        "driver_net", driver_net2(F.col(column))
    )
