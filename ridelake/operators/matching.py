"""Drivers near pickup points (survey GP3, GP4)."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelake.functions.geo import arc_km, bearings, cosine_between, km_steps, steps_to_km
from ridelake.operators.common import Tables
from ridelake.operators.ranked import first_verified_vehicle, latest_driver_location
from ridelake.plans.grid import HALF_EARTH_KM, join_within, start_reach
from ridelake.plans.keyed import join_per_key, top_per_key
from ridelake.plans.session import cut
from ridelake.schema import MATCH_RADIUS_KM, VEHICLE_TYPES

_ROUNDING_KM = 0.005
_SLACK_KM = 0.001
_SHOWN = (
    "driver_id", "fname", "lname", "phone_number", "average_rating", "total_trips", "vehicle_type", "make",
    "model", "color", "license_plate", "current_lat", "current_lng",
)


def _steps() -> Column:
    """Rounded distance of a pair in 10-metre steps."""
    return km_steps(arc_km(cosine_between(F.col("pickup_at"), F.col("current_at"))))


def _aimed(df: DataFrame, end: str) -> DataFrame:
    return df.withColumn(f"{end}_at", bearings(F.col(f"{end}_lat"), F.col(f"{end}_lng")))


def valid_pickups(requests: DataFrame) -> DataFrame:
    """Requests whose coordinates are numbers, as decimals."""
    lat = F.col("pickup_lat").cast("string").try_cast("decimal(10,7)")
    lng = F.col("pickup_lng").cast("string").try_cast("decimal(10,7)")
    return requests.select("request_id", lat.alias("pickup_lat"), lng.alias("pickup_lng")).where(
        "pickup_lat IS NOT NULL AND pickup_lng IS NOT NULL"
    )


def _positions(t: Tables, drivers: DataFrame) -> DataFrame:
    pings = latest_driver_location(t).select(
        "driver_id", F.col("latitude").alias("current_lat"), F.col("longitude").alias("current_lng")
    )
    return drivers.join(pings, "driver_id")


def _bookable(t: Tables, vehicle_type: str | None) -> DataFrame:
    """Position, person and vehicle of each driver that may be booked."""
    if vehicle_type is not None and vehicle_type.lower() not in VEHICLE_TYPES:
        vehicle_type = None
    bookable = t["driver"].where(
        "availability_status = 'available' AND verification_status = 'verified'"
    ).select("driver_id", "user_id", "average_rating", "total_trips")
    people = t["users"].where("account_status = 'active'").select(
        "user_id", "fname", "lname", "phone_number"
    )
    cars = first_verified_vehicle(t, vehicle_type).select(
        "driver_id", "vehicle_type", "make", "model", "color", "license_plate"
    )
    return _positions(t, bookable.join(people, "user_id").join(cars, "driver_id"))


def _steps_within(radius_km: float) -> int:
    return math.floor(round(radius_km * 100, 6))


def drivers_within_radius(
    t: Tables,
    requests: DataFrame,
    radius_km: float = MATCH_RADIUS_KM,
    vehicle_type: str | None = None,
) -> DataFrame:
    """Bookable drivers within ``radius_km`` (rounded distance) of each pickup.

    ``requests`` has ``request_id``, ``pickup_lat``, ``pickup_lng``. An unknown vehicle type is
    no restriction. Show one request's drivers by distance, then rating, then driver id. All pairs are
    made; ``closest_drivers`` makes only as many as a request shows.
    """
    drivers = cut(_bookable(t, vehicle_type))
    reach_km = radius_km + _ROUNDING_KM + _SLACK_KM
    pairs = join_within(
        _aimed(cut(valid_pickups(requests)), "pickup"), _aimed(drivers, "current"), ["request_id"],
        ("pickup_lat", "pickup_lng"), ("current_lat", "current_lng"), reach_km,
    )
    return pairs.withColumn("steps", _steps()).where(F.col("steps") <= _steps_within(radius_km)).select(
        "request_id", *_SHOWN, steps_to_km(F.col("steps")).alias("distance_km"),
    )


def closest_drivers(
    t: Tables,
    requests: DataFrame,
    k: int,
    radius_km: float = MATCH_RADIUS_KM,
    vehicle_type: str | None = None,
    least_reach_km: float = 0.05,
    growth: int = 4,
) -> DataFrame:
    """The first ``k`` rows of ``drivers_within_radius`` per request, numbered by ``place`` from 1.

    Each distinct pickup point begins at the reach whose quadtree cell holds ``k`` drivers and is settled once its k-th
    distance is below the reach; the others go on to a reach ``growth`` times as wide, up to the radius. So
    the pairs made follow ``k``, not the number of drivers around. Of drivers at one spot only the first ``k``
    can be shown, and each task keeps ``k`` rows per point before they are shuffled.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    reaches = [radius_km + _ROUNDING_KM + _SLACK_KM]
    while reaches[-1] / growth >= least_reach_km:
        reaches.append(reaches[-1] / growth)
    tied = [F.desc_nulls_last("average_rating"), F.asc("driver_id")]
    drivers = cut(top_per_key(_bookable(t, vehicle_type), ["current_lat", "current_lng"], tied, k))
    pickups = cut(valid_pickups(requests))
    sites = cut(_aimed(drivers.select("driver_id", "average_rating", "current_lat", "current_lng"), "current"))
    spot = ["pickup_lat", "pickup_lng"]
    waiting = cut(start_reach(pickups.select(*spot).distinct(), sites, ("pickup_lat", "pickup_lng"),
                              ("current_lat", "current_lng"), reaches, k))
    held = {r._step for r in waiting.select("_step").distinct().collect()}  # no more than there are reaches
    held.add(0)
    open_points, found = None, []
    for step in range(len(reaches) - 1, -1, -1):
        own = waiting.where(F.col("_step") == step).drop("_step") if step in held else None
        both = [p for p in (own, open_points) if p is not None]
        if not both:
            continue
        points = reduce(DataFrame.unionByName, both)
        pairs = join_within(
            _aimed(points, "pickup"), sites, spot, ("pickup_lat", "pickup_lng"), ("current_lat", "current_lng"), reaches[step],
        ).withColumn("steps", _steps()).where(F.col("steps") <= _steps_within(radius_km))
        window = Window.partitionBy(*spot).orderBy("steps", *tied)
        first = pairs.withColumn("place", F.row_number().over(window)).where(F.col("place") <= k)
        # One row of at most k drivers per point.
        rows = cut(first.groupBy(*spot).agg(F.array_sort(F.collect_list(F.struct("place", "steps", "driver_id"))).alias("drivers")))
        if step == 0:
            found.append(rows)
            break
        sure = (F.size("drivers") == k) & (F.element_at("drivers", -1)["steps"] < (reaches[step] - _ROUNDING_KM - _SLACK_KM) * 100)
        settled = rows.where(sure)
        found.append(settled)
        left = cut(points.join(settled, spot, "left_anti"))
        open_points = None if left.isEmpty() else left
    shown = join_per_key(pickups, reduce(DataFrame.unionByName, found), spot, "inner").select("request_id", F.inline("drivers"))
    return join_per_key(shown, drivers, ["driver_id"], "inner").select(
        "request_id", F.col("place").cast("int").alias("place"), *_SHOWN, steps_to_km(F.col("steps")).alias("distance_km"),
    )


def nearest_driver(t: Tables, requests: DataFrame, first_cell_km: float = 2.0, growth: int = 4) -> DataFrame:
    """Nearest available, verified driver per pickup by rounded distance; ties go to the lower id.

    Distinct pickup points are searched in growing cells. A point is settled once its best
    distance is below the cell side, because nothing nearer can lie outside the searched cells;
    the rest go on to larger cells, the last of which reach round the globe.
    """
    pickups = valid_pickups(requests)
    available = t["driver"].where(
        "availability_status = 'available' AND verification_status = 'verified'"
    ).select("driver_id")
    spots = _positions(t, available).groupBy("current_lat", "current_lng")
    sites = cut(_aimed(spots.agg(F.min("driver_id").alias("driver_id")), "current"))
    open_points = cut(pickups.select("pickup_lat", "pickup_lng").distinct())
    settled = []
    cell_km = first_cell_km
    while True:
        last = cell_km >= HALF_EARTH_KM
        pairs = join_within(
            _aimed(open_points, "pickup"), sites, ["pickup_lat", "pickup_lng"], ("pickup_lat", "pickup_lng"),
            ("current_lat", "current_lng"), reach_km=cell_km,
        )
        best = pairs.groupBy("pickup_lat", "pickup_lng").agg(
            F.min(F.struct(_steps().alias("steps"), F.col("driver_id"))).alias("best")
        )
        sure = F.col("best").isNotNull() & (
            F.lit(last) | (F.col("best.steps") < (cell_km - _ROUNDING_KM - _SLACK_KM) * 100)
        )
        scored = cut(
            open_points.join(best, ["pickup_lat", "pickup_lng"], "left").withColumn("sure", sure)
        )
        settled.append(scored.where("sure"))
        open_points = scored.where("NOT sure").select("pickup_lat", "pickup_lng")
        if last or open_points.isEmpty():
            break
        cell_km *= growth
    found = reduce(DataFrame.unionByName, settled).select(
        "pickup_lat", "pickup_lng", F.col("best.driver_id").alias("driver_id"),
        steps_to_km(F.col("best.steps")).alias("distance_km"),
    )
    return pickups.join(found, ["pickup_lat", "pickup_lng"], "left").select(
        "request_id", "driver_id", "distance_km"
    )
