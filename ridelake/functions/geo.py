"""Distances as built-in column expressions (stay inside generated code)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridelake.schema import EARTH_RADIUS_KM


def _rad(column: Column) -> Column:
    return F.radians(column.cast("double"))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    half_lat = (_rad(lat2) - _rad(lat1)) / 2
    half_lng = (_rad(lng2) - _rad(lng1)) / 2
    a = F.pow(F.sin(half_lat), F.lit(2)) + F.cos(_rad(lat1)) * F.cos(_rad(lat2)) * F.pow(
        F.sin(half_lng), F.lit(2)
    )
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def bearings(lat: Column, lng: Column) -> Column:
    """The parts of a position that the cosine formula needs, computed once per row before a join."""
    return F.struct(
        F.sin(_rad(lat)).alias("sin_lat"), F.cos(_rad(lat)).alias("cos_lat"), _rad(lng).alias("lng")
    )


def cosine_between(a: Column, b: Column) -> Column:
    """Cosine of the angle between two ``bearings``.

    Clamped: coincident points can give a value just above 1.
    """
    cosine = a["cos_lat"] * b["cos_lat"] * F.cos(b["lng"] - a["lng"]) + a["sin_lat"] * b["sin_lat"]
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))


def arc_km(cosine: Column) -> Column:
    return F.lit(EARTH_RADIUS_KM) * F.acos(cosine)


def cosine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Spherical law of cosines, unrounded."""
    return arc_km(cosine_between(bearings(lat1, lng1), bearings(lat2, lng2)))


def km_steps(distance: Column) -> Column:
    """Kilometres to two places, half up, as a whole number of 10-metre steps (cheap per pair)."""
    return F.floor(distance * 100 + 0.5)


def steps_to_km(steps: Column) -> Column:
    return (steps.cast("decimal(10,0)") * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(10,2)")


def cosine_distance_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    return steps_to_km(km_steps(cosine_km(lat1, lng1, lat2, lng2)))
