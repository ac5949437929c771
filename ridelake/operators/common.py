"""Shared dimension frames and small query helpers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelake.functions.text import fold

Tables = Mapping[str, DataFrame]


def only(df: DataFrame, **equal) -> DataFrame:
    """Keep rows equal to the given values; ``None`` means no restriction."""
    for column, value in equal.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df


def only_folded(df: DataFrame, column: str, value: str | None) -> DataFrame:
    return df if value is None else df.where(fold(F.col(column)) == fold(F.lit(value)))


def per_key_order(df: DataFrame, key_value, *order: Column | str) -> DataFrame:
    """Order a list asked for one key. Over all keys, order is per key and left to the sink:
    a global sort of a whole fact table would shuffle it for nothing."""
    return df if key_value is None else df.orderBy(*order)


def flag_sum(condition: Column, name: str) -> Column:
    """Rows meeting a condition, NULL over an empty table."""
    return F.sum(F.when(condition, F.lit(1)).otherwise(F.lit(0))).cast("bigint").alias(name)


def count_rows(name: str) -> Column:
    return F.count(F.lit(1)).alias(name)


def place(t: Tables, end: str, **columns: str) -> DataFrame:
    """Location columns of a ride's ``pickup`` or ``dropoff`` end, keyed like the ride."""
    return t["location"].select(
        F.col("location_id").alias(f"{end}_location_id"),
        *[F.col(source).alias(name) for name, source in columns.items()],
    )


def person(t: Tables, key: str, **columns: str) -> DataFrame:
    """Users columns under new names, keyed by ``key``."""
    return t["users"].select(
        F.col("user_id").alias(key), *[F.col(source).alias(name) for name, source in columns.items()]
    )


def driver_person(t: Tables, how: str = "left", driver: dict | None = None, **columns: str) -> DataFrame:
    """Driver columns with those of the driver's user, one row per driver.

    Joined once on the dimension side, so a ride fact is shuffled on driver_id only.
    """
    d = t["driver"].select(
        "driver_id", F.col("user_id").alias("_driver_user"),
        *[F.col(source).alias(name) for name, source in (driver or {}).items()],
    )
    u = t["users"].select(
        F.col("user_id").alias("_uid"), *[F.col(source).alias(name) for name, source in columns.items()]
    )
    return d.join(u, F.col("_driver_user") == F.col("_uid"), how).drop("_driver_user", "_uid")


def vehicle(t: Tables, **columns: str) -> DataFrame:
    return t["vehicles"].select(
        "vehicle_id", *[F.col(source).alias(name) for name, source in columns.items()]
    )


def with_places(rides: DataFrame, t: Tables, pickup: dict, dropoff: dict) -> DataFrame:
    if pickup:
        rides = rides.join(place(t, "pickup", **pickup), "pickup_location_id", "left")
    if dropoff:
        rides = rides.join(place(t, "dropoff", **dropoff), "dropoff_location_id", "left")
    return rides


ADDRESSES = ({"pickup_address": "address"}, {"dropoff_address": "address"})


def enum_rank(column: str, domain: tuple[str, ...]) -> Column:
    """Sort key of an enum column: its position in the domain, not its spelling."""
    return F.array_position(F.array(*[F.lit(v) for v in domain]), F.col(column))


def past(newest: str, key: str, after: tuple) -> Column:
    """Rows behind the row ``after`` = (time, key) in the order of newest first, then key; rows without a time come last.

    Plain comparisons that reach the scan, so a page deep in the list costs what the first one does.
    """
    moment, last = after
    time, later_key = F.col(newest), F.col(key) > F.lit(last)
    if moment is None:
        return time.isNull() & later_key
    at = F.lit(moment).cast("timestamp_ntz")
    return (time < at) | time.isNull() | ((time == at) & later_key)


def paginate(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """One page. ``order`` must be total (end with the primary key)."""
    page = df.orderBy(*order)
    return (page.offset(offset) if offset else page).limit(limit)
