"""Constraint audit: one row per rule with the number of violating rows (survey SRC8)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelake import schema as S
from ridelake.operators.common import Tables

# The declared constraints of each table.
NOT_NULL = {
    "users": ("user_id", "fname", "lname", "email", "phone_number", "role", "wallet_balance"),
    "driver": ("driver_id", "user_id", "cnic", "license_number"),
    "vehicles": ("vehicle_id", "driver_id", "license_plate", "vehicle_type"),
    "location": ("location_id", "latitude", "longitude"),
    "driver_location": ("location_id", "driver_id", "latitude", "longitude"),
    "fare_rules": ("vehicle_type", "base_fare", "per_km_rate", "per_min_rate", "surge_peak_mult",
                   "surge_demand_mult"),
    "promo_code": ("promo_id", "code", "discount_amount", "expiry_date", "usage_count"),
    "rides": ("ride_id", "user_id", "pickup_location_id", "dropoff_location_id"),
    "ride_history": ("history_id", "ride_id", "status"),
    "payments": ("payment_id", "ride_id", "user_id", "amount", "payment_method"),
    "ratings": ("rating_id", "ride_id", "rated_by", "rated_user_id", "score"),
    "complaints": ("complaint_id", "ride_id", "user_id", "description"),
    "admin_notifications": ("notification_id", "type", "message", "is_read"),
}
CHECKS = {
    "users": ("wallet_balance >= 0",),
    "driver": ("average_rating BETWEEN 0 AND 5", "total_trips >= 0"),
    "vehicles": ("year >= 2000", "total_trips >= 0"),
    "fare_rules": ("base_fare >= 0", "per_km_rate >= 0", "per_min_rate >= 0", "surge_peak_mult >= 1",
                   "surge_demand_mult >= 1"),
    "promo_code": ("discount_amount > 0", "usage_count >= 0"),
    "rides": ("fare >= 0",),
    "payments": ("amount >= 0",),
    "ratings": ("score BETWEEN 1 AND 5",),
    "location": ("NOT (latitude = 0 AND longitude = 0)",),
}
DOMAINS = {
    "users": {"role": S.ROLES, "account_status": S.ACCOUNT_STATUSES},
    "driver": {"verification_status": S.VERIFICATION_STATUSES, "availability_status": S.AVAILABILITY_STATUSES},
    "vehicles": {"vehicle_type": S.VEHICLE_TYPES, "verification_status": S.VERIFICATION_STATUSES},
    "fare_rules": {"vehicle_type": S.VEHICLE_TYPES},
    "rides": {"ride_status": S.RIDE_STATUSES},
    "payments": {"payment_method": S.PAYMENT_METHODS, "payment_status": S.PAYMENT_STATUSES},
    "complaints": {"status": S.COMPLAINT_STATUSES},
}
UNIQUE = {
    "users": ("user_id", "email", "phone_number"),
    "driver": ("driver_id", "user_id", "cnic", "license_number"),
    "vehicles": ("vehicle_id", "license_plate"),
    "location": ("location_id",),
    "driver_location": ("location_id",),
    "fare_rules": ("vehicle_type",),
    "promo_code": ("promo_id", "code"),
    "rides": ("ride_id",),
    "ride_history": ("history_id",),
    "payments": ("payment_id",),
    "ratings": ("rating_id",),
    "complaints": ("complaint_id",),
    "admin_notifications": ("notification_id",),
}
FOREIGN_KEYS = {
    "driver": {"user_id": "users.user_id"},
    "vehicles": {"driver_id": "driver.driver_id"},
    "driver_location": {"driver_id": "driver.driver_id"},
    "rides": {
        "user_id": "users.user_id", "driver_id": "driver.driver_id", "vehicle_id": "vehicles.vehicle_id",
        "pickup_location_id": "location.location_id", "dropoff_location_id": "location.location_id",
    },
    "ride_history": {"ride_id": "rides.ride_id"},
    "payments": {
        "ride_id": "rides.ride_id", "user_id": "users.user_id", "promo_id": "promo_code.promo_id",
    },
    "ratings": {
        "ride_id": "rides.ride_id", "rated_by": "users.user_id", "rated_user_id": "users.user_id",
    },
    "complaints": {"ride_id": "rides.ride_id", "user_id": "users.user_id"},
    "admin_notifications": {"ref_user_id": "users.user_id"},
}


def row_rules(table: str) -> dict[str, str]:
    """Rule name to SQL condition that a good row meets (NULL counts as met)."""
    rules = {f"not_null {c}": f"{c} IS NOT NULL" for c in NOT_NULL.get(table, ())}
    rules.update({f"check {c}": c for c in CHECKS.get(table, ())})
    for column, domain in DOMAINS.get(table, {}).items():
        values = ", ".join(f"'{v}'" for v in domain)
        rules[f"domain {column}"] = f"{column} IN ({values})"
    return rules


def _result(df: DataFrame, table: str, rule: str, violations) -> DataFrame:
    return df.agg(
        F.lit(table).alias("table_name"), F.lit(rule).alias("rule"),
        F.coalesce(violations, F.lit(0)).cast("bigint").alias("violations"),
    )


def _row_violations(df: DataFrame, table: str) -> DataFrame:
    """All row rules of a table in one pass, turned into one row per rule."""
    rules = row_rules(table)
    counted = df.agg(
        *[F.count_if(F.expr(f"NOT ({condition})")).alias(f"r{i}") for i, condition in enumerate(rules.values())]
    )
    pairs = F.array(
        *[F.struct(F.lit(rule).alias("rule"), F.col(f"r{i}").alias("violations")) for i, rule in enumerate(rules)]
    )
    return counted.select(F.lit(table).alias("table_name"), F.inline(pairs))


def constraint_audit(t: Tables) -> DataFrame:
    """Violations of every declared rule.

    Keys are counted before they are compared, so a value held by very many rows is one row by
    the time it is shuffled.
    """
    parts = [_row_violations(t[table], table) for table in NOT_NULL]
    for table, keys in UNIQUE.items():
        for key in keys:
            counts = t[table].where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
            parts.append(_result(counts, table, f"unique {key}", F.sum(F.col("n") - 1)))
    for table, links in FOREIGN_KEYS.items():
        for column, target in links.items():
            parent, parent_key = target.split(".")
            used = t[table].where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_key")).agg(
                F.count(F.lit(1)).alias("n")
            )
            parents = t[parent].select(F.col(parent_key).alias("_key"))
            orphans = used.join(parents, "_key", "left_anti")
            parts.append(_result(orphans, table, f"foreign_key {column}", F.sum("n")))
    return reduce(DataFrame.unionByName, parts)
