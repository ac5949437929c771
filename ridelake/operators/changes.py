"""Column-wise last-write-wins change feeds, and the edit endpoints built on them (survey LC9)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelake.operators.decisions import accepted, first_reason, fixed, rejected, with_first
from ridelake.schema import ACCOUNT_STATUSES, AVAILABILITY_STATUSES


def outside(column: str, domain: tuple[str, ...]) -> Column:
    """A set value that is not in the domain."""
    return F.coalesce(~F.col(column).isin(*domain), F.lit(False))


def below(column: str, minimum, strict: bool = False) -> Column:
    value = F.col(column)
    return F.coalesce(value <= minimum if strict else value < minimum, F.lit(False))


def apply_changes(
    snapshot: DataFrame,
    changes: DataFrame,
    key: str,
    order: tuple[str, ...] = ("changed_at", "change_id"),
    checks: Mapping[str, Column] | None = None,
    insert: bool = False,
    defaults: Mapping[str, object] | None = None,
) -> dict[str, DataFrame]:
    """New snapshot after a feed of column updates, with the refused changes.

    A NULL column in a change means 'not set'. Each column takes its latest set value. With an
    ``op`` column, 'delete' removes the row and forgets earlier values; a later upsert starts afresh.
    Updates of unknown keys are refused unless ``insert`` is given. ``checks`` maps a reason to a
    condition that marks a bad change. All folding is by aggregates that combine before the shuffle,
    and replaying the same feed gives the same snapshot.
    """
    has_op = "op" in changes.columns
    columns = [c for c in changes.columns if c in snapshot.columns and c != key]
    rules = list((checks or {}).items())
    judged = changes
    if not insert:
        known = snapshot.select(key, F.lit(True).alias("_known"))
        judged = judged.join(known, key, "left")
        rules.append(("not_found", F.col("_known").isNull()))
    judged = fixed(
        judged.withColumn("reject_reason", first_reason(*rules)).select(*changes.columns, "reject_reason")
    )

    position = F.struct(*order)
    deletes = F.col("op") == "delete" if has_op else F.lit(False)

    def latest(column: str) -> Column:
        sets = F.col(column).isNotNull() | deletes
        return F.max_by(F.struct(F.col(column).alias("value")), F.when(sets, position)).alias(f"_new_{column}")

    folded = accepted(judged).groupBy(key).agg(
        *[latest(c) for c in columns], F.max_by(deletes, position).alias("_gone"),
        F.bool_or(deletes).alias("_reset"),
    )
    fills = defaults or {}

    def column_after(name: str) -> Column:
        if name == key:
            return F.col(name)
        if name in columns:
            touched = F.col(f"_new_{name}")
            value = F.when(touched.isNotNull(), touched["value"]).otherwise(F.col(name))
        else:
            value = F.when(~F.coalesce("_reset", F.lit(False)), F.col(name))
        if name in fills:
            value = F.coalesce(value, F.lit(fills[name]))
        return value.cast(snapshot.schema[name].dataType).alias(name)

    joined = snapshot.join(folded, key, "full_outer" if insert else "left")
    kept = joined.where(~F.coalesce("_gone", F.lit(False)))
    return {
        "snapshot": kept.select(*[column_after(c) for c in snapshot.columns]),
        "decided": judged,
        "rejected": rejected(judged),
    }


def change_account_status(users: DataFrame, changes: DataFrame) -> dict[str, DataFrame]:
    checks = {"invalid_status": outside("account_status", ACCOUNT_STATUSES)}
    return apply_changes(users, changes, "user_id", checks=checks)


def change_profiles(users: DataFrame, changes: DataFrame) -> dict[str, DataFrame]:
    """First name, last name and phone number of users."""
    return apply_changes(users, changes, "user_id")


def change_drivers(drivers: DataFrame, changes: DataFrame) -> dict[str, DataFrame]:
    """Availability, verification result and photo path of drivers."""
    checks = {}
    if "availability_status" in changes.columns:
        checks["invalid_availability"] = outside("availability_status", AVAILABILITY_STATUSES)
    if "verification_status" in changes.columns:
        checks["invalid_verification"] = outside("verification_status", ("verified", "rejected"))
    return apply_changes(drivers, changes, "driver_id", checks=checks)


def verify_vehicles(vehicles: DataFrame, changes: DataFrame) -> dict[str, DataFrame]:
    checks = {"invalid_verification": outside("verification_status", ("verified", "rejected"))}
    return apply_changes(vehicles, changes, "vehicle_id", checks=checks)


def change_promos(promos: DataFrame, changes: DataFrame) -> dict[str, DataFrame]:
    """Create (op 'upsert') and delete (op 'delete') promo codes."""
    checks = {"invalid_discount": below("discount_amount", 0, strict=True)}
    return apply_changes(
        promos, changes, "promo_id", checks=checks, insert=True, defaults={"usage_count": 0}
    )


def change_fare_rules(rules: DataFrame, changes: DataFrame) -> dict[str, DataFrame]:
    """Rates and multipliers by vehicle type; the change time becomes ``updated_at``."""
    checks = {
        "invalid_rate": below("base_fare", 0) | below("per_km_rate", 0) | below("per_min_rate", 0),
        "invalid_multiplier": below("surge_peak_mult", 1) | below("surge_demand_mult", 1),
    }
    return apply_changes(
        rules, changes.withColumn("updated_at", F.col("changed_at")), "vehicle_type", checks=checks
    )


def mark_notifications_read(notifications: DataFrame, changes: DataFrame) -> dict[str, DataFrame]:
    return apply_changes(notifications, changes, "notification_id")


def change_complaint_status(complaints: DataFrame, changes: DataFrame) -> dict[str, DataFrame]:
    checks = {"invalid_status": outside("status", ("resolved", "closed"))}
    return apply_changes(complaints, changes, "complaint_id", checks=checks)


def process_refunds(payments: DataFrame, requests: DataFrame) -> dict[str, DataFrame]:
    """Refund paid payments; a second request finds the payment no longer paid."""
    current = payments.select(F.col("payment_id").alias("_payment"), "payment_status")
    joined = requests.join(current, F.col("payment_id") == F.col("_payment"), "left")
    is_paid = F.coalesce(F.col("payment_status") == "paid", F.lit(False))
    ranked = with_first(joined, ["payment_id"], ["requested_at", "request_id"], is_paid)
    decided = ranked.withColumn(
        "reject_reason",
        first_reason(
            ("payment_not_found", F.col("_payment").isNull()),
            ("not_paid", ~is_paid | F.col("after_first")),
        ),
    ).select(*requests.columns, "reject_reason")
    decided = fixed(decided)
    refunded = accepted(decided).select("payment_id", F.lit("refunded").alias("_status"))
    snapshot = payments.join(refunded, "payment_id", "left").select(
        *[F.coalesce("_status", c).alias(c) if c == "payment_status" else F.col(c) for c in payments.columns]
    )
    return {"snapshot": snapshot, "decided": decided, "rejected": rejected(decided)}
