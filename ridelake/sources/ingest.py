"""Validation of incoming rows: vehicles, registrations, complaints, pings (survey SRC4-SRC7)."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridelake.functions.text import fold, is_blank, leading_int
from ridelake.operators.decisions import accepted, first_reason, fixed, rejected, with_first
from ridelake.plans.components import components
from ridelake.plans.keyed import join_per_key
from ridelake.plans.session import cut
from ridelake.schema import VEHICLE_TYPES

# Accepted vehicle years.
FIRST_YEAR, LAST_YEAR = 2000, 2026


def _any_blank(*columns: str):
    return reduce(lambda a, b: a | b, [is_blank(F.col(c)) for c in columns])


def ingest_vehicles(
    raw: DataFrame, drivers: DataFrame, vehicles: DataFrame, completing: bool = False
) -> dict[str, DataFrame]:
    """New vehicles: trimmed, plate in upper case, unique, of a known driver.

    ``completing=True`` is profile completion: vehicles come verified, their drivers become
    verified and available, and a position given with the form becomes a first ping.
    """
    cleaned = raw.select(
        "request_id", "driver_id",
        F.upper(F.trim("license_plate")).alias("license_plate"),
        *[F.trim(c).alias(c) for c in ("make", "model", "color")],
        leading_int(F.col("year")).alias("year"), is_blank(F.col("year")).alias("_no_year"),
        fold(F.col("vehicle_type")).alias("vehicle_type"), "latitude", "longitude", "submitted_at",
    )
    known = drivers.select(F.col("driver_id").alias("_driver"))
    plates = vehicles.select(F.upper(F.trim("license_plate")).alias("license_plate")).distinct()
    joined = join_per_key(cleaned, plates.withColumn("_taken", F.lit(True)), ["license_plate"]).join(
        known, F.col("driver_id") == F.col("_driver"), "left"
    )
    missing = _any_blank("license_plate", "make", "model", "color", "vehicle_type") | F.col("_no_year")
    checked = joined.withColumn(
        "_reason",
        first_reason(
            ("missing_fields", missing),
            ("invalid_year", ~F.coalesce(F.col("year").between(FIRST_YEAR, LAST_YEAR), F.lit(False))),
            ("invalid_type", ~F.col("vehicle_type").isin(*VEHICLE_TYPES)),
            ("unknown_driver", F.col("_driver").isNull()),
            ("duplicate_plate", F.col("_taken").isNotNull()),
        ),
    )
    ranked = with_first(
        checked, ["license_plate"], ["submitted_at", "request_id"], F.col("_reason").isNull()
    )
    late = F.when(F.col("_reason").isNull() & F.col("after_first"), F.lit("duplicate_plate"))
    decided = ranked.withColumn("reject_reason", F.coalesce("_reason", late)).select(
        "request_id", "driver_id", "license_plate", "make", "model", "year", "color", "vehicle_type",
        "latitude", "longitude", "submitted_at", "reject_reason",
    )
    decided = fixed(decided)
    done = accepted(decided)
    status = F.lit("verified" if completing else "pending")
    out = {
        "decided": decided,
        "vehicles": done.select(
            F.col("request_id").alias("vehicle_id"), "driver_id", "license_plate", "make", "model",
            "year", "color", "vehicle_type", status.alias("verification_status"),
            F.lit(0).alias("total_trips"),
        ),
        "rejected": rejected(decided),
    }
    if completing:
        out["driver_changes"] = done.select(
            F.col("request_id").alias("change_id"), "driver_id", F.lit("verified").alias("verification_status"),
            F.lit("available").alias("availability_status"), F.col("submitted_at").alias("changed_at"),
        )
        out["pings"] = done.where("latitude IS NOT NULL AND longitude IS NOT NULL").select(
            F.col("request_id").alias("location_id"), "driver_id", "latitude", "longitude",
            F.col("submitted_at").alias("timestamp"),
        )
    return out


def _in_rounds(pairs: DataFrame, rounds: int | None = None) -> tuple[list[DataFrame], DataFrame]:
    """Winners among (email_key, phone_key, position), and what ``rounds`` rounds of joins leave open (default: nothing).

    A request that is first for both its keys is accepted, whatever the others do. Its rivals drop out, which makes
    others first; so it takes a round per link of the longest chain of conflicts.
    """
    open_rows, winners = cut(pairs), []
    while not open_rows.isEmpty() and (rounds is None or len(winners) < rounds):
        by_email = open_rows.groupBy("email_key").agg(F.min(F.struct("position", "phone_key")).alias("first"))
        by_phone = open_rows.groupBy("phone_key").agg(F.min(F.struct("position", "email_key")).alias("first"))
        firsts = cut(
            by_email.select("email_key", "first.*").join(
                by_phone.select("phone_key", "first.*"), ["email_key", "phone_key", "position"]
            )
        )
        winners.append(firsts.select(F.col("position.request_id").alias("request_id")))
        open_rows = cut(
            open_rows.join(firsts.select("email_key"), "email_key", "left_anti")
            .join(firsts.select("phone_key"), "phone_key", "left_anti")
        )
    return winners, open_rows


def _in_order(requests: pd.DataFrame) -> pd.DataFrame:
    """Winners of one component of conflicts, one request after the other."""
    emails, phones, won = set(), set(), []
    ordered = requests.sort_values(["submitted_at", "request_id"], na_position="first", kind="stable")
    for email, phone, request in zip(ordered["email_key"], ordered["phone_key"], ordered["request_id"], strict=True):
        if email not in emails and phone not in phones:
            emails.add(email)
            phones.add(phone)
            won.append(request)
    return pd.DataFrame({"request_id": pd.array(won, "Int64")})


def _first_come(candidates: DataFrame, rounds: int = 4, largest: int = 100_000) -> DataFrame:
    """Ids accepted when requests are taken in order and each needs a free email and a free phone.

    A rejected request blocks nobody, so taking 'first per email and first per phone' once would refuse too many. A few rounds
    of joins settle all but the long chains. What they leave falls into components linked by shared keys: one of
    at most ``largest`` requests is settled in order by one task, a larger one in further rounds.
    """
    position = F.struct("submitted_at", "request_id").alias("position")
    pairs = candidates.groupBy("email_key", "phone_key").agg(F.min(position).alias("position"))
    winners, left = _in_rounds(pairs, rounds)
    if not left.isEmpty():
        # Hashed keys: two that collide only make one component of two.
        linked = cut(left.select(
            "*", F.xxhash64(F.lit("email"), "email_key").alias("a"), F.xxhash64(F.lit("phone"), "phone_key").alias("b")
        ))
        roots = cut(components(linked.select("a", "b")).select(F.col("node").alias("a"), "root"))
        placed = cut(join_per_key(linked, roots, ["a"], "inner"))
        sizes = cut(placed.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > largest).select("root"))
        small = placed.join(sizes, "root", "left_anti").select("root", "email_key", "phone_key", "position.*")
        winners.append(small.groupBy("root").applyInPandas(_in_order, "request_id long"))
        if not sizes.isEmpty():
            large = join_per_key(placed, sizes, ["root"], "inner").select("email_key", "phone_key", "position")
            winners += _in_rounds(large)[0]
    return reduce(DataFrame.unionByName, winners) if winners else left.select(F.col("position.request_id").alias("request_id"))


def ingest_registrations(raw: DataFrame, users: DataFrame) -> dict[str, DataFrame]:
    """New riders and drivers with free email and phone; drivers also give their papers.

    Existing accounts are matched by two equi-joins, one per key: a join on 'same email or same
    phone' would compare all pairs.
    """
    papers = _any_blank("cnic", "license_number")
    checked = raw.withColumn("email_key", fold(F.col("email"))).withColumn(
        "phone_key", fold(F.col("phone_number"))
    ).withColumn(
        "_reason",
        first_reason(
            ("missing_fields", _any_blank("fname", "lname", "email", "phone_number", "role")),
            ("invalid_role", ~F.coalesce(F.col("role").isin("rider", "driver"), F.lit(False))),
            ("missing_papers", (F.col("role") == "driver") & papers),
        ),
    )
    emails = users.select(fold(F.col("email")).alias("email_key"))
    phones = users.select(fold(F.col("phone_number")).alias("phone_key"))
    candidates = (
        checked.where("_reason IS NULL").select("request_id", "submitted_at", "email_key", "phone_key")
        .join(emails, "email_key", "left_anti").join(phones, "phone_key", "left_anti")
    )
    free = _first_come(candidates).withColumn("_free", F.lit(True))
    decided = checked.join(free, "request_id", "left").withColumn(
        "reject_reason",
        F.coalesce("_reason", F.when(F.col("_free").isNull(), F.lit("duplicate"))),
    ).select(*raw.columns, "reject_reason")
    decided = fixed(decided)
    done = accepted(decided)
    stub_id = F.col("request_id")
    new_users = done.select(
        stub_id.alias("user_id"), "fname", "lname", "email", "phone_number", "role",
        F.lit("active").alias("account_status"), F.lit(0).cast("decimal(10,2)").alias("wallet_balance"),
        F.lit(None).cast("string").alias("city"), F.col("submitted_at").alias("registration_date"),
    )
    new_drivers = done.where("role = 'driver'").select(
        stub_id.alias("driver_id"), stub_id.alias("user_id"), "cnic", "license_number",
        F.lit(None).cast("string").alias("profile_photo"),
        F.lit("pending").alias("verification_status"), F.lit("offline").alias("availability_status"),
        F.lit(0).cast("decimal(3,2)").alias("average_rating"), F.lit(0).alias("total_trips"),
    )
    return {
        "decided": decided, "users": new_users, "driver": new_drivers, "rejected": rejected(decided),
    }


def ingest_complaints(raw: DataFrame, rides: DataFrame) -> dict[str, DataFrame]:
    """New open complaints about existing rides."""
    known = rides.select(F.col("ride_id").alias("_ride"))
    joined = raw.join(known, F.col("ride_id") == F.col("_ride"), "left")
    decided = joined.withColumn(
        "reject_reason",
        first_reason(
            ("missing_fields", F.col("ride_id").isNull() | is_blank(F.col("description"))),
            ("ride_not_found", F.col("_ride").isNull()),
        ),
    ).select(*raw.columns, "reject_reason")
    decided = fixed(decided)
    new = accepted(decided).select(
        F.col("request_id").alias("complaint_id"), "ride_id", "user_id", "description",
        F.lit("open").alias("status"), F.col("submitted_at").alias("timestamp"),
    )
    return {"decided": decided, "complaints": new, "rejected": rejected(decided)}


def judge_pings(pings: DataFrame, drivers: DataFrame) -> DataFrame:
    """Pings with a reject reason."""
    known = drivers.select("driver_id", F.col("driver_id").alias("_driver"))
    return join_per_key(pings, known, ["driver_id"]).withColumn(
        "reject_reason",
        first_reason(
            ("missing_coordinates", F.col("latitude").isNull() | F.col("longitude").isNull()),
            ("unknown_driver", F.col("_driver").isNull()),
        ),
    ).drop("_driver")


def validity(versions: DataFrame) -> DataFrame:
    """Drivers' versions with the time each one ends; of rows with one time the active one holds, the last ends never."""
    one = versions.groupBy("driver_id", "valid_from").agg(F.bool_or("active").alias("active"))
    by_time = Window.partitionBy("driver_id").orderBy("valid_from")
    return one.withColumn("valid_to", F.lead("valid_from").over(by_time))


def judge_pings_as_of(pings: DataFrame, versions: DataFrame) -> DataFrame:
    """Pings with a reject reason, each judged by the version of its driver at the time of the ping.

    Before its first version a driver is not known, in an inactive one not active. A ping without time has no version.
    Versions follow each other without gap or overlap, so a ping meets one at most and stays one row.
    """
    known = cut(validity(versions)).withColumnRenamed("driver_id", "_driver")  # fixed, so that a busy driver's pings can be split
    of_its_time = (
        (F.col("driver_id") == F.col("_driver")) & (F.col("timestamp") >= F.col("valid_from"))
        & (F.col("valid_to").isNull() | (F.col("timestamp") < F.col("valid_to")))
    )
    reason = first_reason(
        ("missing_coordinates", F.col("latitude").isNull() | F.col("longitude").isNull()),
        ("unknown_driver", F.col("active").isNull()), ("inactive_driver", ~F.col("active")),
    )
    return pings.join(known, of_its_time, "left").select(*pings.columns, reason.alias("reject_reason"))
