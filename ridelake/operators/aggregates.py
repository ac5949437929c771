"""Revenue, earnings, rating and rider aggregates (survey AG1-AG22).

Payments and complaints are first reduced to one row per ride (combined inside each task before
the shuffle), so neither a hot ride nor the fan-out of a join reaches the driver or city level.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelake.functions.money import (
    commission, commission2, driver_net, driver_net2, mean, total_money, rating2,
)
from ridelake.functions.text import fold
from ridelake.functions.timeops import between_days
from ridelake.operators.common import Tables, count_rows, flag_sum
from ridelake.schema import ACTIVE_RIDE_STATUSES, LOW_DRIVER_RATING, REPORT_DAYS



def _zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0))


def paid_per_ride(t: Tables) -> DataFrame:
    """Number and sum of paid payments per ride."""
    paid = t["payments"].where("payment_status = 'paid'")
    return paid.groupBy("ride_id").agg(
        F.count("payment_id").alias("paid_count"), F.sum("amount").alias("paid_sum")
    )


def platform_summary(t: Tables) -> DataFrame:
    """One row over users, rides, paid payments and drivers.

    ``total_drivers`` counts driver rows. The four parts are scalar subqueries, so no join runs.
    """
    status, verification = F.col("ride_status"), F.col("verification_status")
    amount = F.sum("amount")
    parts = {
        "users": t["users"].agg(
            count_rows("total_users"), flag_sum(F.col("role") == "rider", "total_riders")
        ),
        "rides": t["rides"].agg(
            count_rows("total_rides"),
            flag_sum(status == "completed", "completed_rides"),
            flag_sum(status == "cancelled", "cancelled_rides"),
            flag_sum(status.isin(*ACTIVE_RIDE_STATUSES), "active_rides"),
        ),
        "payments": t["payments"].where("payment_status = 'paid'").agg(
            total_money(amount).alias("total_revenue"),
            commission(amount).alias("platform_commission"),
            driver_net(amount).alias("driver_payouts"),
        ),
        "drivers": t["driver"].agg(
            count_rows("total_drivers"),
            flag_sum(verification == "verified", "verified_drivers"),
            flag_sum(verification == "pending", "pending_verification"),
            flag_sum(F.col("availability_status") == "available", "online_drivers"),
        ),
    }
    one_row = t["users"].sparkSession.range(1)
    packed = one_row.select(
        *[part.select(F.struct(*part.columns)).scalar().alias(name) for name, part in parts.items()]
    )
    return packed.select(*[f"{name}.*" for name in parts])


def _days(t: Tables, start=None, end=None, end_inclusive=True) -> DataFrame | None:
    """Partials of a summary (``operators.summaries``) that stands beside the tables, where it can answer for the range."""
    if "payment_days" not in t or any(len(str(moment)) > 10 for moment in (start, end) if moment is not None):
        return None
    days, date = t["payment_days"], F.col("date")
    if start is not None:
        days = days.where(date >= F.lit(str(start)).cast("date"))
    if end is not None:
        last = F.lit(str(end)).cast("date")
        days = days.where(date <= last if end_inclusive else (date < last) | ((date == last) & F.col("midnight")))
    return days


def _paid_daily(t: Tables, start=None, end=None, end_inclusive=True) -> DataFrame:
    days = _days(t, start, end, end_inclusive)
    if days is not None:
        return days.where("payment_status = 'paid'").groupBy("date", "payment_method").agg(
            F.sum("n").alias("n"), F.sum("total").cast("decimal(20,2)").alias("total")
        )
    paid = t["payments"].where("payment_status = 'paid'")
    in_range = between_days(F.col("transaction_date"), start, end, end_inclusive)
    if in_range is not None:
        paid = paid.where(in_range)
    day = F.to_date("transaction_date").alias("date")
    return paid.groupBy(day, "payment_method").agg(
        F.count("payment_id").alias("n"), F.sum("amount").alias("total")
    )


def _revenue_columns(total: Column) -> list[Column]:
    return [
        total_money(total).alias("gross_revenue"),
        commission(total).alias("platform_commission"),
        driver_net(total).alias("driver_payouts"),
    ]


def platform_revenue(t: Tables) -> DataFrame:
    """Paid payments by day and method."""
    return _paid_daily(t).select(
        "date", F.col("n").alias("total_transactions"), *_revenue_columns(F.col("total")),
        "payment_method",
    )


def revenue_report_range(t: Tables, start=None, end=None, as_of=None) -> DataFrame:
    """``platform_revenue`` within whole days ``start``..``end``, by default the 30 days to ``as_of``."""
    if as_of is not None:
        day = dt.date.fromisoformat(str(as_of)[:10])
        start, end = start or day - dt.timedelta(days=REPORT_DAYS), end or day
    return (
        _paid_daily(t, start, end)
        .select(
            "date", F.col("n").alias("total_transactions"), *_revenue_columns(F.col("total")),
            "payment_method",
        )
        .orderBy("date", "payment_method")
    )


def revenue_report_admin(t: Tables, start=None, end=None, end_inclusive: bool = False) -> DataFrame:
    """Count, total and commission by day and method; the range stops at midnight of ``end``."""
    total = F.col("total")
    return (
        _paid_daily(t, start, end, end_inclusive)
        .select(
            "date", "payment_method", F.col("n").alias("transactions"),
            total_money(total).alias("total_amount"), commission(total).alias("commission"),
        )
        .orderBy(F.desc("date"), "payment_method")
    )


def revenue_report_finance(t: Tables, start=None, end=None) -> DataFrame:
    """By day and method, whole days, shares rounded to cents."""
    total = F.col("total")
    return (
        _paid_daily(t, start, end)
        .select(
            "date", "payment_method", F.col("n").alias("total_transactions"),
            total_money(total).alias("gross_revenue"),
            commission2(total, total_money).alias("platform_commission"),
            driver_net2(total, total_money).alias("driver_payouts"),
        )
        .orderBy(F.desc("date"), "payment_method")
    )


def revenue_totals(t: Tables, start=None, end=None) -> DataFrame:
    """Totals of the finance report's rounded rows."""
    return revenue_report_finance(t, start, end).agg(
        _zero(F.sum("total_transactions")).cast("bigint").alias("total_transactions"),
        *[total_money(_zero(F.sum(c))).alias(c) for c in ("gross_revenue", "platform_commission", "driver_payouts")],
    )


def rides_report(t: Tables, start=None, end=None, end_inclusive: bool = False) -> DataFrame:
    """Rides by request day and status."""
    rides = t["rides"]
    in_range = between_days(F.col("request_time"), start, end, end_inclusive)
    if in_range is not None:
        rides = rides.where(in_range)
    return (
        rides.groupBy(F.to_date("request_time").alias("date"), "ride_status")
        .agg(
            count_rows("count"), F.sum("fare").alias("_fares"), F.count("fare").alias("_n"),
        )
        .select(
            "date", "ride_status", "count", mean(F.col("_fares"), F.col("_n")).alias("avg_fare"),
            total_money(F.col("_fares")).alias("total_fare"),
        )
        .orderBy(F.desc("date"), "ride_status")
    )


def _completed_by_driver(t: Tables) -> DataFrame:
    """Per driver over completed rides: joined rows, paid payments and their sum.

    ``joined_rows`` counts a ride once per paid payment, and once when it has none.
    """
    rides = t["rides"].where("ride_status = 'completed' AND driver_id IS NOT NULL").select(
        "ride_id", "driver_id"
    )
    return (
        rides.join(paid_per_ride(t), "ride_id", "left")
        .groupBy("driver_id")
        .agg(
            F.sum(F.greatest(F.lit(1), _zero(F.col("paid_count")))).alias("joined_rows"),
            F.sum(_zero(F.col("paid_count"))).alias("paid_count"),
            F.sum("paid_sum").alias("paid_sum"),
        )
    )


def _drivers_with(t: Tables, per_driver: DataFrame, *user_columns: str) -> DataFrame:
    people = t["users"].select("user_id", *user_columns)
    return t["driver"].join(people, "user_id").join(per_driver, "driver_id", "left")


def driver_earnings_admin(t: Tables) -> DataFrame:
    """Every driver; ``total_rides`` follows the join, so a ride counts once per paid payment."""
    total = _zero(F.col("paid_sum"))
    return (
        _drivers_with(t, _completed_by_driver(t), "fname", "lname", "city")
        .select(
            "driver_id", "fname", "lname", "city",
            _zero(F.col("joined_rows")).cast("bigint").alias("total_rides"),
            total_money(total).alias("total_earned"), driver_net(total).alias("driver_net"),
            commission(total).alias("commission_paid"), "average_rating",
        )
        .orderBy(F.desc("total_earned"), "driver_id")
    )


def driver_earnings_finance(t: Tables) -> DataFrame:
    """Every driver; ``total_rides`` counts paid payments."""
    total = _zero(F.col("paid_sum"))
    return (
        _drivers_with(t, _completed_by_driver(t), "fname", "lname", "email")
        .select(
            "driver_id", "fname", "lname", "email",
            _zero(F.col("paid_count")).cast("bigint").alias("total_rides"),
            total_money(total).alias("gross_earned"), driver_net2(total, total_money).alias("net_earned"),
            commission2(total, total_money).alias("commission_paid"), "average_rating", "total_trips",
        )
        .orderBy(F.desc("gross_earned"), "driver_id")
    )


def driver_earnings_summary(t: Tables) -> DataFrame:
    """Paid payments per driver over rides of any status."""
    rides = t["rides"].where("driver_id IS NOT NULL").select("ride_id", "driver_id")
    total = F.sum("paid_sum")
    return (
        paid_per_ride(t).join(rides, "ride_id").groupBy("driver_id")
        .agg(
            F.sum("paid_count").cast("bigint").alias("total_trips"),
            total_money(total).alias("gross_earned"), driver_net2(total, total_money).alias("net_earned"),
            commission2(total, total_money).alias("commission_paid"),
        )
    )


def driver_fare_earnings(t: Tables) -> DataFrame:
    """Per driver from the fares of completed rides."""
    total = F.sum("fare")
    return (
        t["rides"].where("ride_status = 'completed' AND driver_id IS NOT NULL").groupBy("driver_id")
        .agg(
            count_rows("total_rides"), total_money(total).alias("total_fare"),
            driver_net(total).alias("driver_earnings"), commission(total).alias("platform_commission"),
        )
    )


def trips_per_driver(t: Tables) -> DataFrame:
    return (
        _drivers_with(t, _completed_by_driver(t), "fname", "lname")
        .select(
            "driver_id", "fname", "lname",
            _zero(F.col("joined_rows")).cast("bigint").alias("completed_trips"),
            total_money(_zero(F.col("paid_sum"))).alias("total_earned"),
        )
        .orderBy(F.desc("completed_trips"), "driver_id")
    )


_PERFORMANCE = (
    "driver_id", "fname", "lname", "city", "average_rating", "total_trips", "verification_status",
    "availability_status",
)


def _performance(t: Tables, fan_out: bool) -> DataFrame:
    rides = t["rides"].where("ride_status = 'completed' AND driver_id IS NOT NULL").select(
        "ride_id", "driver_id"
    )
    complaints = t["complaints"].groupBy("ride_id").agg(F.count("complaint_id").alias("complaints"))
    per_ride = rides.join(paid_per_ride(t), "ride_id", "left").join(complaints, "ride_id", "left")
    # Rows that a payments x complaints join of one ride would give, without producing them.
    copies_of_complaint = F.greatest(F.lit(1), _zero(F.col("paid_count"))) if fan_out else F.lit(1)
    copies_of_payment = F.greatest(F.lit(1), _zero(F.col("complaints"))) if fan_out else F.lit(1)
    per_driver = per_ride.groupBy("driver_id").agg(
        F.sum(_zero(F.col("complaints")) * copies_of_complaint).alias("total_complaints"),
        F.sum(F.col("paid_sum") * copies_of_payment).alias("_earned"),
    )
    return _drivers_with(t, per_driver, "fname", "lname", "city").select(
        *_PERFORMANCE, _zero(F.col("total_complaints")).cast("bigint").alias("total_complaints"),
        driver_net(F.col("_earned").cast("decimal(30,2)")).alias("total_earnings"),
    )


def driver_performance(t: Tables) -> DataFrame:
    """Complaints and 80% earnings per driver, multiplied by the join of both facts on a ride."""
    return _performance(t, fan_out=True)


def driver_performance_deduped(t: Tables) -> DataFrame:
    """``driver_performance`` with every complaint and payment counted once."""
    return _performance(t, fan_out=False)


def revenue_by_city(t: Tables, include_null: bool = True) -> DataFrame:
    """Paid revenue by pickup city; spellings that differ in case only are one city."""
    rides = t["rides"].select("ride_id", F.col("pickup_location_id").alias("location_id"))
    places = t["location"].select("location_id", "city")
    if not include_null:
        places = places.where("city IS NOT NULL")
    total = F.sum("paid_sum")
    return (
        paid_per_ride(t).join(rides, "ride_id").join(places, "location_id")
        .groupBy(fold(F.col("city")).alias("_city"))
        .agg(
            F.min("city").alias("city"), F.sum("paid_count").cast("bigint").alias("total_rides"),
            total_money(total).alias("total_revenue"), commission(total).alias("platform_commission"),
            driver_net(total).alias("driver_payouts"),
        )
        .drop("_city")
        .orderBy(F.desc("total_revenue"), "city")
    )


def _rides_by_user(t: Tables) -> DataFrame:
    status = F.col("ride_status")
    return t["rides"].groupBy("user_id").agg(
        count_rows("total"),
        F.sum(F.when(status == "completed", 1).otherwise(0)).alias("completed"),
        F.sum(F.when(status == "cancelled", 1).otherwise(0)).alias("cancelled"),
        F.sum(F.when(status == "completed", F.col("fare")).otherwise(F.lit(0))).alias("spent"),
    )


def all_riders_report(t: Tables, with_wallet: bool = False) -> DataFrame:
    """Every rider including those without rides; ``with_wallet`` is the admin form."""
    riders = t["users"].where("role = 'rider'")
    wallet = ["wallet_balance"] if with_wallet else []
    return (
        riders.join(_rides_by_user(t), "user_id", "left")
        .select(
            "user_id", "fname", "lname", "email", "phone_number", "city", *wallet,
            "registration_date", _zero(F.col("total")).cast("bigint").alias("total_rides"),
            _zero(F.col("completed")).cast("bigint").alias("completed_rides"),
            total_money(_zero(F.col("spent"))).alias("total_spent"),
        )
        .orderBy(F.desc("completed_rides"), "user_id")
    )


def received_scores(t: Tables) -> DataFrame:
    """Unrounded mean, its stored two-place form and number of ratings per rated user."""
    return t["ratings"].groupBy(F.col("rated_user_id").alias("user_id")).agg(
        F.avg("score").alias("avg_score"), F.count("rating_id").alias("total_ratings"),
        rating2(F.sum("score"), F.count("score")).alias("stored_rating"),
    )


def _low_rated(t: Tables, *user_columns: str) -> DataFrame:
    low = received_scores(t).where(F.col("avg_score") < F.lit(LOW_DRIVER_RATING).cast("double"))
    people = t["users"].select("user_id", *user_columns)
    return t["driver"].join(low, "user_id").join(people, "user_id").withColumn(
        "avg_rating", F.round("avg_score", 6)
    )


def low_rated_drivers(t: Tables) -> DataFrame:
    return (
        _low_rated(t, "fname", "lname", "city")
        .select("driver_id", "fname", "lname", "city", "avg_rating", "total_ratings")
        .orderBy("avg_rating", "driver_id")
    )


def low_rated_drivers_admin(t: Tables) -> DataFrame:
    return (
        _low_rated(t, "fname", "lname", "email", "city", "account_status")
        .select(
            "driver_id", "fname", "lname", "email", "city", "avg_rating", "total_ratings",
            "total_trips", "account_status",
        )
        .orderBy("avg_rating", "driver_id")
    )


def rider_stats(t: Tables) -> DataFrame:
    return _rides_by_user(t).select(
        "user_id", F.col("total").alias("total_rides"), F.col("completed").cast("bigint").alias("completed"),
        F.col("cancelled").cast("bigint").alias("cancelled"), total_money(_zero(F.col("spent"))).alias("total_spent"),
    )


def _disputed(t: Tables, start=None, end=None) -> DataFrame:
    """Failed and refunded payments, or sums of ``weight`` such payments of a day."""
    days = _days(t, start, end)
    if days is not None:
        rows = days.select("date", "payment_status", F.col("total").alias("amount"), F.col("rows").alias("weight"))
    else:
        rows, in_range = t["payments"], between_days(F.col("transaction_date"), start, end)
        if in_range is not None:
            rows = rows.where(in_range)
        rows = rows.select(F.to_date("transaction_date").alias("date"), "payment_status", "amount", F.lit(1).alias("weight"))
    return rows.where(F.col("payment_status").isin("failed", "refunded"))


def _amount_if(status: str) -> Column:
    return total_money(F.sum(F.when(F.col("payment_status") == status, F.col("amount")).otherwise(F.lit(0))))


def _weight(name: str, status: str | None = None) -> Column:
    """Number of payments (no rows: 0), or of those with ``status`` (no rows: null)."""
    if status is None:
        return _zero(F.sum("weight")).cast("bigint").alias(name)
    hit = F.when(F.col("payment_status") == status, F.col("weight")).otherwise(F.lit(0))
    return F.sum(hit).cast("bigint").alias(name)


def refund_totals(t: Tables) -> DataFrame:
    return _disputed(t).agg(
        _amount_if("refunded").alias("total_refunded"), _amount_if("failed").alias("total_failed_amount"),
        _weight("refund_count", "refunded"), _weight("failed_count", "failed"),
    )


def refund_report(t: Tables, start=None, end=None) -> DataFrame:
    return (
        _disputed(t, start, end).groupBy("date", "payment_status")
        .agg(_weight("count"), total_money(F.sum("amount")).alias("total_amount"))
        .orderBy(F.desc("date"), "payment_status")
    )


def dispute_totals(t: Tables) -> DataFrame:
    return _disputed(t).agg(
        _amount_if("refunded").alias("total_refunded"), _weight("total_failed", "failed"), _weight("total_disputes"),
    )



def avg_rating_by_driver(t: Tables) -> DataFrame:
    """Mean score per rated driver; ``stored_rating`` is the two-place value kept on the driver."""
    drivers = t["driver"].select("driver_id", "user_id")
    return (
        drivers.join(received_scores(t), "user_id")
        .select(
            "driver_id", F.round("avg_score", 6).alias("avg_rating"), "stored_rating",
        )
        .orderBy(F.desc("avg_rating"), "driver_id")
    )


def refreshed_driver_ratings(t: Tables) -> DataFrame:
    """Driver snapshot with ``average_rating`` recomputed from the ratings received."""
    scores = received_scores(t).select("user_id", F.col("stored_rating").alias("_new"))
    return t["driver"].join(scores, "user_id", "left").select(
        *[
            F.coalesce("_new", "average_rating").alias(c) if c == "average_rating" else F.col(c)
            for c in t["driver"].columns
        ]
    )
