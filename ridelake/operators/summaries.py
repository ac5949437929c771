"""Daily payment sums that reports are answered from, kept up to date by deltas (survey AG2-AG6, AG19-AG21).

A partial is one row per day, method and status with counts and an exact sum, so partials of any split of the payments add
up. Late payments are more partials of an old day; a payment that changes its status is taken out of one partial and put into
another. The summary's size depends on days, not payments.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelake.sources.snapshots import Snapshot

# ``midnight`` parts payments at 00:00:00 sharp from the rest of their day: one report's range ends with that moment.
KEY = ("date", "midnight", "payment_method", "payment_status")
SCHEMA = "date DATE, midnight BOOLEAN, payment_method STRING, payment_status STRING, n BIGINT, rows BIGINT, total DECIMAL(38,2)"


def payment_partials(payments: DataFrame) -> DataFrame:
    """Counts and sums of payments by day, method and status."""
    at, day = F.col("transaction_date"), F.to_date("transaction_date")
    return payments.groupBy(
        day.alias("date"), (at == day.cast("timestamp_ntz")).alias("midnight"), "payment_method", "payment_status"
    ).agg(
        F.count("payment_id").alias("n"), F.count(F.lit(1)).alias("rows"), F.sum("amount").cast("decimal(38,2)").alias("total")
    )


def status_deltas(payments: DataFrame, changed: DataFrame) -> DataFrame:
    """What takes the payments of ``changed`` (payment_id, new_status) out of their partials and into those of the new status.

    ``payments`` are the rows before the change; a payment is named once.
    """
    hit = payments.join(changed.select("payment_id", "new_status"), "payment_id").where(
        ~F.col("new_status").eqNullSafe(F.col("payment_status"))
    )
    out = payment_partials(hit).withColumns({c: -F.col(c) for c in ("n", "rows", "total")})
    return out.unionByName(payment_partials(hit.withColumn("payment_status", F.col("new_status"))))


def add_up(partials: DataFrame) -> DataFrame:
    """One row per key; keys that nothing is left of go."""
    summed = partials.groupBy(*KEY).agg(
        F.sum("n").alias("n"), F.sum("rows").alias("rows"), F.sum("total").cast("decimal(38,2)").alias("total")
    )
    return summed.where("rows <> 0")


def kept_days(spark: SparkSession, path: str) -> Snapshot:
    """The summary as a table in buckets of days: a merge reads and rewrites the buckets of its days only."""
    return Snapshot(spark, path, SCHEMA, ("date",))


def add_payments(kept: Snapshot, payments: DataFrame, version: int | None = None) -> None:
    """Fold new payments in; a ``version`` that is already in is not added again."""
    kept.merge(payment_partials(payments), add_up, version)
