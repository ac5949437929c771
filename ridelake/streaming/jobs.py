"""Structured Streaming jobs that keep derived ride state up to date (survey SRC4, ST1-ST8).

Aggregates that Spark maintains itself (latest position, demand windows, promo usage) use its state
store in update mode. Rules that need a key's rows in order keep a few numbers per key in the same store (``state``).
Between micro-batches the order of arrival counts, as it does for a row trigger; within one it is the
order of (time, id).
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ridelake.functions.money import rating2
from ridelake.operators import events, summaries
from ridelake.operators.common import Tables
from ridelake.plans.keyed import top_per_key
from ridelake.plans.session import cut
from ridelake.schema import DEMAND_THRESHOLD
from ridelake.sources.ingest import judge_pings, judge_pings_as_of
from ridelake.sources.snapshots import Snapshot
from ridelake.streaming.batches import read_batches, run_batches, write_batch
from ridelake.streaming.bulk import BulkSteps, BulkSum, BulkTotals, in_bulk
from ridelake.streaming.state import RunningTotals, StatusSteps, keyed

RETIRE = "30 days"  # how long a finished ride or payment stays in the state after its last row
RIDE_DONE, PAYMENT_DONE = ("completed", "cancelled"), ("paid", "refunded", "failed")


def read_feed(spark: SparkSession, path: str, schema: str, max_files: int | None = None) -> DataFrame:
    """A growing parquet folder as a stream."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def ingest_pings(stream: DataFrame, drivers: DataFrame, out: str, **run) -> StreamingQuery:
    """Append good pings to ``out/pings`` and the others, with a reason, to ``out/rejected``."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        judged = judge_pings(batch, drivers)
        write_batch(judged.where("reject_reason IS NULL").drop("reject_reason"), f"{out}/pings", batch_id)
        write_batch(judged.where("reject_reason IS NOT NULL"), f"{out}/rejected", batch_id)

    return run_batches(stream, handle, f"{out}/checkpoint", **run)


def ingest_pings_as_of(stream: DataFrame, versions: str, schema: str, out: str, **run) -> StreamingQuery:
    """As ``ingest_pings``, with a driver table that changes beside the stream.

    ``versions`` is the folder of the drivers' changes (``schema``: driver_id, active, valid_from), read anew for every micro-batch, so a
    driver registered after the start is known. A ping is judged by the version of its own time, late or not.
    """
    spark = stream.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        judged = judge_pings_as_of(batch, spark.read.schema(schema).parquet(versions))
        write_batch(judged.where("reject_reason IS NULL").drop("reject_reason"), f"{out}/pings", batch_id)
        write_batch(judged.where("reject_reason IS NOT NULL"), f"{out}/rejected", batch_id)

    return run_batches(stream, handle, f"{out}/checkpoint", **run)


LOCATION = "location_id BIGINT, driver_id BIGINT, latitude DECIMAL(10,7), longitude DECIMAL(10,7), timestamp TIMESTAMP_NTZ"


def location_snapshot(spark: SparkSession, out: str) -> Snapshot:
    return Snapshot(spark, f"{out}/snapshot", LOCATION, ("driver_id",))


def newest_per_driver(pings: DataFrame) -> DataFrame:
    return top_per_key(pings, ["driver_id"], [F.desc("timestamp"), F.desc("location_id"), F.desc("latitude"), F.desc("longitude")])


def stream_latest_location(stream: DataFrame, out: str, **run) -> StreamingQuery:
    """Newest ping per driver, kept as a snapshot; a late older ping changes nothing."""
    at = F.struct("timestamp", "location_id")
    latest = stream.groupBy("driver_id").agg(
        F.max_by(F.struct("location_id", "latitude", "longitude", "timestamp"), at).alias("ping")
    ).select("driver_id", "ping.*")
    kept = location_snapshot(stream.sparkSession, out)
    return run_batches(
        latest, lambda batch, n: kept.merge(batch, newest_per_driver, n), f"{out}/checkpoint", output_mode="update", reuse=False, **run
    )


def latest_locations(spark: SparkSession, out: str) -> DataFrame:
    return location_snapshot(spark, out).read()


def stream_positions(history: DataFrame, pings: DataFrame, t: Tables, out: str, retire: str = RETIRE, **run) -> StreamingQuery:
    """Newest position per driver from pings and from the drop-offs of rides as they are completed.

    The status of each ride, which is state, gives the drop-offs; they join the pings, and the newest of a micro-batch
    goes into the snapshot if it is newer than what that has. Either stream may lag behind the other.
    """
    changed = many_status_changes(history, "ride_id", "history_id", RIDE_DONE, retire)
    columns = ("location_id", "driver_id", "latitude", "longitude", "timestamp")
    placed = events.dropoffs(changed.where("status = 'completed'"), t).select(*columns)
    kept = location_snapshot(history.sparkSession, out)
    return run_batches(
        placed.unionByName(pings.select(*columns)), lambda batch, n: kept.merge(newest_per_driver(batch), newest_per_driver, n),
        f"{out}/checkpoint", reuse=False, idle_batches=False, **run,
    )


def rated_in_order(stream: DataFrame, many: bool = False) -> DataFrame:
    """Each rating with the two-place mean of its user's ratings so far; a user's sums are in the state, by the bucket for ``many`` users."""
    rows, order = stream.select("rating_id", "rated_user_id", "score", "timestamp"), ["timestamp", "rating_id"]
    if many:
        summed = in_bulk(rows, BulkTotals("rated_user_id", "score", order), "total long, n long")
    else:
        summed = keyed(
            rows, "rated_user_id", RunningTotals("score", order),
            "rating_id long, rated_user_id long, score int, timestamp timestamp_ntz, total long, n long",
        )
    return summed.select("rating_id", "rated_user_id", "timestamp", "n", rating2(F.col("total"), F.col("n")).alias("average"))


def stream_rating_alerts(stream: DataFrame, drivers: DataFrame, out: str, many: bool = False, **run) -> StreamingQuery:
    """A notification for every rating that leaves a driver's mean below 3.5, and the users it suspends."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        alerts = cut(events.rating_alerts(batch, drivers))
        write_batch(alerts, f"{out}/rows", batch_id)
        write_batch(events.suspensions(alerts, "ref_user_id", "created_at"), f"{out}/suspended", batch_id)

    return run_batches(rated_in_order(stream, many), handle, f"{out}/checkpoint", **run)


def stream_rider_flags(stream: DataFrame, drivers: DataFrame, out: str, many: bool = False, **run) -> StreamingQuery:
    """Ratings that leave a rider's mean below 3.0, and the users they suspend."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        flags = cut(events.rider_flags(batch, drivers))
        write_batch(flags, f"{out}/rows", batch_id)
        write_batch(events.suspensions(flags, "rated_user_id", "timestamp"), f"{out}/suspended", batch_id)

    return run_batches(rated_in_order(stream, many), handle, f"{out}/checkpoint", **run)


def users_after_suspensions(users: DataFrame, out: str) -> DataFrame:
    """Users snapshot with the active accounts that a rating stream suspended."""
    return events.suspend(users, read_batches(users.sparkSession, f"{out}/suspended"), "user_id")


def stream_demand_surge(
    stream: DataFrame, t: Tables, out: str, threshold: int = DEMAND_THRESHOLD, width: str = "1 hour",
    lateness: str = "1 hour", **run,
) -> StreamingQuery:
    """Requests per window and pickup city; windows close ``lateness`` after the newest event."""
    requests = stream.where("status = 'requested'").withColumn("event_time", F.col("timestamp").cast("timestamp"))
    placed = events.with_pickup_city(requests.withWatermark("event_time", lateness), t)
    windows = events.demand_windows(placed, threshold, width)

    kept = demand_snapshot(stream.sparkSession, out)
    return run_batches(
        windows, lambda batch, n: kept.merge(batch, largest_count, n), f"{out}/checkpoint", output_mode="update", reuse=False, **run
    )


def demand_snapshot(spark: SparkSession, out: str) -> Snapshot:
    schema = "window_start TIMESTAMP_NTZ, city STRING, requests BIGINT, high_demand BOOLEAN"
    return Snapshot(spark, f"{out}/snapshot", schema, ("window_start", "city"))


def largest_count(updates: DataFrame) -> DataFrame:
    """Counts only grow, so the largest update is the last."""
    return updates.groupBy("window_start", "city").agg(
        F.max("requests").alias("requests"), F.max("high_demand").alias("high_demand")
    )


def demand_surges(spark: SparkSession, out: str) -> DataFrame:
    """Present count per window."""
    return demand_snapshot(spark, out).read()


def stream_payment_completes_ride(
    stream: DataFrame, out: str, retire: str = RETIRE, **run
) -> StreamingQuery:
    """Changes of payments to paid; fold them into rides with ``rides_after_payments``."""
    steps = many_status_changes(stream, "payment_id", "change_id", PAYMENT_DONE, retire, "ride_id")
    paid = events.only_paid(steps)
    return run_batches(
        paid, lambda batch, n: write_batch(batch, f"{out}/rows", n), f"{out}/checkpoint", reuse=False, idle_batches=False, **run
    )


def stream_promo_usage(stream: DataFrame, out: str, **run) -> StreamingQuery:
    """Payments per promo, whatever their status."""
    used = stream.where("promo_id IS NOT NULL").groupBy("promo_id").agg(F.count(F.lit(1)).alias("used"))

    kept = usage_snapshot(stream.sparkSession, out)
    return run_batches(
        used, lambda batch, n: kept.merge(batch, largest_use, n), f"{out}/checkpoint", output_mode="update", reuse=False, **run
    )


def usage_snapshot(spark: SparkSession, out: str) -> Snapshot:
    return Snapshot(spark, f"{out}/snapshot", "promo_id BIGINT, used BIGINT", ("promo_id",))


def largest_use(updates: DataFrame) -> DataFrame:
    return updates.groupBy("promo_id").agg(F.max("used").alias("used"))


def promos_after_usage(promos: DataFrame, out: str) -> DataFrame:
    """Promo snapshot with the streamed usage added."""
    return add_usage(promos, usage_snapshot(promos.sparkSession, out).read())


def stream_payment_days(stream: DataFrame, out: str, **run) -> StreamingQuery:
    """Daily payment sums; a micro-batch reads the new payments and the buckets of their days."""
    kept = summaries.kept_days(stream.sparkSession, f"{out}/days")
    return run_batches(
        stream, lambda batch, n: summaries.add_payments(kept, batch, n), f"{out}/checkpoint", reuse=False, **run
    )


def payment_days(spark: SparkSession, out: str) -> DataFrame:
    return summaries.kept_days(spark, f"{out}/days").read()


def add_usage(promos: DataFrame, used: DataFrame) -> DataFrame:
    total = (F.col("usage_count") + F.coalesce("used", F.lit(0))).cast("int").alias("usage_count")
    return promos.join(used, "promo_id", "left").select(
        *[total if c == "usage_count" else F.col(c) for c in promos.columns]
    )


def status_changes(
    stream: DataFrame, key: str, event: str, done: Sequence[str], retire: str = RETIRE, *carry: str, keep_all: bool = False,
) -> DataFrame:
    """Rows that change the status of their key, with the one before; the last status of a key is in the state.

    ``retire`` is how long a key whose status is among ``done`` stays there after its last row.
    """
    wait = int(pd.Timedelta(retire).total_seconds() * 1000)
    columns = [event, key, *carry]
    schema = ", ".join(f"{c} {stream.schema[c].dataType.simpleString()}" for c in columns)
    return keyed(
        stream.select(*columns, "status", "timestamp"), key, StatusSteps(["timestamp", event], done, wait, keep_all),
        f"{schema}, status string, timestamp timestamp_ntz, previous_status string", timers=True,
    )


def many_status_changes(
    stream: DataFrame, key: str, event: str, done: Sequence[str], retire: str = RETIRE, *carry: str, keep_all: bool = False,
) -> DataFrame:
    """``status_changes`` for very many keys, whose statuses are kept by the bucket."""
    wait = int(pd.Timedelta(retire).total_seconds() * 1000)
    rows = stream.select(event, key, *carry, "status", "timestamp")
    return in_bulk(rows, BulkSteps(key, ["timestamp", event], done, wait, keep_all), "previous_status string", timers=True)


def stream_ride_effects(stream: DataFrame, t: Tables, out: str, retire: str = RETIRE, many: bool = False, **run) -> StreamingQuery:
    """History rows, freed drivers and drop-off pings from ride status changes; for ``many`` rides their statuses are kept by the bucket."""
    changed = (many_status_changes if many else status_changes)(stream, "ride_id", "history_id", RIDE_DONE, retire)

    def handle(batch: DataFrame, batch_id: int) -> None:
        for name, rows in events.ride_effects(batch, t).items():
            write_batch(rows, f"{out}/{name}", batch_id)

    return run_batches(changed, handle, f"{out}/checkpoint", idle_batches=False, **run)


def stream_double_booking_guard(stream: DataFrame, out: str, retire: str = RETIRE, **run) -> StreamingQuery:
    """Decision per asked-for ride, from the open rides of its driver at that moment.

    Two stateful operators in one query: the status of each ride gives steps, the steps of each driver a running sum.
    """
    updates = many_status_changes(
        stream.where("kind = 'update'"), "ride_id", "event_id", RIDE_DONE, retire, "driver_id", "kind", keep_all=True
    )
    columns = ("event_id", "driver_id", "timestamp", "kind", "step")
    asked = stream.where("kind = 'insert'").withColumn("step", F.lit(0).cast("long"))
    moved = updates.withColumn("step", events.open_step().cast("long"))
    steps = moved.select(*columns).unionByName(asked.select(*columns))
    summed = in_bulk(steps, BulkSum("driver_id", "open", ["timestamp", "event_id"]), "open long")
    return run_batches(
        events.guarded(summed), lambda batch, n: write_batch(batch, f"{out}/decisions", n), f"{out}/checkpoint",
        reuse=False, idle_batches=False, **run,
    )
