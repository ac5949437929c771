"""Streams over several files, restarts and replays against their batch forms."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ridelake.operators import events, ranked
from ridelake.registry import DEMAND_LIMIT, all_queries
from ridelake.sources.feeds import feed
from ridelake.streaming import jobs
from ridelake.streaming.batches import read_batches, write_batch


def _slices(df, column, n):
    """``n`` consecutive time slices of about equal row counts."""
    bounds = df.agg(F.percentile_approx(F.unix_micros(F.col(column).cast("timestamp")), [i / n for i in range(1, n)])).first()[0]
    at = F.unix_micros(F.col(column).cast("timestamp"))
    edges = [None, *bounds, None]
    for low, high in zip(edges, edges[1:]):
        part = df
        if low is not None:
            part = part.where(at > low)
        if high is not None:
            part = part.where(at <= high)
        yield part


def _run(spark, df, column, folder, start, n=4, per_run=2):
    """Write one file per slice; every ``per_run`` slices the stream is stopped and started anew."""
    parts = list(_slices(df, column, n))
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if (i + 1) % per_run == 0 or i + 1 == len(parts):
            stream = jobs.read_feed(spark, f"{folder}/in", df.schema, max_files=1)
            start(stream, f"{folder}/out").awaitTermination()
    return f"{folder}/out"


def test_latest_location(spark, tables, folder):
    out = _run(spark, tables["driver_location"], "timestamp", folder, jobs.stream_latest_location)
    assert rows(jobs.latest_locations(spark, out)) == rows(ranked.latest_driver_location(tables))


def test_late_older_ping_changes_nothing(spark, tables, folder):
    pings = tables["driver_location"]
    newest_first = [pings.where("timestamp >= '2024-01-20'"), pings.where("timestamp < '2024-01-20'")]
    for part in newest_first:
        part.write.mode("append").parquet(f"{folder}/in")
        jobs.stream_latest_location(jobs.read_feed(spark, f"{folder}/in", pings.schema), f"{folder}/out").awaitTermination()
    assert rows(jobs.latest_locations(spark, f"{folder}/out")) == rows(ranked.latest_driver_location(tables))


@pytest.mark.parametrize("job, rule", [
    (jobs.stream_rating_alerts, events.rating_alerts), (jobs.stream_rider_flags, events.rider_flags),
])
def test_rating_rules(spark, tables, folder, job, rule):
    out = _run(spark, tables["ratings"], "timestamp", folder, lambda s, o: job(s, tables["driver"], o))
    want = rule(events.running_ratings(tables["ratings"]), tables["driver"])
    assert rows(read_batches(spark, f"{out}/rows"), *want.columns) == rows(want)


def test_demand(spark, tables, folder):
    requests = tables["ride_history"].where("status = 'requested'").withColumn("event_time", F.col("timestamp").cast("timestamp"))
    want = events.demand_windows(events.with_pickup_city(requests, tables), DEMAND_LIMIT, "6 hours")
    out = _run(
        spark, tables["ride_history"], "timestamp", folder,
        lambda s, o: jobs.stream_demand_surge(s, tables, o, DEMAND_LIMIT, "6 hours", "6 hours"),
    )
    assert rows(jobs.demand_surges(spark, out), *want.columns) == rows(want)


def test_sliding_demand_windows(tables):
    requests = tables["ride_history"].where("status = 'requested'").withColumn("event_time", F.col("timestamp").cast("timestamp"))
    placed = events.with_pickup_city(requests, tables)
    sliding = events.demand_windows(placed, DEMAND_LIMIT, "2 hours", "1 hour")
    assert sliding.agg(F.sum("requests")).first()[0] == 2 * placed.count()


def test_payment_transitions(spark, tables, folder):
    changes = feed(tables, "payment_changes")
    out = _run(spark, changes, "timestamp", folder, jobs.stream_payment_completes_ride)
    want = events.paid_transitions(changes)
    assert want.count() > 0
    assert rows(read_batches(spark, f"{out}/rows"), *want.columns) == rows(want)


def test_promo_usage(spark, tables, folder):
    out = _run(spark, tables["payments"], "transaction_date", folder, jobs.stream_promo_usage)
    used = tables["payments"].where("promo_id IS NOT NULL").groupBy("promo_id").agg(F.count(F.lit(1)).alias("used"))
    want = jobs.add_usage(tables["promo_code"], used)
    assert rows(jobs.promos_after_usage(tables["promo_code"], out)) == rows(want)


def test_ride_effects(spark, tables, folder):
    out = _run(
        spark, tables["ride_history"], "timestamp", folder, lambda s, o: jobs.stream_ride_effects(s, tables, o)
    )
    want = events.ride_effects(events.status_steps(tables["ride_history"], "ride_id", "history_id"), tables)
    for name, frame in want.items():
        assert frame.count() > 0
        assert rows(read_batches(spark, f"{out}/{name}"), *frame.columns) == rows(frame)


def test_double_booking(spark, tables, folder):
    bookings = feed(tables, "booking_feed")
    out = _run(spark, bookings, "timestamp", folder, jobs.stream_double_booking_guard)
    want = events.double_booking_guard(events.open_steps(bookings))
    assert {r.reject_reason for r in want.collect()} == {None, "driver_on_active_ride"}
    assert rows(read_batches(spark, f"{out}/decisions"), *want.columns) == rows(want)


def test_pings_are_split(spark, tables, folder):
    pings = feed(tables, "ping_requests")
    out = _run(spark, pings, "timestamp", folder, lambda s, o: jobs.ingest_pings(s, tables["driver"], o))
    good, bad = read_batches(spark, f"{out}/pings"), read_batches(spark, f"{out}/rejected")
    assert good.count() + bad.count() == pings.count()
    assert {r.reject_reason for r in bad.collect()} == {"missing_coordinates", "unknown_driver"}


def test_replayed_batch_is_not_counted_twice(spark, folder):
    df = spark.createDataFrame([(1, 5)], "promo_id long, used long")
    kept = jobs.usage_snapshot(spark, folder)
    for _ in range(2):
        write_batch(df, f"{folder}/rows", 0)
        kept.merge(df, lambda rows: rows.groupBy("promo_id").agg(F.sum("used").alias("used")), 0)
    assert rows(kept.read()) == [(1, 5)]
    assert read_batches(spark, f"{folder}/rows").count() == 1


def _held(spark, out, name):
    """What a query's first stateful operator holds."""
    state = spark.read.format("statestore").option("path", f"{out}/checkpoint").option("stateVarName", name).load()
    return state.select("key.*", "value.*")


def test_ratings_leave_two_numbers_per_user(spark, tables, folder):
    out = _run(spark, tables["ratings"], "timestamp", folder, lambda s, o: jobs.stream_rating_alerts(s, tables["driver"], o), n=2)
    want = tables["ratings"].groupBy("rated_user_id").agg(F.sum("score").alias("total"), F.count(F.lit(1)).alias("n"))
    assert rows(_held(spark, out, "totals")) == rows(want)


def test_finished_rides_leave_the_state_by_timer(spark, tables, folder):
    history = tables["ride_history"]
    def feed_in(*statuses):
        made = [(i, ride, status, dt.datetime(2024, 1, 1, 0, i)) for i, (ride, status) in enumerate(statuses)]
        spark.createDataFrame(made, history.schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = jobs.read_feed(spark, f"{folder}/in", history.schema)
        jobs.stream_ride_effects(stream, tables, f"{folder}/out", retire="1 second").awaitTermination()
        return {r[0]: r[1] for r in _held(spark, f"{folder}/out", "last").select("ride_id", "status").collect()}

    assert feed_in((1, "accepted"), (1, "completed"), (2, "accepted")) == {1: "completed", 2: "accepted"}
    assert feed_in((3, "requested")) == {2: "accepted", 3: "requested"}
    assert feed_in((2, "in_progress"), (1, "cancelled")) == {1: "cancelled", 2: "in_progress", 3: "requested"}
    steps = read_batches(spark, f"{folder}/out/history")
    assert rows(steps, "ride_id", "status") == [(1, "completed"), (2, "in_progress")]  # ride 1 began anew


def test_suspended_users(spark, tables, folder):
    out = _run(spark, tables["ratings"], "timestamp", folder, lambda s, o: jobs.stream_rider_flags(s, tables["driver"], o), n=2)
    flags = events.rider_flags(events.running_ratings(tables["ratings"]), tables["driver"])
    want = events.suspend(tables["users"], flags, "rated_user_id")
    got = jobs.users_after_suspensions(tables["users"], out)
    assert rows(got) == rows(want) and want.where("account_status = 'suspended'").count() > tables["users"].where(
        "account_status = 'suspended'"
    ).count()


def test_positions_follow_pings_and_dropoffs(spark, tables, folder):
    pings = tables["driver_location"]
    pieces = list(_slices(pings, "timestamp", 3))
    pieces = [pieces[2], pieces[0], pieces[1]]  # the newest pings come first
    pieces[0].coalesce(1).write.parquet(f"{folder}/pings")

    def start(history, out):
        if len(pieces) > 1:
            pieces.pop().coalesce(1).write.mode("append").parquet(f"{folder}/pings")
        return jobs.stream_positions(history, jobs.read_feed(spark, f"{folder}/pings", pings.schema), tables, out)

    out = _run(spark, tables["ride_history"], "timestamp", folder, start, n=2, per_run=1)
    want = events.positions(tables, events.status_steps(tables["ride_history"], "ride_id", "history_id"))
    assert rows(jobs.latest_locations(spark, out), *want.columns) == rows(want)
    assert rows(want) != rows(ranked.latest_driver_location(tables), *want.columns)


def test_a_driver_registered_while_the_stream_runs(spark, folder):
    schema = "driver_id long, active boolean, valid_from timestamp_ntz"
    at = lambda minute: dt.datetime(2024, 1, 1, 0, minute)

    def version(*made):
        spark.createDataFrame(list(made), schema).write.mode("append").parquet(f"{folder}/versions")

    def ping(*made):
        frame = spark.createDataFrame([(i, d, 24.0, 67.0, t) for i, d, t in made], "location_id long, driver_id long, latitude double, longitude double, timestamp timestamp_ntz")
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        return frame.schema

    version((1, True, at(0)))
    form = ping((1, 1, at(5)), (2, 2, at(5)))
    query = jobs.ingest_pings_as_of(
        jobs.read_feed(spark, f"{folder}/in", form), f"{folder}/versions", schema, f"{folder}/out", available_now=False, interval="0 seconds"
    )
    try:
        query.processAllAvailable()
        version((2, True, at(10)), (1, False, at(20)), (1, True, at(20)), (2, False, at(30)))
        ping((3, 2, at(9)), (4, 2, at(10)), (5, 1, at(25)), (6, 2, at(31)), (7, 2, None), (8, None, at(12)), (8, 2, at(29)))
        query.processAllAvailable()
    finally:
        query.stop()
    assert rows(read_batches(spark, f"{folder}/out/pings"), "location_id") == [(1,), (4,), (5,), (8,)]
    assert rows(read_batches(spark, f"{folder}/out/rejected"), "location_id", "reject_reason") == [
        (2, "unknown_driver"), (3, "unknown_driver"), (6, "inactive_driver"), (7, "unknown_driver"), (8, "unknown_driver")
    ]


def test_very_many_keys_share_calls_and_keep_the_rules(spark, folder):
    """Null keys, statuses and times, equal places, far times: as the call per key has it, from a state by the bucket."""
    at = lambda year, *more: dt.datetime(year, 1, 1, *more)
    made = [
        [(1, 7, "accepted", at(2024)), (2, 7, "completed", at(2024)), (3, None, "accepted", at(2024, 1)), (None, 8, "accepted", at(1, 1)),
         (4, 8, None, at(9999, 12, 31, 5)), (5, 9, "accepted", None), (6, 2**60 + 1, "accepted", dt.datetime(1960, 2, 3, 4, 5, 6, 789123))],
        [(8, None, "completed", at(2024)), (9, 8, "completed", at(2025)), (10, 9, "accepted", at(2026)), (11, 9, "cancelled", at(2026)),
         (12, 2**60 + 1, "cancelled", dt.datetime(9999, 12, 31, 23, 59, 59, 999999)), (13, 2**60, "completed", at(2024)), (14, 7, "accepted", None)],
    ]
    schema = "history_id long, ride_id long, status string, timestamp timestamp_ntz"
    got = {}
    for name, job in (("keys", jobs.status_changes), ("bulk", jobs.many_status_changes)):
        for keep_all in (False, True):
            out = f"{folder}/{name}{keep_all}"
            for part in made:
                spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{out}/in")
                stream = jobs.read_feed(spark, f"{out}/in", schema)
                changed = job(stream, "ride_id", "history_id", jobs.RIDE_DONE, keep_all=keep_all)
                jobs.run_batches(
                    changed, lambda batch, n, o=out: write_batch(batch, f"{o}/rows", n), f"{out}/checkpoint", reuse=False, idle_batches=False
                ).awaitTermination()
            got[name, keep_all] = rows(read_batches(spark, f"{out}/rows"), "history_id", "ride_id", "status", "timestamp", "previous_status")
    assert got["bulk", True] == got["keys", True] and len(got["bulk", True]) == 14
    assert got["bulk", False] == got["keys", False] and len(got["bulk", False]) == 5
    assert _held(spark, f"{folder}/bulkTrue", "bucket").count() <= 6  # buckets, and those without a ride


def test_finished_payments_leave_a_bucket_by_timer(spark, folder):
    schema = "change_id long, payment_id long, ride_id long, status string, timestamp timestamp_ntz"
    def feed_in(*made):
        made = [(i, payment, 1, status, dt.datetime(2024, 1, 1, 0, i)) for i, payment, status in made]
        spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = jobs.read_feed(spark, f"{folder}/in", schema)
        jobs.stream_payment_completes_ride(stream, f"{folder}/out", retire="1 second").awaitTermination()
        return _held(spark, f"{folder}/out", "bucket").count()

    assert feed_in((1, 1, "failed"), (2, 2, "pending")) == 2
    assert feed_in((3, 3, "pending")) == 2  # payment 1 is gone, 2 and 3 are not
    assert feed_in((4, 1, "paid"), (5, 2, "paid"), (6, 3, "paid")) == 3
    assert rows(read_batches(spark, f"{folder}/out/rows"), "payment_id") == [(2,), (3,)]  # payment 1 began anew


@pytest.mark.parametrize("job, rule", [
    (jobs.stream_rating_alerts, events.rating_alerts), (jobs.stream_rider_flags, events.rider_flags),
])
def test_rating_rules_with_users_by_the_bucket(spark, tables, folder, job, rule):
    out = _run(spark, tables["ratings"], "timestamp", folder, lambda s, o: job(s, tables["driver"], o, many=True), n=3, per_run=2)
    want = rule(events.running_ratings(tables["ratings"]), tables["driver"])
    assert rows(read_batches(spark, f"{out}/rows"), *want.columns) == rows(want)
    held = _held(spark, out, "bucket").select("bucket")
    assert held.count() == held.distinct().count()


def test_ride_effects_with_rides_by_the_bucket(spark, tables, folder):
    out = _run(
        spark, tables["ride_history"], "timestamp", folder, lambda s, o: jobs.stream_ride_effects(s, tables, o, many=True), n=3, per_run=2
    )
    want = events.ride_effects(events.status_steps(tables["ride_history"], "ride_id", "history_id"), tables)
    for name, frame in want.items():
        assert frame.count() > 0
        assert rows(read_batches(spark, f"{out}/{name}"), *frame.columns) == rows(frame)
    assert _held(spark, out, "bucket").count() > 0


def test_running_totals_by_the_bucket_keep_the_rules(spark, folder):
    """Null users, scores and times, equal places, rows that come twice: as the call per user has it."""
    at = lambda year, *more: dt.datetime(year, 1, 1, *more)
    made = [
        [(1, 7, 5, at(2024)), (2, 7, None, at(2024)), (2, 7, None, at(2024)), (3, None, 4, at(2024, 1)), (None, 8, 1, at(1, 1)), (4, 0, 2, None),
         (5, 2**60 + 1, -3, dt.datetime(1960, 2, 3, 4, 5, 6, 789123)), (6, 2**60, 9, at(2024))],
        [(7, 7, 1, at(2023)), (8, None, 2, None), (9, 8, 3, at(9999, 12, 31, 5)), (10, 0, 0, at(2024)), (11, 2**60, 9, at(2025)),
         (12, 9, 4, at(2024)), (13, 9, 5, at(2023)), (14, 2**60 + 1, 3, at(2024))],
    ]
    schema = "rating_id long, rated_user_id long, score int, timestamp timestamp_ntz"
    got = {}
    for many in (False, True):
        out = f"{folder}/{many}"
        for part in made:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{out}/in")
            summed = jobs.rated_in_order(jobs.read_feed(spark, f"{out}/in", schema), many)
            jobs.run_batches(summed, lambda batch, n, o=out: write_batch(batch, f"{o}/rows", n), f"{out}/checkpoint", reuse=False).awaitTermination()
        got[many] = rows(read_batches(spark, f"{out}/rows"), "rating_id", "rated_user_id", "timestamp", "n", "average")
    assert got[True] == got[False] and len(got[True]) == 16
    # Users 0, 7, 8, 9, 2**60 and 2**60 + 1 have at most a bucket each, ratings without a user their own.
    assert _held(spark, f"{folder}/True", "bucket").count() <= 7


@pytest.mark.parametrize("name", [
    "stream_rating_alerts", "stream_rider_flags", "stream_users_after_rating_alerts", "stream_users_after_rider_flags",
    "stream_ride_effects_history", "stream_ride_effects_freed", "stream_ride_effects_pings",
])
def test_queries_call_python_by_the_bucket(tables, monkeypatch, name):
    class Begun(Exception):
        pass

    def by_key(*_args, **_kwargs):
        raise AssertionError("a call per key")

    def begun(*_args, **_kwargs):
        raise Begun

    monkeypatch.setattr(jobs, "keyed", by_key)
    monkeypatch.setattr(jobs, "run_batches", begun)
    with pytest.raises(Begun):
        all_queries()[name].run(tables)
