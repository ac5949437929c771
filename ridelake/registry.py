"""The registered queries: survey id, operator bound to fixed parameters, and checking SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelake.operators import (
    aggregates, audit, changes, events, lifecycle, lists, matching, pricing, ranked, wide,
)
from ridelake.operators.common import Tables
from ridelake.oracle.jobs_sql import JOBS_SQL
from ridelake.oracle.pricing_sql import PRICING_SQL
from ridelake.oracle.reports_sql import REPORTS_SQL
from ridelake.oracle.streams_sql import STREAMS_SQL
from ridelake.oracle.tables_sql import with_ride_tables
from ridelake.plans.session import cut, scratch_path, stored
from ridelake.sources import ingest
from ridelake.sources.feeds import FEEDS, feed
from ridelake.sources.legacy import upgrade_legacy_schema
from ridelake.sources.snapshots import Snapshot
from ridelake.sources.tables import table_profile, write_report
from ridelake.streaming import jobs
from ridelake.streaming.batches import read_batches

AS_OF = "1998-08-02 00:00:00"
PAYOUT_AS_OF = "2001-11-01 00:00:00"
RANGE = {"start": "1997-01-01", "end": "1998-06-30"}


@dataclass(frozen=True)
class Query:
    survey_id: str
    run: Callable[[Tables], DataFrame]
    sql: str | None = None


def _reports() -> dict[str, tuple[str, Callable[[Tables], DataFrame]]]:
    def second_page(t):
        """The page behind the last row of the first one."""
        last = wide.all_rides_page(t, limit=50).collect()[-1:]
        return wide.all_rides_page(t, limit=50, after=(last[0].request_time, last[0].ride_id) if last else None)

    return {
        "users_list": ("FL1", lists.users_list),
        "suspended_drivers_list": ("FL1", lambda t: lists.users_list(t, "driver", "suspended")),
        "pending_drivers": ("FL2", lists.pending_drivers),
        "flagged_drivers": ("FL3", lists.flagged_drivers),
        "promo_list": ("FL4", lists.promo_list),
        "valid_promos": ("FL5", lambda t: lists.valid_promos(t, AS_OF[:10])),
        "valid_promos_with_uses_left": (
            "FL5",
            lambda t: lists.valid_promos(
                t, AS_OF[:10], enforce_max_uses=True,
                codes=t["rides"].select(F.concat(F.lit(" Promo"), "ride_id").alias("code")),
            ),
        ),
        "fare_rules": ("FL6", lists.fare_rules),
        "pending_rides": ("FL7", lists.pending_rides),
        "complaints_list": ("FL8", lists.complaints_list),
        "open_complaints_list": ("FL8", lambda t: lists.complaints_list(t, "open")),
        "drivers_in_city": ("FL9", lambda t: lists.drivers_in_city(t, " Nation_3")),
        "driver_profiles": ("FL10", lists.driver_profiles),
        "rider_profiles": ("FL11", lists.rider_profiles),
        "vehicles_by_driver": ("FL12", lists.vehicles_by_driver),
        "driver_profile_complete": ("FL13", lists.driver_profile_complete),
        "payout_history": ("FL14", lists.payout_history),
        "active_rides": ("JN1", wide.active_rides),
        "ride_summary": ("JN2", wide.ride_summary),
        "full_trip_report": ("JN3", wide.full_trip_report),
        "full_trip_report_admin": (
            "JN3", lambda t: wide.full_trip_report(t, status="completed", with_cities=True)
        ),
        "ride_detail": ("JN4", wide.ride_detail),
        "all_rides_page": ("JN5, WN6", lambda t: wide.all_rides_page(t, limit=50, offset=50)),
        "all_rides_page_by_key": ("JN5, WN6", second_page),
        "completed_rides_by_rider": ("JN6", wide.completed_rides_by_rider),
        "rider_ride_history": ("JN7", wide.rider_ride_history),
        "driver_rides": ("JN8", wide.driver_rides),
        "rider_active_ride": ("JN9", wide.rider_active_ride),
        "driver_active_ride": ("JN10", wide.driver_active_ride),
        "payments_with_promo": ("JN11", wide.payments_with_promo),
        "payment_history": ("JN12", wide.payment_history),
        "promo_usage_report": ("JN13", wide.promo_usage_report),
        "ratings_given": ("JN14", wide.ratings_given),
        "driver_ratings": ("JN15", wide.driver_ratings),
        "complaints_with_pickup": ("JN16", wide.complaints_with_pickup),
        "notifications_feed": ("JN17, WN6", wide.notifications_feed),
        "top_drivers": ("JN18", wide.top_drivers),
        "flagged_accounts": ("JN19", wide.flagged_accounts),
        "driver_recent_payments": ("JN20", wide.driver_recent_payments),
        "platform_summary": ("AG1", aggregates.platform_summary),
        "platform_revenue": ("AG2", aggregates.platform_revenue),
        "revenue_report_range": ("AG3", lambda t: aggregates.revenue_report_range(t, **RANGE)),
        "revenue_report_last_30_days": (
            "AG3", lambda t: aggregates.revenue_report_range(t, as_of=AS_OF)
        ),
        "revenue_report_admin": ("AG4", lambda t: aggregates.revenue_report_admin(t, **RANGE)),
        "revenue_report_finance": ("AG5", lambda t: aggregates.revenue_report_finance(t, **RANGE)),
        "revenue_totals": ("AG6", lambda t: aggregates.revenue_totals(t, **RANGE)),
        "rides_report": ("AG7", lambda t: aggregates.rides_report(t, "1996-01-01", "1999-12-31")),
        "driver_earnings_admin": ("AG8", aggregates.driver_earnings_admin),
        "driver_earnings_finance": ("AG9", aggregates.driver_earnings_finance),
        "driver_earnings_summary": ("AG10", aggregates.driver_earnings_summary),
        "driver_fare_earnings": ("AG11", aggregates.driver_fare_earnings),
        "trips_per_driver": ("AG12", aggregates.trips_per_driver),
        "driver_performance": ("AG13", aggregates.driver_performance),
        "driver_performance_deduped": ("AG13", aggregates.driver_performance_deduped),
        "revenue_by_city": ("AG14", aggregates.revenue_by_city),
        "revenue_by_known_city": ("AG14", lambda t: aggregates.revenue_by_city(t, include_null=False)),
        "all_riders_report": ("AG15", aggregates.all_riders_report),
        "all_riders_report_admin": ("AG15", lambda t: aggregates.all_riders_report(t, with_wallet=True)),
        "low_rated_drivers": ("AG16", aggregates.low_rated_drivers),
        "low_rated_drivers_admin": ("AG17", aggregates.low_rated_drivers_admin),
        "rider_stats": ("AG18", aggregates.rider_stats),
        "refund_totals": ("AG19", aggregates.refund_totals),
        "refund_report": ("AG20", lambda t: aggregates.refund_report(t, **RANGE)),
        "dispute_totals": ("AG21", aggregates.dispute_totals),
        "avg_rating_by_driver": ("AG22", aggregates.avg_rating_by_driver),
        "refreshed_driver_ratings": ("AG22", aggregates.refreshed_driver_ratings),
        "payment_method_breakdown": ("WN1", ranked.payment_method_breakdown),
        "latest_driver_location": ("WN2", ranked.latest_driver_location),
        "first_verified_vehicle": ("WN3", ranked.first_verified_vehicle),
        "first_verified_premium_vehicle": (
            "WN3", lambda t: ranked.first_verified_vehicle(t, "Premium")
        ),
        "ride_status_timeline": ("WN4", ranked.ride_status_timeline),
        "driver_leaderboard": ("WN5", ranked.driver_leaderboard),
    }


def _pricing() -> dict[str, tuple[str, Callable[[Tables], DataFrame]]]:
    def estimates(t: Tables) -> DataFrame:
        return pricing.trip_estimate(feed(t, "trips"))

    def quote(t: Tables) -> DataFrame:
        pending = pricing.pending_requests(t)
        return pricing.fare_quote(estimates(t), t["fare_rules"], pending).select(
            "trip_id", "distance_km", "duration_min", "fare", "surge_multiplier", "surge_applied",
            "fallback", "base_fare", "distance_cost", "time_cost",
        )

    def default_fare(t: Tables) -> DataFrame:
        return pricing.fare_quote(estimates(t), t["fare_rules"]).select(
            "trip_id", pricing.booking_fare(F.col("vehicle_type")).alias("booking_fare"), "fare",
            "fallback",
        )

    def split(t: Tables) -> DataFrame:
        return pricing.commission_split(t["payments"].select("payment_id", "amount"))

    def promo(mode: str) -> Callable[[Tables], DataFrame]:
        return lambda t: pricing.apply_promo(feed(t, "promo_fares"), t["promo_code"], AS_OF[:10], mode)

    return {
        "trip_distances": ("GP1, GP2", lambda t: pricing.trip_distances(feed(t, "trips"))),
        "nearest_driver": ("GP3", lambda t: matching.nearest_driver(t, feed(t, "open_pickups"))),
        "drivers_within_radius": (
            "GP4", lambda t: matching.drivers_within_radius(t, feed(t, "open_pickups"))
        ),
        "closest_drivers": (
            "GP4", lambda t: matching.closest_drivers(t, feed(t, "open_pickups"), 5)
        ),
        "premium_drivers_within_10_km": (
            "GP4",
            lambda t: matching.drivers_within_radius(t, feed(t, "open_pickups"), 10, "Premium"),
        ),
        "trip_estimate": (
            "GP5", lambda t: estimates(t).select("trip_id", "distance_km", "duration_min")
        ),
        "fare_quote": ("GP6", quote),
        "fare_breakdown": ("GP7", lambda t: pricing.fare_breakdown(estimates(t), t["fare_rules"])),
        "peak_surge": (
            "GP8", lambda t: pricing.peak_surge(feed(t, "trips"), t["fare_rules"], "Asia/Karachi")
        ),
        "demand_surge": ("GP9", pricing.demand_snapshot),
        "demand_history": ("GP9", lambda t: pricing.demand_history(t, threshold=3)),
        "demand_at_trips": (
            "GP9", lambda t: pricing.demand_at(feed(t, "city_trips"), t, threshold=3)
        ),
        "default_fare": ("GP10", default_fare),
        "resolve_addresses": (
            "GP11", lambda t: pricing.resolve_addresses(feed(t, "addressed_trips"), t["location"])
        ),
        "apply_promo": ("GP12", promo("reject")),
        "apply_promo_or_ignore": ("GP12", promo("ignore")),
        "commission_split": ("GP13", split),
    }


def _jobs() -> dict[str, tuple[str, Callable[[Tables], DataFrame]]]:
    def arrived(t, name):
        """A feed that takes joins to derive, materialised as an arrived batch would be."""
        return cut(feed(t, name))

    def booking(t):
        return lifecycle.match_ride_requests(feed(t, "ride_requests"), t["vehicles"])

    def statuses(t):
        return lifecycle.apply_status_changes(
            feed(t, "status_changes"), t["rides"], t["driver"], t["vehicles"]
        )

    def actions(t):
        return lifecycle.accept_reject_cancel(feed(t, "ride_actions"), t["rides"], t["driver"])

    def settlement(t):
        return lifecycle.settle_payments(
            stored(feed(t, "payment_requests")), t["rides"], t["payments"], t["promo_code"], AS_OF[:10]
        )

    def completion(t):
        return lifecycle.complete_rides(
            t, feed(t, "ride_completions"), AS_OF[:10], pending=pricing.pending_requests(t)
        )

    def rating(t):
        return lifecycle.accept_ratings(arrived(t, "rating_requests"), t["rides"], t["ratings"])

    def accounts(t):
        return changes.change_account_status(t["users"], feed(t, "account_changes"))

    def refunds(t, whole=False):
        """The payments are derived once for the requests and the decisions; the snapshot takes their other columns too."""
        judged = cut(t["payments"].select("payment_id", "payment_status", "transaction_date"))
        asked = feed(t.replace(payments=judged), "refund_requests")
        return changes.process_refunds(t["payments"] if whole else judged, asked)

    def new_vehicles(t, completing=False):
        return ingest.ingest_vehicles(
            feed(t, "vehicle_requests"), t["driver"], t["vehicles"], completing
        )

    def registering(t):
        return ingest.ingest_registrations(feed(t, "registrations"), t["users"])

    def audit_events(t):
        paid = settlement(t)
        return lifecycle.parse_audit_events(
            t["ride_history"].unionByName(paid["history"]), t["payments"].unionByName(paid["payments"])
        )

    def legacy_users(t):
        old = t["users"].drop("wallet_balance", "city")
        return upgrade_legacy_schema(old, "users")

    def completed_profiles(t):
        return changes.change_drivers(t["driver"], new_vehicles(t, True)["driver_changes"])["snapshot"]

    def written_report(t):
        session = t["rides"].sparkSession
        path = scratch_path(session, "report")
        write_report(aggregates.platform_revenue(t), path, "parquet", partition_by="payment_method")
        return session.read.parquet(path)

    return {
        "table_profile": ("SRC1", table_profile),
        "written_report": ("SRC9", written_report),
        "legacy_users_upgraded": ("SRC3", legacy_users),
        "ping_decisions": ("SRC4", lambda t: ingest.judge_pings(feed(t, "ping_requests"), t["driver"])),
        "vehicle_request_decisions": ("SRC5", lambda t: new_vehicles(t)["decided"]),
        "new_vehicles": ("SRC5", lambda t: new_vehicles(t)["vehicles"]),
        "drivers_after_profile_completion": ("SRC5", completed_profiles),
        "first_pings": ("SRC5", lambda t: new_vehicles(t, True)["pings"]),
        "registration_decisions": ("SRC6", lambda t: registering(t)["decided"]),
        "registered_drivers": ("SRC6", lambda t: registering(t)["driver"]),
        "complaint_decisions": (
            "SRC7",
            lambda t: ingest.ingest_complaints(feed(t, "complaint_requests"), t["rides"])["decided"],
        ),
        "constraint_audit": ("SRC8", audit.constraint_audit),
        "ride_request_decisions": ("LC1", lambda t: booking(t)["decided"]),
        "guarded_request_decisions": (
            "LC1",
            lambda t: lifecycle.match_ride_requests(feed(t, "ride_requests"), t["vehicles"], t["rides"])["decided"],
        ),
        "booked_rides": ("LC1", lambda t: booking(t)["rides"]),
        "booked_locations": ("LC1", lambda t: booking(t)["locations"]),
        "status_change_decisions": ("LC2", lambda t: statuses(t)["decided"]),
        "rides_after_status_changes": ("LC2", lambda t: statuses(t)["rides"]),
        "drivers_after_status_changes": ("LC2", lambda t: statuses(t)["driver"]),
        "vehicles_after_status_changes": ("LC2", lambda t: statuses(t)["vehicles"]),
        "ride_action_decisions": ("LC3", lambda t: actions(t)["decided"]),
        "rides_after_actions": ("LC3", lambda t: actions(t)["rides"]),
        "drivers_after_actions": ("LC3", lambda t: actions(t)["driver"]),
        "payment_decisions": ("LC4", lambda t: settlement(t)["decided"]),
        "settled_payments": ("LC4", lambda t: settlement(t)["payments"]),
        "payment_audit_entries": ("LC4", lambda t: settlement(t)["history"]),
        "ride_completion_decisions": ("LC5", lambda t: completion(t)["decided"]),
        "rides_after_completion": ("LC5", lambda t: completion(t)["rides"]),
        "drivers_after_completion": ("LC5", lambda t: completion(t)["driver"]),
        "weekly_payouts": ("LC6", lambda t: lifecycle.weekly_payouts(t, PAYOUT_AS_OF)["decided"]),
        "rating_decisions": ("LC7", lambda t: rating(t)["decided"]),
        "accepted_ratings": ("LC7", lambda t: rating(t)["ratings"]),
        "driver_ratings_after": ("LC7", lambda t: lifecycle.ratings_after(t, rating(t)["ratings"])),
        "flagged_low_rated_drivers": ("LC8", lambda t: lifecycle.flag_low_rated_drivers(t)["flagged"]),
        "users_after_flagging": ("LC8", lambda t: lifecycle.flag_low_rated_drivers(t)["users"]),
        "drivers_flagged_count": ("LC8", lambda t: lifecycle.flag_low_rated_drivers(t)["count"]),
        "account_change_decisions": ("LC9", lambda t: accounts(t)["decided"]),
        "users_after_account_changes": ("LC9", lambda t: accounts(t)["snapshot"]),
        "users_after_profile_changes": (
            "LC9", lambda t: changes.change_profiles(t["users"], feed(t, "profile_changes"))["snapshot"]
        ),
        "drivers_after_changes": (
            "LC9", lambda t: changes.change_drivers(t["driver"], feed(t, "driver_changes"))["snapshot"]
        ),
        "vehicles_after_verification": (
            "LC9", lambda t: changes.verify_vehicles(t["vehicles"], feed(t, "vehicle_changes"))["snapshot"]
        ),
        "promos_after_changes": (
            "LC9", lambda t: changes.change_promos(t["promo_code"], feed(t, "promo_changes"))["snapshot"]
        ),
        "fare_rules_after_changes": (
            "LC9",
            lambda t: changes.change_fare_rules(t["fare_rules"], feed(t, "fare_rule_changes"))["snapshot"],
        ),
        "notifications_after_reads": (
            "LC9",
            lambda t: changes.mark_notifications_read(
                t["admin_notifications"], feed(t, "notification_reads")
            )["snapshot"],
        ),
        "complaints_after_changes": (
            "LC9",
            lambda t: changes.change_complaint_status(t["complaints"], feed(t, "complaint_changes"))["snapshot"],
        ),
        "refund_decisions": ("LC9", lambda t: refunds(t)["decided"]),
        "payments_after_refunds": ("LC9", lambda t: refunds(t, whole=True)["snapshot"]),
        "audit_events": ("LC10", audit_events),
    }


EVENTS_SPLIT = "2024-01-16"
PAYMENTS_SPLIT = "1998-06-01"
DEMAND_LIMIT = 3


def _replay(name: str, rows: DataFrame, time_column: str, split: str, start) -> str:
    """Stream ``rows`` in two runs of one job, those before ``split`` first; returns its folder."""
    spark = rows.sparkSession
    base = scratch_path(spark, name)
    moment = F.lit(split).cast("timestamp_ntz")
    for part in (rows.where(F.col(time_column) < moment), rows.where(F.col(time_column) >= moment)):
        part.write.mode("append").parquet(f"{base}/in")
        start(jobs.read_feed(spark, f"{base}/in", rows.schema), f"{base}/out").awaitTermination()
    return f"{base}/out"


def _streams() -> dict[str, tuple[str, Callable[[Tables], DataFrame]]]:
    def spark(t):
        return t["rides"].sparkSession

    def running(t):
        return events.running_ratings(t["ratings"])

    def steps(t):
        return events.status_steps(t["ride_history"], "ride_id", "history_id")

    def rated(t, name, job):
        out = _replay(
            name, t["ratings"], "timestamp", PAYMENTS_SPLIT, lambda s, o: job(s, t["driver"], o, many=True)
        )
        return read_batches(spark(t), f"{out}/rows")

    def windows(t):
        requests = t["ride_history"].where("status = 'requested'").withColumn(
            "event_time", F.col("timestamp").cast("timestamp")
        )
        return events.demand_windows(events.with_pickup_city(requests, t), DEMAND_LIMIT)

    def usage(t):
        used = t["payments"].where("promo_id IS NOT NULL").groupBy("promo_id").agg(
            F.count(F.lit(1)).alias("used")
        )
        return jobs.add_usage(t["promo_code"], used)

    def s_pings(part):
        def run(t):
            out = _replay(
                "pings", feed(t, "ping_requests"), "timestamp", EVENTS_SPLIT,
                lambda s, o: jobs.ingest_pings(s, t["driver"], o),
            )
            return read_batches(spark(t), f"{out}/{part}")
        return run

    def versions(t):
        return feed(t, "driver_versions").withColumn("valid_from", F.col("valid_from").cast("timestamp_ntz"))

    def s_as_of(t):
        """Versions from the split on are written only before the second run."""
        rows, changes = feed(t, "ping_requests"), versions(t)
        moment = F.lit(EVENTS_SPLIT).cast("timestamp_ntz")
        folder = scratch_path(spark(t), "driver-versions")
        parts = iter((changes.where(F.col("valid_from") < moment), changes.where(F.col("valid_from") >= moment)))

        def start(s, o):
            next(parts).write.mode("append").parquet(folder)
            return jobs.ingest_pings_as_of(s, folder, changes.schema, o)

        out = _replay("pings-as-of", rows, "timestamp", EVENTS_SPLIT, start)
        good = read_batches(spark(t), f"{out}/pings").withColumn("reject_reason", F.lit(None).cast("string"))
        return good.unionByName(read_batches(spark(t), f"{out}/rejected"))

    def s_positions(t):
        pings = t["driver_location"]
        folder, moment = scratch_path(spark(t), "position-pings"), F.lit(EVENTS_SPLIT).cast("timestamp_ntz")
        parts = iter((pings.where(F.col("timestamp") < moment), pings.where(F.col("timestamp") >= moment)))

        def start(s, o):
            next(parts).write.mode("append").parquet(folder)
            return jobs.stream_positions(s, jobs.read_feed(spark(t), folder, pings.schema), t, o)

        out = _replay("positions", t["ride_history"], "timestamp", EVENTS_SPLIT, start)
        return jobs.latest_locations(spark(t), out)

    def s_suspended(name, job):
        def run(t):
            out = _replay(name, t["ratings"], "timestamp", PAYMENTS_SPLIT, lambda s, o: job(s, t["driver"], o, many=True))
            return jobs.users_after_suspensions(t["users"], out)
        return run

    def merged_drivers(t):
        """The driver table kept in buckets, after two feeds of changes."""
        drivers, feed_rows = t["driver"], feed(t, "driver_changes")
        kept = Snapshot(spark(t), scratch_path(spark(t), "drivers"), drivers.schema, ("driver_id",), buckets=16)
        kept.merge(drivers, lambda rows: rows)
        moment = F.lit(EVENTS_SPLIT).cast("timestamp_ntz")
        for part in (F.col("changed_at") < moment, ~F.coalesce(F.col("changed_at") < moment, F.lit(False))):
            kept.change(feed_rows.where(part), changes.change_drivers)
        return kept.read()

    def from_summary(report, **fixed):
        def run(t):
            out = _replay("days", t["payments"], "transaction_date", PAYMENTS_SPLIT, jobs.stream_payment_days)
            return report({"payment_days": jobs.payment_days(spark(t), out)}, **fixed)
        return run

    def s_locations(t):
        out = _replay(
            "locations", t["driver_location"], "timestamp", EVENTS_SPLIT, jobs.stream_latest_location
        )
        return jobs.latest_locations(spark(t), out)

    def s_demand(t):
        out = _replay(
            "demand", t["ride_history"], "timestamp", EVENTS_SPLIT,
            lambda s, o: jobs.stream_demand_surge(s, t, o, DEMAND_LIMIT),
        )
        return jobs.demand_surges(spark(t), out)

    def s_paid(t):
        out = _replay(
            "paid", feed(t, "payment_changes"), "timestamp", PAYMENTS_SPLIT,
            jobs.stream_payment_completes_ride,
        )
        return events.rides_after_payments(t["rides"], read_batches(spark(t), f"{out}/rows"))

    def s_promos(t):
        out = _replay(
            "promos", t["payments"], "transaction_date", PAYMENTS_SPLIT, jobs.stream_promo_usage
        )
        return jobs.promos_after_usage(t["promo_code"], out)

    def s_effects(part):
        def run(t):
            out = _replay(
                "effects", t["ride_history"], "timestamp", EVENTS_SPLIT,
                lambda s, o: jobs.stream_ride_effects(s, t, o, many=True),
            )
            return read_batches(spark(t), f"{out}/{part}")
        return run

    def s_guard(t):
        out = _replay(
            "guard", feed(t, "booking_feed"), "timestamp", EVENTS_SPLIT, jobs.stream_double_booking_guard
        )
        return read_batches(spark(t), f"{out}/decisions")

    return {
        "rating_alerts": ("ST2", lambda t: events.rating_alerts(running(t), t["driver"])),
        "users_after_rating_alerts": (
            "ST2",
            lambda t: events.suspend(
                t["users"], events.rating_alerts(running(t), t["driver"]), "ref_user_id"
            ),
        ),
        "rider_flags": ("ST3", lambda t: events.rider_flags(running(t), t["driver"])),
        "demand_windows": ("ST4", windows),
        "rides_after_payments": (
            "ST5",
            lambda t: events.rides_after_payments(
                t["rides"], events.paid_transitions(feed(t, "payment_changes"))
            ),
        ),
        "promos_after_usage": ("ST6", usage),
        "ride_effects_history": ("ST7", lambda t: events.ride_effects(steps(t), t)["history"]),
        "ride_effects_freed": ("ST7", lambda t: events.ride_effects(steps(t), t)["freed"]),
        "ride_effects_pings": ("ST7", lambda t: events.ride_effects(steps(t), t)["pings"]),
        "double_booking_guard": (
            "ST8", lambda t: events.double_booking_guard(events.open_steps(feed(t, "booking_feed")))
        ),
        "users_after_rider_flags": (
            "ST3",
            lambda t: events.suspend(t["users"], events.rider_flags(running(t), t["driver"]), "rated_user_id"),
        ),
        "driver_positions": ("ST1, ST7", lambda t: events.positions(t, steps(t))),
        "pings_judged_as_of": ("SRC4", lambda t: ingest.judge_pings_as_of(feed(t, "ping_requests"), versions(t))),
        "drivers_after_merged_changes": ("LC9", merged_drivers),
        "platform_revenue_from_summary": ("AG2", from_summary(aggregates.platform_revenue)),
        "revenue_report_admin_from_summary": ("AG4", from_summary(aggregates.revenue_report_admin, **RANGE)),
        "revenue_totals_from_summary": ("AG6", from_summary(aggregates.revenue_totals, **RANGE)),
        "refund_report_from_summary": ("AG20", from_summary(aggregates.refund_report, **RANGE)),
        "stream_pings_judged_as_of": ("SRC4", s_as_of),
        "stream_driver_positions": ("ST1, ST7", s_positions),
        "stream_users_after_rating_alerts": ("ST2", s_suspended("alert-users", jobs.stream_rating_alerts)),
        "stream_users_after_rider_flags": ("ST3", s_suspended("flag-users", jobs.stream_rider_flags)),
        "stream_ingested_pings": ("SRC4", s_pings("pings")),
        "stream_rejected_pings": ("SRC4", s_pings("rejected")),
        "stream_latest_location": ("ST1", s_locations),
        "stream_rating_alerts": (
            "ST2", lambda t: rated(t, "alerts", jobs.stream_rating_alerts)
        ),
        "stream_rider_flags": ("ST3", lambda t: rated(t, "flags", jobs.stream_rider_flags)),
        "stream_demand_surge": ("ST4", s_demand),
        "stream_payment_completes_ride": ("ST5", s_paid),
        "stream_promo_usage": ("ST6", s_promos),
        "stream_ride_effects_history": ("ST7", s_effects("history")),
        "stream_ride_effects_freed": ("ST7", s_effects("freed")),
        "stream_ride_effects_pings": ("ST7", s_effects("pings")),
        "stream_double_booking_guard": ("ST8", s_guard),
    }


def all_queries() -> dict[str, Query]:
    checks = {**REPORTS_SQL, **PRICING_SQL, **JOBS_SQL, **STREAMS_SQL}
    out = {}
    for name, (survey_id, run) in {**_reports(), **_pricing(), **_jobs(), **_streams()}.items():
        sql = checks.get(name)
        out[name] = Query(survey_id, run, with_ride_tables(sql, FEEDS) if sql else None)
    return out
