"""DuckDB queries that check the event-driven rules, in batch and streaming form alike."""

from __future__ import annotations

from ridelake.oracle.jobs_sql import JOBS_SQL
from ridelake.oracle.reports_sql import REPORTS_SQL

_RUNNING = """running AS (
  SELECT rating_id, rated_user_id, timestamp,
         CAST((CAST(sum(score) OVER w AS BIGINT) * 200 + count(*) OVER w) // (2 * count(*) OVER w) * 0.01
              AS DECIMAL(3,2)) AS average
  FROM ratings WINDOW w AS (PARTITION BY rated_user_id ORDER BY timestamp, rating_id))"""
_ALERTS = f"""{_RUNNING},
alerts AS (
  SELECT rating_id AS notification_id, 'low_driver_rating' AS type,
    'Driver user_id=' || rated_user_id || ' has average rating ' || average
      || ' (below 3.5). Account suspended for review.' AS message,
    rated_user_id AS ref_user_id, false AS is_read, timestamp AS created_at
  FROM running WHERE average < 3.5 AND rated_user_id IN (SELECT user_id FROM driver))"""
_STEPS = """steps AS (
  SELECT *, lag(status) OVER (PARTITION BY ride_id ORDER BY timestamp, history_id) AS before
  FROM ride_history),
ended AS (
  SELECT s.history_id, r.driver_id, r.dropoff_location_id, s.timestamp, status, before
  FROM steps s JOIN rides r ON r.ride_id = s.ride_id
  WHERE before <> status AND status IN ('completed', 'cancelled') AND driver_id IS NOT NULL)"""

_BATCH = {
    "rating_alerts": f"WITH {_ALERTS} SELECT * FROM alerts",
    "users_after_rating_alerts": f"""WITH {_ALERTS}
SELECT u.* REPLACE (CASE WHEN account_status = 'active' AND user_id IN (SELECT ref_user_id FROM alerts)
  THEN 'suspended' ELSE account_status END AS account_status) FROM users u""",
    "rider_flags": f"""WITH {_RUNNING}
SELECT rating_id, rated_user_id, average, timestamp FROM running
WHERE average < 3.0 AND rated_user_id NOT IN (SELECT user_id FROM driver)""",
    "demand_windows": """SELECT date_trunc('hour', h.timestamp) AS window_start, city,
  count(*) AS requests, count(*) > 3 AS high_demand
FROM ride_history h JOIN rides USING (ride_id) JOIN location ON location_id = pickup_location_id
WHERE status = 'requested' GROUP BY 1, 2""",
    "rides_after_payments": """WITH steps AS (
  SELECT *, lag(status) OVER (PARTITION BY payment_id ORDER BY timestamp, change_id) AS before
  FROM payment_changes),
paid AS (SELECT ride_id, min(timestamp) AS paid_at FROM steps
         WHERE status = 'paid' AND before <> 'paid' GROUP BY ride_id)
SELECT r.* REPLACE (
  CASE WHEN paid_at IS NOT NULL THEN 'completed' ELSE ride_status END AS ride_status,
  CASE WHEN ride_status <> 'completed' THEN coalesce(end_time, paid_at) ELSE end_time END AS end_time)
FROM rides r LEFT JOIN paid ON paid.ride_id = r.ride_id""",
    "promos_after_usage": """SELECT c.* REPLACE (CAST(usage_count + (
    SELECT count(*) FROM payments p WHERE p.promo_id = c.promo_id) AS INTEGER) AS usage_count)
FROM promo_code c""",
    "ride_effects_history": f"""WITH {_STEPS}
SELECT history_id, ride_id, status, timestamp FROM steps WHERE before <> status""",
    "ride_effects_freed": f"""WITH {_STEPS}
SELECT history_id, driver_id, 'available' AS availability_status, timestamp FROM ended
WHERE before NOT IN ('completed', 'cancelled')""",
    "ride_effects_pings": f"""WITH {_STEPS}
SELECT history_id AS location_id, driver_id, latitude, longitude, timestamp
FROM ended JOIN location ON location_id = dropoff_location_id WHERE status = 'completed'""",
    "users_after_rider_flags": f"""WITH {_RUNNING}
SELECT u.* REPLACE (CASE WHEN account_status = 'active' AND user_id IN (
    SELECT rated_user_id FROM running WHERE average < 3.0 AND rated_user_id NOT IN (SELECT user_id FROM driver))
  THEN 'suspended' ELSE account_status END AS account_status) FROM users u""",
    "driver_positions": f"""WITH {_STEPS}, seen AS (
  SELECT location_id, driver_id, latitude, longitude, timestamp FROM driver_location
  UNION ALL
  SELECT history_id, driver_id, latitude, longitude, timestamp
  FROM ended JOIN location ON location_id = dropoff_location_id WHERE status = 'completed')
SELECT * FROM seen
QUALIFY row_number() OVER (PARTITION BY driver_id ORDER BY timestamp DESC, location_id DESC, latitude DESC, longitude DESC) = 1""",
    "pings_judged_as_of": """WITH versions AS (
  SELECT *, lead(valid_from) OVER (PARTITION BY driver_id ORDER BY valid_from) AS valid_to FROM driver_versions)
SELECT p.*, CASE WHEN latitude IS NULL THEN 'missing_coordinates' WHEN active IS NULL THEN 'unknown_driver'
  WHEN NOT active THEN 'inactive_driver' END AS reject_reason
FROM ping_requests p LEFT JOIN versions v ON v.driver_id = p.driver_id AND p.timestamp >= valid_from
  AND (valid_to IS NULL OR p.timestamp < valid_to)""",
    "double_booking_guard": """WITH moved AS (
  SELECT *, CAST(status IN ('accepted', 'driver_en_route', 'in_progress') AS INTEGER)
    - coalesce(lag(CAST(status IN ('accepted', 'driver_en_route', 'in_progress') AS INTEGER))
               OVER (PARTITION BY ride_id ORDER BY timestamp, event_id), 0) AS step
  FROM booking_feed WHERE kind = 'update'
  UNION ALL
  SELECT *, 0 FROM booking_feed WHERE kind = 'insert'),
summed AS (
  SELECT *, CAST(sum(step) OVER (PARTITION BY driver_id ORDER BY timestamp, event_id) AS BIGINT)
    AS open_rides
  FROM moved WHERE driver_id IS NOT NULL)
SELECT event_id, driver_id, timestamp, open_rides,
  CASE WHEN open_rides > 0 THEN 'driver_on_active_ride' END AS reject_reason
FROM summed WHERE kind = 'insert'
UNION ALL
SELECT event_id, driver_id, timestamp, 0, NULL FROM booking_feed WHERE kind = 'insert' AND driver_id IS NULL""",
}

_PINGS = """judged AS (
  SELECT p.*, CASE WHEN latitude IS NULL THEN 'missing_coordinates'
    WHEN driver_id NOT IN (SELECT driver_id FROM driver) THEN 'unknown_driver' END AS reject_reason
  FROM ping_requests p)"""

STREAMS_SQL = {
    **_BATCH,
    "stream_ingested_pings": f"""WITH {_PINGS}
SELECT * EXCLUDE (reject_reason) FROM judged WHERE reject_reason IS NULL""",
    "stream_rejected_pings": f"WITH {_PINGS} SELECT * FROM judged WHERE reject_reason IS NOT NULL",
    **{
        f"{name}_from_summary": REPORTS_SQL[name]
        for name in ("platform_revenue", "revenue_report_admin", "revenue_totals", "refund_report")
    },
    "drivers_after_merged_changes": JOBS_SQL["drivers_after_changes"],
    "stream_pings_judged_as_of": _BATCH["pings_judged_as_of"],
    "stream_driver_positions": _BATCH["driver_positions"],
    "stream_users_after_rating_alerts": _BATCH["users_after_rating_alerts"],
    "stream_users_after_rider_flags": _BATCH["users_after_rider_flags"],
    "stream_latest_location": REPORTS_SQL["latest_driver_location"],
    "stream_rating_alerts": _BATCH["rating_alerts"],
    "stream_rider_flags": _BATCH["rider_flags"],
    "stream_demand_surge": _BATCH["demand_windows"],
    "stream_payment_completes_ride": _BATCH["rides_after_payments"],
    "stream_promo_usage": _BATCH["promos_after_usage"],
    "stream_ride_effects_history": _BATCH["ride_effects_history"],
    "stream_ride_effects_freed": _BATCH["ride_effects_freed"],
    "stream_ride_effects_pings": _BATCH["ride_effects_pings"],
    "stream_double_booking_guard": _BATCH["double_booking_guard"],
}
