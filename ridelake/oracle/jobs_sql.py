"""DuckDB queries that check the request jobs, change feeds, ingest rules and the audit."""

from __future__ import annotations

from ridelake.operators.audit import FOREIGN_KEYS, NOT_NULL, UNIQUE, row_rules

_BOOKING = """decided AS (
  SELECT q.*,
    (SELECT min(vehicle_id) FROM vehicles v
     WHERE v.driver_id = q.driver_id AND verification_status = 'verified'
       AND (q.vehicle_type IS NULL OR v.vehicle_type = lower(q.vehicle_type))) AS vehicle_id,
    CAST(CASE lower(vehicle_type) WHEN 'bike' THEN 80 WHEN 'premium' THEN 350 ELSE 200 END
         AS DECIMAL(10,2)) AS fare
  FROM ride_requests q),
judged AS (
  SELECT *, CASE WHEN coalesce(pickup_address, '') = '' OR coalesce(dropoff_address, '') = ''
                      OR driver_id IS NULL THEN 'missing_fields'
                 WHEN vehicle_id IS NULL THEN 'no_verified_vehicle' END AS reject_reason
  FROM decided)"""

_STATUS = """judged AS (
  SELECT c.*, r.driver_id, r.vehicle_id,
    CASE WHEN c.status NOT IN ('accepted', 'driver_en_route', 'in_progress', 'completed', 'cancelled')
           THEN 'invalid_status'
         WHEN r.ride_id IS NULL THEN 'ride_not_found'
         WHEN actor_role = 'driver' AND actor.driver_id IS DISTINCT FROM r.driver_id
           OR actor_role = 'driver' AND actor.driver_id IS NULL THEN 'not_your_ride'
    END AS reject_reason
  FROM status_changes c LEFT JOIN rides r ON r.ride_id = c.ride_id
  LEFT JOIN driver actor ON actor.user_id = c.actor_user_id),
done AS (SELECT * FROM judged WHERE reject_reason IS NULL)"""

_ACTIONS = """flagged AS (
  SELECT a.*, r.driver_id, r.ride_status, r.ride_id IS NOT NULL AS known,
    coalesce(CASE WHEN action = 'cancel' THEN r.user_id = actor_user_id
                  ELSE r.driver_id = actor.driver_id END, false) AS owned,
    row_number() OVER (PARTITION BY a.ride_id ORDER BY acted_at, action_id) AS n
  FROM ride_actions a LEFT JOIN rides r ON r.ride_id = a.ride_id
  LEFT JOIN driver actor ON actor.user_id = a.actor_user_id),
walk AS (
  SELECT ride_id, n, action_id, ok,
         CASE WHEN NOT ok THEN ride_status WHEN action = 'accept' THEN 'accepted'
              WHEN action = 'reject' THEN 'rejected_by_driver' ELSE 'cancelled' END AS state
  FROM (SELECT *, owned AND (action = 'accept' OR action = 'reject' AND ride_status = 'requested'
                  OR action = 'cancel' AND ride_status IN ('requested', 'accepted')) AS ok
        FROM flagged WHERE n = 1)
  UNION ALL
  SELECT ride_id, n, action_id, ok,
         CASE WHEN NOT ok THEN state WHEN action = 'accept' THEN 'accepted'
              WHEN action = 'reject' THEN 'rejected_by_driver' ELSE 'cancelled' END
  FROM (SELECT f.*, w.state, owned AND (action = 'accept' OR action = 'reject' AND state = 'requested'
                  OR action = 'cancel' AND state IN ('requested', 'accepted')) AS ok
        FROM walk w JOIN flagged f ON f.ride_id = w.ride_id AND f.n = w.n + 1)),
judged AS (
  SELECT f.action_id, f.ride_id, action, actor_user_id, acted_at, driver_id, walk.state, f.n,
    CASE WHEN NOT known THEN 'ride_not_found' WHEN NOT owned THEN 'not_your_ride'
         WHEN NOT coalesce(ok, false) THEN 'wrong_status' END AS reject_reason
  FROM flagged f LEFT JOIN walk USING (action_id))"""

_SETTLE = """base AS (
  SELECT q.*, r.driver_id, CAST(coalesce(r.fare, 0) AS DECIMAL(18,2)) AS original_fare, p.promo_id,
    CAST(coalesce(discount_amount, 0) AS DECIMAL(18,2)) AS discount_applied,
    q.promo_code IS NOT NULL AND p.promo_id IS NULL AS bad_promo,
    CASE WHEN payment_method NOT IN ('cash', 'card', 'wallet') THEN 'invalid_method'
         WHEN r.ride_id IS NULL THEN 'ride_not_found'
         WHEN ride_status <> 'completed' THEN 'not_completed'
         WHEN q.ride_id IN (SELECT ride_id FROM payments WHERE payment_status = 'paid')
           THEN 'already_paid' END AS reason
  FROM payment_requests q
  LEFT JOIN rides r ON r.ride_id = q.ride_id AND r.user_id = q.user_id
  LEFT JOIN promo_code p ON lower(p.code) = lower(q.promo_code) AND expiry_date >= DATE '1998-08-02'),
turns AS (
  SELECT *, coalesce(sum(CASE WHEN reason IS NULL AND NOT bad_promo THEN 1 ELSE 0 END) OVER (
      PARTITION BY ride_id ORDER BY requested_at, request_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS paid_before
  FROM base),
priced AS (
  SELECT *, CAST(CASE WHEN NOT bad_promo AND reason IS DISTINCT FROM 'ride_not_found'
                      THEN greatest(0, original_fare - discount_applied) END AS DECIMAL(18,2)) AS raw_amount,
    CASE WHEN reason IS NOT NULL THEN reason WHEN paid_before > 0 THEN 'already_paid'
         WHEN bad_promo THEN 'invalid_promo' END AS reject_reason
  FROM turns)"""

_COMPLETE = """quoted AS (
  SELECT q.*, r.user_id, r.driver_id, r.ride_id IS NOT NULL AS known, p.promo_id,
    coalesce(f.base_fare, 50) + coalesce(f.per_km_rate, 20) * distance_km
      + coalesce(f.per_min_rate, 2) * duration_min AS plain,
    greatest(CASE WHEN hour(requested_at) IN (7, 8, 9, 17, 18, 19, 20)
                  THEN coalesce(f.surge_peak_mult, 1.5) ELSE 1 END,
             CASE WHEN (SELECT count(*) FROM rides WHERE ride_status = 'requested') > 10
                  THEN coalesce(f.surge_demand_mult, 1.8) ELSE 1 END) AS surge,
    coalesce(discount_amount, 0) AS discount
  FROM ride_completions q LEFT JOIN rides r ON r.ride_id = q.ride_id
  LEFT JOIN vehicles v ON v.vehicle_id = r.vehicle_id
  LEFT JOIN fare_rules f ON f.vehicle_type = v.vehicle_type
  LEFT JOIN promo_code p ON lower(p.code) = lower(q.promo_code) AND expiry_date >= DATE '1998-08-02'),
judged AS (
  SELECT request_id, ride_id, distance_km, duration_min, payment_method, promo_code, requested_at,
    user_id, driver_id, promo_id,
    CAST(greatest(0, round(plain * surge, 2) - discount) AS DECIMAL(18,2)) AS final_fare,
    surge > 1 AS surge_applied, CAST(discount AS DECIMAL(18,2)) AS discount_applied,
    CASE WHEN NOT known THEN 'ride_not_found' END AS reject_reason
  FROM quoted)"""

_RATE = """base AS (
  SELECT q.request_id, q.ride_id, q.rated_by, q.rated_user_id,
    TRY_CAST(regexp_extract(q.score, '^\\s*([+-]?[0-9]+)', 1) AS INTEGER) AS score, q.comment,
    q.submitted_at, r.ride_id IS NOT NULL AS known, ride_status,
    EXISTS (SELECT 1 FROM ratings g WHERE g.ride_id = q.ride_id AND g.rated_by = q.rated_by) AS rated
  FROM rating_requests q LEFT JOIN rides r ON r.ride_id = q.ride_id),
reasoned AS (
  SELECT *, CASE WHEN score IS NULL OR score NOT BETWEEN 1 AND 5 THEN 'invalid_score'
                 WHEN NOT known THEN 'ride_not_found' WHEN ride_status <> 'completed' THEN 'not_completed'
                 WHEN rated THEN 'already_rated' END AS reason
  FROM base),
judged AS (
  SELECT request_id, ride_id, rated_by, rated_user_id, score, comment, submitted_at,
    CASE WHEN reason IS NOT NULL THEN reason
         WHEN sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) OVER (
                PARTITION BY ride_id, rated_by ORDER BY submitted_at, request_id) > 1
           THEN 'already_rated' END AS reject_reason
  FROM reasoned)"""

_ACCOUNTS = """judged AS (
  SELECT *, CASE WHEN account_status NOT IN ('active', 'inactive', 'suspended') THEN 'invalid_status'
                 WHEN user_id NOT IN (SELECT user_id FROM users) THEN 'not_found' END AS reject_reason
  FROM account_changes)"""

_REFUNDS = """judged AS (
  SELECT q.*, CASE WHEN p.payment_id IS NULL THEN 'payment_not_found'
                   WHEN payment_status <> 'paid' THEN 'not_paid'
                   WHEN row_number() OVER (PARTITION BY q.payment_id ORDER BY requested_at, request_id) > 1
                     THEN 'not_paid' END AS reject_reason
  FROM refund_requests q LEFT JOIN payments p ON p.payment_id = q.payment_id)"""

_VEHICLES = """cleaned AS (
  SELECT request_id, driver_id, upper(trim(license_plate)) AS license_plate, trim(make) AS make,
    trim(model) AS model, TRY_CAST(regexp_extract(year, '^\\s*([+-]?[0-9]+)', 1) AS INTEGER) AS year,
    trim(color) AS color, lower(trim(vehicle_type)) AS vehicle_type, latitude, longitude, submitted_at
  FROM vehicle_requests),
reasoned AS (
  SELECT *, CASE WHEN make IS NULL THEN 'missing_fields'
                 WHEN year IS NULL OR year NOT BETWEEN 2000 AND 2026 THEN 'invalid_year'
                 WHEN vehicle_type NOT IN ('economy', 'premium', 'bike') THEN 'invalid_type'
                 WHEN driver_id IS NULL OR driver_id NOT IN (SELECT driver_id FROM driver) THEN 'unknown_driver'
                 WHEN license_plate IN (SELECT upper(license_plate) FROM vehicles) THEN 'duplicate_plate'
            END AS reason
  FROM cleaned),
judged AS (
  SELECT * EXCLUDE (reason), CASE WHEN reason IS NOT NULL THEN reason
         WHEN sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) OVER (
                PARTITION BY license_plate ORDER BY submitted_at, request_id) > 1 THEN 'duplicate_plate'
         END AS reject_reason
  FROM reasoned)"""

_REGISTER = """reasoned AS (
  SELECT *, lower(trim(email)) AS e, lower(trim(phone_number)) AS p,
    CASE WHEN fname IS NULL THEN 'missing_fields' WHEN role = 'admin' THEN 'invalid_role'
         WHEN role = 'driver' AND cnic IS NULL THEN 'missing_papers'
         WHEN lower(trim(email)) IN (SELECT lower(email) FROM users)
           OR lower(trim(phone_number)) IN (SELECT phone_number FROM users) THEN 'duplicate' END AS reason
  FROM registrations),
folded AS (
  SELECT list_reduce(
    list({'e': e, 'p': p, 'id': request_id, 'emails': CAST([] AS VARCHAR[]),
          'phones': CAST([] AS VARCHAR[]), 'ids': CAST([] AS BIGINT[])}
         ORDER BY submitted_at, request_id),
    lambda acc, x: CASE WHEN list_contains(acc.emails, x.e) OR list_contains(acc.phones, x.p) THEN acc
      ELSE {'e': x.e, 'p': x.p, 'id': x.id, 'emails': list_append(acc.emails, x.e),
            'phones': list_append(acc.phones, x.p), 'ids': list_append(acc.ids, x.id)} END,
    {'e': '', 'p': '', 'id': CAST(-1 AS BIGINT), 'emails': CAST([] AS VARCHAR[]),
     'phones': CAST([] AS VARCHAR[]), 'ids': CAST([] AS BIGINT[])}) AS state
  FROM reasoned WHERE reason IS NULL),
winners AS (SELECT unnest(state.ids) AS request_id FROM folded),
judged AS (
  SELECT request_id, submitted_at, fname, lname, email, phone_number, role, cnic, license_number,
    CASE WHEN reason IS NOT NULL THEN reason
         WHEN request_id NOT IN (SELECT request_id FROM winners) THEN 'duplicate' END AS reject_reason
  FROM reasoned)"""


def _latest(column: str, source: str, key: str, where: str = "true") -> str:
    """Latest set value of a change column per key, as a scalar subquery."""
    return f"""(SELECT arg_max({column}, (changed_at, change_id)) FROM {source}
   WHERE {source}.{key} = s.{key} AND {column} IS NOT NULL AND {where})"""


def _edited(table: str, source: str, key: str, columns: dict[str, str]) -> str:
    parts = ", ".join(
        f"coalesce({_latest(column, source, key, where)}, s.{column}) AS {column}"
        for column, where in columns.items()
    )
    return f"SELECT s.* REPLACE ({parts}) FROM {table} s"


_DRIVER_OK = "coalesce(availability_status <> 'asleep', true)"
_RULE_OK = "surge_demand_mult >= 1 AND surge_peak_mult >= 1"


def _audit_sql() -> str:
    parts = []
    for table in NOT_NULL:
        for rule, condition in row_rules(table).items():
            parts.append((table, rule, f"SELECT count(*) FROM {table} WHERE NOT ({condition})"))
    for table, keys in UNIQUE.items():
        for key in keys:
            parts.append((table, f"unique {key}", f"SELECT count({key}) - count(DISTINCT {key}) FROM {table}"))
    for table, links in FOREIGN_KEYS.items():
        for column, target in links.items():
            parent, parent_key = target.split(".")
            parts.append((
                table, f"foreign_key {column}",
                f"SELECT count(*) FROM {table} c WHERE {column} IS NOT NULL AND NOT EXISTS "
                f"(SELECT 1 FROM {parent} x WHERE x.{parent_key} = c.{column})",
            ))
    return "\nUNION ALL\n".join(
        "SELECT '{}' AS table_name, '{}' AS rule, CAST(({}) AS BIGINT) AS violations".format(
            table, rule.replace("'", "''"), sql
        )
        for table, rule, sql in parts
    )


_PROFILE_KEYS = {
    "users": "user_id", "driver": "driver_id", "vehicles": "vehicle_id", "location": "location_id",
    "driver_location": "location_id", "fare_rules": "rule_id", "promo_code": "promo_id",
    "rides": "ride_id", "ride_history": "history_id", "payments": "payment_id",
    "ratings": "rating_id", "complaints": "complaint_id", "admin_notifications": "notification_id",
    "driver_payouts": "payout_id",
}

JOBS_SQL = {
    "table_profile": "\nUNION ALL\n".join(
        f"SELECT '{table}' AS table_name, count(*) AS row_count, "
        f"CAST(coalesce(sum({key}), 0) AS DECIMAL(38,0)) AS key_sum FROM {table}"
        for table, key in _PROFILE_KEYS.items()
    ),
    "legacy_users_upgraded": """SELECT user_id, fname, lname, email, phone_number, role, account_status,
  CAST(0 AS DECIMAL(10,2)) AS wallet_balance, CAST(NULL AS VARCHAR) AS city, registration_date
FROM users""",
    "constraint_audit": _audit_sql(),
    "ping_decisions": """SELECT p.*, CASE WHEN latitude IS NULL THEN 'missing_coordinates'
  WHEN driver_id NOT IN (SELECT driver_id FROM driver) THEN 'unknown_driver' END AS reject_reason
FROM ping_requests p""",
    "vehicle_request_decisions": f"WITH {_VEHICLES} SELECT * FROM judged",
    "new_vehicles": f"""WITH {_VEHICLES}
SELECT request_id AS vehicle_id, driver_id, license_plate, make, model, year, color, vehicle_type,
  'pending' AS verification_status, 0 AS total_trips FROM judged WHERE reject_reason IS NULL""",
    "drivers_after_profile_completion": f"""WITH {_VEHICLES}
SELECT d.* REPLACE (
  CASE WHEN driver_id IN (SELECT driver_id FROM judged WHERE reject_reason IS NULL)
       THEN 'verified' ELSE verification_status END AS verification_status,
  CASE WHEN driver_id IN (SELECT driver_id FROM judged WHERE reject_reason IS NULL)
       THEN 'available' ELSE availability_status END AS availability_status)
FROM driver d""",
    "first_pings": f"""WITH {_VEHICLES}
SELECT request_id AS location_id, driver_id, latitude, longitude, submitted_at AS timestamp
FROM judged WHERE reject_reason IS NULL AND latitude IS NOT NULL""",
    "registration_decisions": f"WITH {_REGISTER} SELECT * FROM judged",
    "registered_drivers": f"""WITH {_REGISTER}
SELECT request_id AS driver_id, request_id AS user_id, cnic, license_number,
  CAST(NULL AS VARCHAR) AS profile_photo, 'pending' AS verification_status,
  'offline' AS availability_status, CAST(0 AS DECIMAL(3,2)) AS average_rating, 0 AS total_trips
FROM judged WHERE reject_reason IS NULL AND role = 'driver'""",
    "complaint_decisions": """SELECT q.*, CASE WHEN ride_id IS NULL OR description = '' THEN 'missing_fields'
  WHEN ride_id NOT IN (SELECT ride_id FROM rides) THEN 'ride_not_found' END AS reject_reason
FROM complaint_requests q""",
    "ride_request_decisions": f"WITH {_BOOKING} SELECT * FROM judged",
    "guarded_request_decisions": f"""WITH {_BOOKING}
SELECT * REPLACE (coalesce(reject_reason, CASE WHEN driver_id IN (SELECT driver_id FROM rides
  WHERE ride_status IN ('accepted', 'driver_en_route', 'in_progress')) THEN 'driver_on_active_ride' END) AS reject_reason)
FROM judged""",
    "booked_rides": f"""WITH {_BOOKING}
SELECT request_id AS ride_id, user_id, driver_id, vehicle_id, request_id * 2 AS pickup_location_id,
  request_id * 2 + 1 AS dropoff_location_id, requested_at AS request_time, scheduled_time,
  CAST(NULL AS TIMESTAMP) AS start_time, CAST(NULL AS TIMESTAMP) AS end_time,
  'requested' AS ride_status, fare
FROM judged WHERE reject_reason IS NULL""",
    "booked_locations": f"""WITH {_BOOKING}
SELECT request_id * 2 AS location_id, CAST(0 AS DECIMAL(10,7)) AS latitude,
  CAST(0 AS DECIMAL(10,7)) AS longitude, pickup_address AS address, CAST(NULL AS VARCHAR) AS city
FROM judged WHERE reject_reason IS NULL
UNION ALL
SELECT request_id * 2 + 1, CAST(0 AS DECIMAL(10,7)), CAST(0 AS DECIMAL(10,7)), dropoff_address, NULL FROM judged WHERE reject_reason IS NULL""",
    "status_change_decisions": f"WITH {_STATUS} SELECT * FROM judged",
    "rides_after_status_changes": f"""WITH {_STATUS},
final AS (
  SELECT ride_id, arg_max(status, (changed_at, change_id)) AS status,
         max(changed_at) FILTER (status = 'in_progress') AS started,
         max(changed_at) FILTER (status = 'completed') AS ended
  FROM done GROUP BY ride_id)
SELECT r.* REPLACE (coalesce(final.status, ride_status) AS ride_status,
  coalesce(started, start_time) AS start_time, coalesce(ended, end_time) AS end_time)
FROM rides r LEFT JOIN final ON final.ride_id = r.ride_id""",
    "drivers_after_status_changes": f"""WITH {_STATUS},
finished AS (
  SELECT driver_id, count(*) FILTER (status = 'completed') AS n,
    bool_or(status = 'completed' OR status = 'cancelled' AND was NOT IN ('completed', 'cancelled')) AS freed
  FROM (SELECT done.driver_id, done.status, coalesce(
          lag(done.status) OVER (PARTITION BY done.ride_id ORDER BY changed_at, change_id), r.ride_status) AS was
        FROM done JOIN rides r ON r.ride_id = done.ride_id)
  GROUP BY 1)
SELECT d.* REPLACE (CAST(total_trips + coalesce(n, 0) AS INTEGER) AS total_trips,
  CASE WHEN freed THEN 'available' ELSE availability_status END AS availability_status)
FROM driver d LEFT JOIN finished f ON f.driver_id = d.driver_id""",
    "vehicles_after_status_changes": f"""WITH {_STATUS},
finished AS (SELECT vehicle_id, count(*) AS n FROM done WHERE status = 'completed' GROUP BY 1)
SELECT v.* REPLACE (CAST(total_trips + coalesce(n, 0) AS INTEGER) AS total_trips)
FROM vehicles v LEFT JOIN finished f ON f.vehicle_id = v.vehicle_id""",
    "ride_action_decisions": f"""WITH RECURSIVE {_ACTIONS}
SELECT action_id, ride_id, action, actor_user_id, acted_at, driver_id, reject_reason FROM judged""",
    "rides_after_actions": f"""WITH RECURSIVE {_ACTIONS}
SELECT r.* REPLACE (coalesce(
  (SELECT arg_max(state, n) FROM judged j WHERE j.ride_id = r.ride_id AND reject_reason IS NULL),
  ride_status) AS ride_status) FROM rides r""",
    "drivers_after_actions": f"""WITH RECURSIVE {_ACTIONS}
SELECT d.* REPLACE (coalesce(
  (SELECT arg_max(CASE WHEN action = 'accept' THEN 'busy' ELSE 'available' END, (acted_at, action_id))
   FROM judged j WHERE j.driver_id = d.driver_id AND reject_reason IS NULL AND action <> 'reject'),
  availability_status) AS availability_status) FROM driver d""",
    "payment_decisions": f"""WITH {_SETTLE}
SELECT request_id, ride_id, user_id, payment_method, promo_code, requested_at, driver_id,
  CASE WHEN reason IS DISTINCT FROM 'ride_not_found' AND EXISTS (
         SELECT 1 FROM rides r WHERE r.ride_id = p.ride_id AND r.user_id = p.user_id)
       THEN original_fare END AS original_fare,
  promo_id, discount_applied,
  CASE WHEN EXISTS (SELECT 1 FROM rides r WHERE r.ride_id = p.ride_id AND r.user_id = p.user_id)
       THEN raw_amount END AS amount,
  CASE WHEN EXISTS (SELECT 1 FROM rides r WHERE r.ride_id = p.ride_id AND r.user_id = p.user_id)
       THEN CAST(round(raw_amount * 0.20, 2) AS DECIMAL(18,2)) END AS platform_commission,
  CASE WHEN EXISTS (SELECT 1 FROM rides r WHERE r.ride_id = p.ride_id AND r.user_id = p.user_id)
       THEN CAST(round(raw_amount * 0.80, 2) AS DECIMAL(18,2)) END AS driver_net, reject_reason
FROM priced p""",
    "settled_payments": f"""WITH {_SETTLE}
SELECT request_id AS payment_id, ride_id, user_id, CAST(raw_amount AS DECIMAL(10,2)) AS amount,
  payment_method, 'paid' AS payment_status, requested_at AS transaction_date, promo_id
FROM priced WHERE reject_reason IS NULL""",
    "payment_audit_entries": f"""WITH {_SETTLE}
SELECT request_id AS history_id, ride_id, 'payment_completed:' || payment_method || ':driver_net_'
  || rtrim(rtrim(CAST(CAST(round(raw_amount * 0.80, 2) AS DECIMAL(18,2)) AS VARCHAR), '0'), '.') AS status,
  requested_at AS timestamp
FROM priced WHERE reject_reason IS NULL AND driver_id IS NOT NULL""",
    "audit_events": f"""WITH {_SETTLE}
SELECT request_id AS history_id, ride_id, payment_method,
  CAST(round(raw_amount * 0.80, 2) AS DECIMAL(18,2)) AS driver_net, requested_at AS timestamp,
  true AS reconciled
FROM priced WHERE reject_reason IS NULL AND driver_id IS NOT NULL""",
    "ride_completion_decisions": f"WITH {_COMPLETE} SELECT * FROM judged",
    "rides_after_completion": f"""WITH {_COMPLETE},
final AS (
  SELECT ride_id, arg_max(final_fare, (requested_at, request_id)) AS paid_fare, max(requested_at) AS ended
  FROM judged WHERE reject_reason IS NULL GROUP BY ride_id)
SELECT r.* REPLACE (CASE WHEN ended IS NOT NULL THEN 'completed' ELSE ride_status END AS ride_status,
  coalesce(ended, end_time) AS end_time, CAST(coalesce(paid_fare, fare) AS DECIMAL(10,2)) AS fare)
FROM rides r LEFT JOIN final ON final.ride_id = r.ride_id""",
    "drivers_after_completion": f"""WITH {_COMPLETE},
finished AS (SELECT driver_id, count(*) AS n FROM judged WHERE reject_reason IS NULL GROUP BY 1)
SELECT d.* REPLACE (CAST(total_trips + coalesce(n, 0) AS INTEGER) AS total_trips,
  CASE WHEN n > 0 THEN 'available' ELSE availability_status END AS availability_status)
FROM driver d LEFT JOIN finished f ON f.driver_id = d.driver_id""",
    "weekly_payouts": """WITH earned AS (
  SELECT driver_id, CAST(round(sum(amount) * 0.80, 2) AS DECIMAL(18,2)) AS amount
  FROM payments JOIN rides USING (ride_id)
  WHERE payment_status = 'paid' AND driver_id IS NOT NULL
    AND transaction_date BETWEEN TIMESTAMP '2001-10-25' AND TIMESTAMP '2001-11-01' GROUP BY driver_id)
SELECT d.driver_id, amount, 'pending' AS status, DATE '2001-10-25' AS period_start,
  DATE '2001-11-01' AS period_end,
  'Weekly payout request — net 80% of Rs.' || CAST(round(amount * 1.25, 2) AS DECIMAL(18,2)) || ' gross'
    AS notes,
  TIMESTAMP '2001-11-01' AS requested_at,
  CASE WHEN d.driver_id IN (SELECT driver_id FROM driver_payouts
              WHERE status IN ('pending', 'processing') AND period_end >= DATE '2001-10-25')
         THEN 'payout_waiting'
       WHEN coalesce(amount, 0) <= 0 THEN 'no_earnings' END AS reject_reason
FROM driver d LEFT JOIN earned e ON e.driver_id = d.driver_id""",
    "rating_decisions": f"WITH {_RATE} SELECT * FROM judged",
    "accepted_ratings": f"""WITH {_RATE}
SELECT request_id AS rating_id, ride_id, rated_by, rated_user_id, score,
  CASE WHEN comment <> '' THEN comment END AS comment, submitted_at AS timestamp
FROM judged WHERE reject_reason IS NULL""",
    "driver_ratings_after": f"""WITH {_RATE},
grown AS (
  SELECT rated_user_id, score FROM ratings
  UNION ALL SELECT rated_user_id, score FROM judged WHERE reject_reason IS NULL)
SELECT driver_id, CAST((sum(score) * 200 + count(*)) // (2 * count(*)) * 0.01 AS DECIMAL(3,2)) AS average_rating
FROM driver JOIN grown ON rated_user_id = user_id GROUP BY driver_id""",
    "flagged_low_rated_drivers": """SELECT user_id, driver_id, average_rating, total_trips
FROM driver JOIN users USING (user_id)
WHERE average_rating > 0 AND average_rating < 3.5 AND total_trips >= 5 AND account_status = 'active'""",
    "users_after_flagging": """SELECT u.* REPLACE (CASE WHEN account_status = 'active' AND EXISTS (
    SELECT 1 FROM driver d WHERE d.user_id = u.user_id AND average_rating > 0 AND average_rating < 3.5
      AND d.total_trips >= 5) THEN 'suspended' ELSE account_status END AS account_status)
FROM users u""",
    "drivers_flagged_count": """SELECT count(*) AS drivers_flagged FROM driver JOIN users USING (user_id)
WHERE average_rating > 0 AND average_rating < 3.5 AND total_trips >= 5 AND account_status = 'active'""",
    "account_change_decisions": f"WITH {_ACCOUNTS} SELECT * FROM judged",
    "users_after_account_changes": f"""WITH {_ACCOUNTS}
SELECT s.* REPLACE (coalesce((SELECT arg_max(account_status, (changed_at, change_id)) FROM judged j
  WHERE j.user_id = s.user_id AND reject_reason IS NULL), account_status) AS account_status)
FROM users s""",
    "users_after_profile_changes": _edited(
        "users", "profile_changes", "user_id", {c: "true" for c in ("fname", "lname", "phone_number")}
    ),
    "drivers_after_changes": _edited(
        "driver", "driver_changes", "driver_id",
        {c: _DRIVER_OK for c in ("availability_status", "verification_status", "profile_photo")},
    ),
    "vehicles_after_verification": _edited(
        "vehicles", "vehicle_changes", "vehicle_id", {"verification_status": "verification_status <> 'pending'"}
    ),
    "promos_after_changes": """WITH good AS (
  SELECT * FROM promo_changes WHERE op = 'delete' OR discount_amount > 0),
state AS (
  SELECT promo_id, max((changed_at, change_id)) FILTER (op = 'delete') AS deleted,
         max((changed_at, change_id)) AS newest FROM good GROUP BY promo_id),
alive AS (
  SELECT g.* FROM good g JOIN state USING (promo_id)
  WHERE op = 'upsert' AND (deleted IS NULL OR (g.changed_at, g.change_id) > deleted)),
folded AS (
  SELECT promo_id, arg_max(code, (changed_at, change_id)) AS code,
    arg_max(discount_amount, (changed_at, change_id)) AS discount_amount,
    arg_max(expiry_date, (changed_at, change_id)) AS expiry_date,
    arg_max(usage_count, (changed_at, change_id)) AS usage_count,
    arg_max(max_uses, (changed_at, change_id)) FILTER (max_uses IS NOT NULL) AS max_uses
  FROM alive GROUP BY promo_id)
SELECT coalesce(p.promo_id, f.promo_id) AS promo_id, coalesce(f.code, p.code) AS code,
  CAST(coalesce(f.discount_amount, p.discount_amount) AS DECIMAL(10,2)) AS discount_amount,
  coalesce(f.expiry_date, p.expiry_date) AS expiry_date,
  coalesce(f.usage_count, p.usage_count) AS usage_count,
  CASE WHEN deleted IS NULL THEN coalesce(f.max_uses, p.max_uses) ELSE f.max_uses END AS max_uses
FROM promo_code p FULL JOIN folded f ON f.promo_id = p.promo_id
LEFT JOIN state s ON s.promo_id = coalesce(p.promo_id, f.promo_id)
WHERE deleted IS NULL OR f.promo_id IS NOT NULL""",
    "fare_rules_after_changes": f"""SELECT s.* REPLACE (
  {", ".join(
      f"coalesce({_latest(c, 'fare_rule_changes', 'vehicle_type', _RULE_OK)}, s.{c}) AS {c}"
      for c in ("base_fare", "per_km_rate", "per_min_rate", "surge_peak_mult", "surge_demand_mult")
  )},
  coalesce({_latest("changed_at", "fare_rule_changes", "vehicle_type", _RULE_OK)}, s.updated_at) AS updated_at)
FROM fare_rules s""",
    "notifications_after_reads": """SELECT n.* REPLACE (
  is_read OR notification_id IN (SELECT notification_id FROM notification_reads) AS is_read)
FROM admin_notifications n""",
    "complaints_after_changes": _edited(
        "complaints", "complaint_changes", "complaint_id", {"status": "status <> 'open'"}
    ),
    "refund_decisions": f"WITH {_REFUNDS} SELECT * FROM judged",
    "payments_after_refunds": f"""WITH {_REFUNDS}
SELECT p.* REPLACE (CASE WHEN payment_id IN (SELECT payment_id FROM judged WHERE reject_reason IS NULL)
  THEN 'refunded' ELSE payment_status END AS payment_status) FROM payments p""",
}
