"""DuckDB queries that check the lists, wide joins, aggregates and ranked reports."""

from __future__ import annotations

_FULL_NAMES = """
parties AS (
  SELECT r.*, p.address AS pickup_address, p.city AS pickup_city, p.latitude AS pickup_lat,
         p.longitude AS pickup_lng, q.address AS dropoff_address, q.city AS dropoff_city,
         q.latitude AS dropoff_lat, q.longitude AS dropoff_lng,
         rider.user_id AS rider_id, rider.fname AS rider_fname, rider.lname AS rider_lname,
         rider.phone_number AS rider_phone, rider.city AS rider_city, dd.driver_id AS known_driver,
         dd.average_rating AS driver_rating, dd.user_id AS driver_user_id,
         person.user_id AS known_person, person.fname AS driver_fname, person.lname AS driver_lname,
         person.phone_number AS driver_phone, car.vehicle_id AS known_vehicle, car.make, car.model,
         car.license_plate, car.vehicle_type, car.color,
         CAST(date_sub('minute', start_time, end_time) AS BIGINT) AS duration_minutes
  FROM rides r
  LEFT JOIN location p ON p.location_id = r.pickup_location_id
  LEFT JOIN location q ON q.location_id = r.dropoff_location_id
  LEFT JOIN users rider ON rider.user_id = r.user_id
  LEFT JOIN driver dd ON dd.driver_id = r.driver_id
  LEFT JOIN users person ON person.user_id = dd.user_id
  LEFT JOIN vehicles car ON car.vehicle_id = r.vehicle_id)"""

_RIDE = """ride_id, user_id, driver_id, vehicle_id, pickup_location_id, dropoff_location_id,
  request_time, scheduled_time, start_time, end_time, ride_status, fare"""
_PAID = "paid AS (SELECT * FROM payments WHERE payment_status = 'paid')"
_SHARES = """CAST(sum(amount) AS DECIMAL(38,2)) AS gross_revenue,
  CAST(sum(amount * 0.20) AS DECIMAL(38,4)) AS platform_commission,
  CAST(sum(amount * 0.80) AS DECIMAL(38,4)) AS driver_payouts"""
_FINANCE = """finance AS (
  SELECT CAST(transaction_date AS DATE) AS date, payment_method, count(*) AS total_transactions,
         CAST(sum(amount) AS DECIMAL(38,2)) AS gross_revenue,
         CAST(round(sum(amount * 0.20), 2) AS DECIMAL(38,2)) AS platform_commission,
         CAST(round(sum(amount * 0.80), 2) AS DECIMAL(38,2)) AS driver_payouts
  FROM paid WHERE CAST(transaction_date AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1998-06-30'
  GROUP BY 1, 2)"""
_DRIVER_FANOUT = """fanout AS (
  SELECT d.driver_id, d.average_rating, d.total_trips, d.verification_status,
         d.availability_status, u.fname, u.lname, u.city, u.email, r.ride_id, p.payment_id,
         p.amount
  FROM driver d JOIN users u USING (user_id)
  LEFT JOIN rides r ON r.driver_id = d.driver_id AND r.ride_status = 'completed'
  LEFT JOIN paid p ON p.ride_id = r.ride_id)"""
_CITY = """
SELECT min(city) AS city, count(*) AS total_rides, CAST(sum(amount) AS DECIMAL(38,2)) AS total_revenue,
       CAST(sum(amount * 0.20) AS DECIMAL(38,4)) AS platform_commission,
       CAST(sum(amount * 0.80) AS DECIMAL(38,4)) AS driver_payouts
FROM paid JOIN rides USING (ride_id) JOIN location ON location_id = pickup_location_id
{where} GROUP BY lower(trim(city))"""
_LOW_RATED = """scores AS (
  SELECT rated_user_id AS user_id, avg(score) AS mean_score, count(*) AS total_ratings
  FROM ratings GROUP BY 1)"""
_RIDERS = """
SELECT u.user_id, fname, lname, email, phone_number, city, {wallet} registration_date,
       count(ride_id) AS total_rides,
       count(ride_id) FILTER (ride_status = 'completed') AS completed_rides,
       CAST(coalesce(sum(fare) FILTER (ride_status = 'completed'), 0) AS DECIMAL(38,2)) AS total_spent
FROM users u LEFT JOIN rides r ON r.user_id = u.user_id WHERE role = 'rider' GROUP BY ALL"""
_TRIP_COLUMNS = """ride_id, ride_status, fare, request_time, start_time, end_time, duration_minutes,
  rider_id, rider_fname, rider_lname, rider_phone, driver_fname, driver_lname, driver_phone,
  make AS vehicle_make, model AS vehicle_model, license_plate, vehicle_type, pickup_address,
  dropoff_address"""
_TRIP_WHERE = """rider_id IS NOT NULL AND known_person IS NOT NULL AND known_vehicle IS NOT NULL"""

REPORTS_SQL = {
    # lists
    "users_list": """SELECT user_id, fname, lname, email, phone_number, role, account_status, city,
  wallet_balance, registration_date FROM users""",
    "suspended_drivers_list": """SELECT user_id, fname, lname, email, phone_number, role,
  account_status, city, wallet_balance, registration_date
FROM users WHERE role = 'driver' AND account_status = 'suspended'""",
    "pending_drivers": """SELECT driver_id, fname, lname, email, city, cnic, license_number,
  verification_status, profile_photo
FROM driver JOIN users USING (user_id) WHERE verification_status = 'pending'""",
    "flagged_drivers": """SELECT driver_id, user_id, fname, lname, email, city, average_rating,
  total_trips, account_status
FROM driver JOIN users USING (user_id) WHERE average_rating > 0 AND average_rating < 3.5""",
    "promo_list": "SELECT * FROM promo_code",
    "valid_promos": """SELECT promo_id, code, discount_amount, expiry_date FROM promo_code
WHERE expiry_date >= DATE '1998-08-02'""",
    "valid_promos_with_uses_left": """SELECT promo_id, code, discount_amount, expiry_date
FROM promo_code WHERE expiry_date >= DATE '1998-08-02'
  AND NOT coalesce(usage_count >= max_uses, false)
  AND lower(code) IN (SELECT 'promo' || ride_id FROM rides)""",
    "fare_rules": "SELECT * FROM fare_rules",
    "pending_rides": f"""WITH {_FULL_NAMES}
SELECT ride_id, fare, request_time, pickup_address, dropoff_address, rider_fname AS fname,
       rider_lname AS lname, rider_phone AS phone_number
FROM parties WHERE ride_status = 'requested' AND rider_id IS NOT NULL""",
    "complaints_list": """SELECT c.*, fname, lname, email FROM complaints c JOIN users USING (user_id)""",
    "open_complaints_list": """SELECT c.*, fname, lname, email FROM complaints c
JOIN users USING (user_id) WHERE status = 'open'""",
    "drivers_in_city": """SELECT driver_id, fname, lname, email, phone_number, city, average_rating,
  total_trips, availability_status, verification_status
FROM driver JOIN users USING (user_id)
WHERE verification_status = 'verified' AND lower(city) = 'nation_3'""",
    "driver_profiles": """SELECT fname, lname, email, phone_number, account_status, driver_id, cnic,
  license_number, profile_photo, verification_status, availability_status, average_rating, total_trips
FROM users JOIN driver USING (user_id)""",
    "rider_profiles": """SELECT user_id, fname, lname, email, phone_number, role, account_status,
  registration_date FROM users""",
    "vehicles_by_driver": """SELECT * FROM vehicles
WHERE driver_id IN (SELECT driver_id FROM driver)""",
    "driver_profile_complete": """SELECT u.user_id, role,
  role <> 'driver' OR EXISTS (SELECT 1 FROM driver d JOIN vehicles v ON v.driver_id = d.driver_id
                              WHERE d.user_id = u.user_id) AS profile_complete
FROM users u""",
    "payout_history": """SELECT driver_id, payout_id, amount, status, requested_at, processed_at,
  period_start, period_end, notes FROM driver_payouts JOIN driver USING (driver_id)""",
    # wide joins
    "active_rides": f"""WITH {_FULL_NAMES}
SELECT ride_id, ride_status, request_time, pickup_address, pickup_city, dropoff_address,
  dropoff_city, rider_id, rider_fname, rider_lname, rider_phone, driver_fname, driver_lname,
  driver_phone, make AS vehicle_make, model AS vehicle_model, license_plate, vehicle_type
FROM parties WHERE ride_status NOT IN ('completed', 'cancelled', 'rejected_by_driver')""",
    "ride_summary": f"""WITH {_FULL_NAMES}
SELECT ride_id, ride_status, fare, request_time, start_time, end_time, duration_minutes,
  pickup_address, pickup_city, dropoff_address, dropoff_city, rider_id, rider_fname, rider_lname,
  rider_phone, driver_fname, driver_lname, make AS vehicle_make, model AS vehicle_model,
  license_plate, vehicle_type
FROM parties""",
    "full_trip_report": f"""WITH {_FULL_NAMES} SELECT {_TRIP_COLUMNS} FROM parties WHERE {_TRIP_WHERE}""",
    "full_trip_report_admin": f"""WITH {_FULL_NAMES}
SELECT {_TRIP_COLUMNS}, rider_city, pickup_city FROM parties
WHERE {_TRIP_WHERE} AND ride_status = 'completed'""",
    "ride_detail": f"""WITH {_FULL_NAMES}
SELECT {_RIDE}, pickup_address, pickup_lat, pickup_lng, dropoff_address, dropoff_lat, dropoff_lng,
  rider_fname, rider_lname, driver_fname, driver_lname, driver_rating, make, model, license_plate,
  vehicle_type
FROM parties""",
    "all_rides_page": f"""WITH {_FULL_NAMES}
SELECT ride_id, ride_status, fare, request_time, pickup_address, pickup_city, dropoff_address,
  rider_fname, rider_lname, driver_fname, driver_lname
FROM parties WHERE rider_id IS NOT NULL ORDER BY request_time DESC, ride_id LIMIT 50 OFFSET 50""",
    "completed_rides_by_rider": f"""WITH {_FULL_NAMES}
SELECT user_id, ride_id, fare, request_time, start_time, end_time, pickup_address, dropoff_address,
  driver_fname, driver_lname FROM parties WHERE ride_status = 'completed'""",
    "rider_ride_history": f"""WITH {_FULL_NAMES}
SELECT a.user_id, a.ride_id, ride_status, fare, request_time, start_time, end_time, pickup_address,
  dropoff_address, driver_fname, driver_lname, driver_user_id, known_driver AS driver_id,
  driver_rating, vehicle_type, make, model, payment_status, payment_method, payment_id,
  (SELECT count(*) FROM ratings g WHERE g.ride_id = a.ride_id AND g.rated_by = a.user_id)
    AS already_rated
FROM parties a LEFT JOIN payments m ON m.ride_id = a.ride_id AND m.user_id = a.user_id""",
    "driver_rides": f"""WITH {_FULL_NAMES}
SELECT driver_id, ride_id, ride_status, fare, request_time, start_time, end_time, pickup_address,
  dropoff_address, rider_fname, rider_lname
FROM parties WHERE driver_id IS NOT NULL AND rider_id IS NOT NULL""",
    "rider_active_ride": f"""WITH {_FULL_NAMES}
SELECT {_RIDE}, pickup_address, dropoff_address, driver_fname, driver_lname, driver_phone,
  driver_user_id, driver_rating, make, model, license_plate, vehicle_type, color
FROM parties a
WHERE ride_status <> 'cancelled'
  AND (ride_status <> 'completed' OR NOT EXISTS (
    SELECT 1 FROM ratings g WHERE g.ride_id = a.ride_id AND g.rated_by = a.user_id))
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY request_time DESC, ride_id DESC) = 1""",
    "driver_active_ride": f"""WITH {_FULL_NAMES}
SELECT {_RIDE}, pickup_address, dropoff_address, rider_fname, rider_lname, rider_phone, make, model,
  license_plate, vehicle_type, color
FROM parties
WHERE driver_id IS NOT NULL AND ride_status IN ('accepted', 'driver_en_route', 'in_progress')
QUALIFY row_number() OVER (PARTITION BY driver_id ORDER BY request_time DESC, ride_id DESC) = 1""",
    "payments_with_promo": """SELECT m.*, code AS promo_code, discount_amount
FROM payments m LEFT JOIN promo_code USING (promo_id)""",
    "payment_history": f"""WITH {_FULL_NAMES}
SELECT m.*, code AS promo_code, discount_amount AS promo_discount, pickup_address, dropoff_address,
  CAST(round(amount * 0.20, 2) AS DECIMAL(18,2)) AS platform_fee
FROM payments m JOIN parties a ON a.ride_id = m.ride_id LEFT JOIN promo_code USING (promo_id)""",
    "promo_usage_report": f"""WITH {_PAID}
SELECT payment_id, ride_id, fname AS rider_fname, lname AS rider_lname, code AS promo_code,
  discount_amount, usage_count, max_uses, amount AS amount_paid, payment_method, transaction_date
FROM paid JOIN promo_code USING (promo_id) JOIN users USING (user_id)""",
    "ratings_given": f"""WITH {_FULL_NAMES}
SELECT rated_by, rating_id, score, comment, timestamp, g.ride_id, u.fname AS driver_fname,
  u.lname AS driver_lname, pickup_address, dropoff_address
FROM ratings g LEFT JOIN users u ON u.user_id = g.rated_user_id
LEFT JOIN parties a ON a.ride_id = g.ride_id""",
    "driver_ratings": """SELECT driver_id, rating_id, score, comment, timestamp,
  u.fname AS rated_by_fname, u.lname AS rated_by_lname
FROM ratings g JOIN driver d ON d.user_id = g.rated_user_id JOIN users u ON u.user_id = g.rated_by""",
    "complaints_with_pickup": """SELECT c.*, address AS pickup_address
FROM complaints c JOIN rides r ON r.ride_id = c.ride_id
LEFT JOIN location ON location_id = pickup_location_id""",
    "notifications_feed": """SELECT n.*, fname, lname
FROM admin_notifications n LEFT JOIN users ON user_id = ref_user_id
ORDER BY created_at DESC, notification_id DESC LIMIT 50""",
    "top_drivers": """SELECT driver_id, fname, lname, email, city, average_rating, total_trips,
  availability_status, verification_status
FROM driver JOIN users USING (user_id)
WHERE average_rating > 4.5 AND verification_status = 'verified'""",
    "flagged_accounts": """SELECT u.user_id, fname, lname, email, role, account_status,
  CASE WHEN d.driver_id IS NOT NULL THEN CAST(average_rating AS DOUBLE)
       ELSE (SELECT round(avg(score), 6) FROM ratings WHERE rated_user_id = u.user_id) END AS avg_rating
FROM users u LEFT JOIN driver d ON d.user_id = u.user_id WHERE account_status = 'suspended'""",
    "driver_recent_payments": f"""WITH {_FULL_NAMES}, {_PAID}
SELECT driver_id, payment_id, amount, CAST(round(amount * 0.80, 2) AS DECIMAL(18,2)) AS driver_net,
  payment_method, transaction_date, pickup_address, dropoff_address
FROM paid JOIN parties USING (ride_id) WHERE driver_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY driver_id
                           ORDER BY transaction_date DESC, payment_id DESC) <= 20""",
    # aggregates
    "platform_summary": f"""WITH {_PAID}
SELECT (SELECT count(*) FROM users) AS total_users,
  (SELECT count(*) FROM users WHERE role = 'rider') AS total_riders,
  (SELECT count(*) FROM rides) AS total_rides,
  (SELECT count(*) FROM rides WHERE ride_status = 'completed') AS completed_rides,
  (SELECT count(*) FROM rides WHERE ride_status = 'cancelled') AS cancelled_rides,
  (SELECT count(*) FROM rides WHERE ride_status IN ('requested', 'accepted', 'driver_en_route',
     'in_progress')) AS active_rides,
  (SELECT CAST(sum(amount) AS DECIMAL(38,2)) FROM paid) AS total_revenue,
  (SELECT CAST(sum(amount * 0.20) AS DECIMAL(38,4)) FROM paid) AS platform_commission,
  (SELECT CAST(sum(amount * 0.80) AS DECIMAL(38,4)) FROM paid) AS driver_payouts,
  (SELECT count(*) FROM driver) AS total_drivers,
  (SELECT count(*) FROM driver WHERE verification_status = 'verified') AS verified_drivers,
  (SELECT count(*) FROM driver WHERE verification_status = 'pending') AS pending_verification,
  (SELECT count(*) FROM driver WHERE availability_status = 'available') AS online_drivers""",
    "platform_revenue": f"""WITH {_PAID}
SELECT CAST(transaction_date AS DATE) AS date, count(*) AS total_transactions, {_SHARES},
  payment_method FROM paid GROUP BY 1, payment_method""",
    "written_report": f"""WITH {_PAID}
SELECT CAST(transaction_date AS DATE) AS date, count(*) AS total_transactions, {_SHARES},
  payment_method FROM paid GROUP BY 1, payment_method""",
    "revenue_report_range": f"""WITH {_PAID}
SELECT CAST(transaction_date AS DATE) AS date, count(*) AS total_transactions, {_SHARES},
  payment_method
FROM paid WHERE CAST(transaction_date AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1998-06-30'
GROUP BY 1, payment_method""",
    "revenue_report_last_30_days": f"""WITH {_PAID}
SELECT CAST(transaction_date AS DATE) AS date, count(*) AS total_transactions, {_SHARES},
  payment_method
FROM paid WHERE CAST(transaction_date AS DATE) BETWEEN DATE '1998-07-03' AND DATE '1998-08-02'
GROUP BY 1, payment_method""",
    "revenue_report_admin": f"""WITH {_PAID}
SELECT CAST(transaction_date AS DATE) AS date, payment_method, count(*) AS transactions,
  CAST(sum(amount) AS DECIMAL(38,2)) AS total_amount,
  CAST(sum(amount * 0.20) AS DECIMAL(38,4)) AS commission
FROM paid WHERE transaction_date BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-06-30'
GROUP BY 1, 2""",
    "revenue_report_finance": f"WITH {_PAID}, {_FINANCE} SELECT * FROM finance",
    "revenue_totals": f"""WITH {_PAID}, {_FINANCE}
SELECT CAST(sum(total_transactions) AS BIGINT) AS total_transactions,
  CAST(sum(gross_revenue) AS DECIMAL(38,2)) AS gross_revenue,
  CAST(sum(platform_commission) AS DECIMAL(38,2)) AS platform_commission,
  CAST(sum(driver_payouts) AS DECIMAL(38,2)) AS driver_payouts
FROM finance""",
    "rides_report": """SELECT CAST(request_time AS DATE) AS date, ride_status, count(*) AS count,
  round(CAST(sum(fare) AS DOUBLE) / count(fare), 6) AS avg_fare,
  CAST(sum(fare) AS DECIMAL(38,2)) AS total_fare
FROM rides WHERE request_time BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31'
GROUP BY 1, 2""",
    "driver_earnings_admin": f"""WITH {_PAID}, {_DRIVER_FANOUT}
SELECT driver_id, fname, lname, city, count(ride_id) AS total_rides,
  CAST(coalesce(sum(amount), 0) AS DECIMAL(38,2)) AS total_earned,
  CAST(coalesce(sum(amount * 0.80), 0) AS DECIMAL(38,4)) AS driver_net,
  CAST(coalesce(sum(amount * 0.20), 0) AS DECIMAL(38,4)) AS commission_paid, average_rating
FROM fanout GROUP BY driver_id, fname, lname, city, average_rating""",
    "driver_earnings_finance": f"""WITH {_PAID}, {_DRIVER_FANOUT}
SELECT driver_id, fname, lname, email, count(payment_id) AS total_rides,
  CAST(coalesce(sum(amount), 0) AS DECIMAL(38,2)) AS gross_earned,
  CAST(coalesce(round(sum(amount * 0.80), 2), 0) AS DECIMAL(38,2)) AS net_earned,
  CAST(coalesce(round(sum(amount * 0.20), 2), 0) AS DECIMAL(38,2)) AS commission_paid,
  average_rating, total_trips
FROM fanout GROUP BY driver_id, fname, lname, email, average_rating, total_trips""",
    "driver_earnings_summary": f"""WITH {_PAID}
SELECT driver_id, count(*) AS total_trips, CAST(sum(amount) AS DECIMAL(38,2)) AS gross_earned,
  CAST(round(sum(amount * 0.80), 2) AS DECIMAL(38,2)) AS net_earned,
  CAST(round(sum(amount * 0.20), 2) AS DECIMAL(38,2)) AS commission_paid
FROM paid JOIN rides USING (ride_id) WHERE driver_id IS NOT NULL GROUP BY driver_id""",
    "driver_fare_earnings": """SELECT driver_id, count(*) AS total_rides,
  CAST(sum(fare) AS DECIMAL(38,2)) AS total_fare,
  CAST(sum(fare * 0.80) AS DECIMAL(38,4)) AS driver_earnings,
  CAST(sum(fare * 0.20) AS DECIMAL(38,4)) AS platform_commission
FROM rides WHERE ride_status = 'completed' AND driver_id IS NOT NULL GROUP BY driver_id""",
    "trips_per_driver": f"""WITH {_PAID}, {_DRIVER_FANOUT}
SELECT driver_id, fname, lname, count(ride_id) AS completed_trips,
  CAST(coalesce(sum(amount), 0) AS DECIMAL(38,2)) AS total_earned
FROM fanout GROUP BY driver_id, fname, lname""",
    "driver_performance": f"""WITH {_PAID}, {_DRIVER_FANOUT}
SELECT driver_id, fname, lname, city, average_rating, total_trips, verification_status,
  availability_status, count(complaint_id) AS total_complaints,
  CAST(sum(amount * 0.80) AS DECIMAL(38,4)) AS total_earnings
FROM fanout f LEFT JOIN complaints c ON c.ride_id = f.ride_id
GROUP BY driver_id, fname, lname, city, average_rating, total_trips, verification_status,
  availability_status""",
    "driver_performance_deduped": f"""WITH {_PAID},
done AS (SELECT ride_id, driver_id FROM rides WHERE ride_status = 'completed')
SELECT d.driver_id, fname, lname, city, average_rating, total_trips, verification_status,
  availability_status,
  (SELECT count(*) FROM complaints JOIN done USING (ride_id) WHERE done.driver_id = d.driver_id)
    AS total_complaints,
  (SELECT CAST(sum(amount * 0.80) AS DECIMAL(38,4)) FROM paid JOIN done USING (ride_id)
   WHERE done.driver_id = d.driver_id) AS total_earnings
FROM driver d JOIN users USING (user_id)""",
    "revenue_by_city": f"WITH {_PAID} " + _CITY.format(where=""),
    "revenue_by_known_city": f"WITH {_PAID} " + _CITY.format(where="WHERE city IS NOT NULL"),
    "all_riders_report": _RIDERS.format(wallet=""),
    "all_riders_report_admin": _RIDERS.format(wallet="wallet_balance,"),
    "low_rated_drivers": f"""WITH {_LOW_RATED}
SELECT driver_id, fname, lname, city, round(mean_score, 6) AS avg_rating, total_ratings
FROM driver JOIN users USING (user_id) JOIN scores USING (user_id) WHERE mean_score < 3.5""",
    "low_rated_drivers_admin": f"""WITH {_LOW_RATED}
SELECT driver_id, fname, lname, email, city, round(mean_score, 6) AS avg_rating, total_ratings,
  total_trips, account_status
FROM driver JOIN users USING (user_id) JOIN scores USING (user_id) WHERE mean_score < 3.5""",
    "rider_stats": """SELECT user_id, count(*) AS total_rides,
  count(*) FILTER (ride_status = 'completed') AS completed,
  count(*) FILTER (ride_status = 'cancelled') AS cancelled,
  CAST(coalesce(sum(fare) FILTER (ride_status = 'completed'), 0) AS DECIMAL(38,2)) AS total_spent
FROM rides GROUP BY user_id""",
    "refund_totals": """SELECT
  CAST(sum(amount) FILTER (payment_status = 'refunded') AS DECIMAL(38,2)) AS total_refunded,
  CAST(sum(amount) FILTER (payment_status = 'failed') AS DECIMAL(38,2)) AS total_failed_amount,
  count(*) FILTER (payment_status = 'refunded') AS refund_count,
  count(*) FILTER (payment_status = 'failed') AS failed_count
FROM payments""",
    "refund_report": """SELECT CAST(transaction_date AS DATE) AS date, payment_status,
  count(*) AS count, CAST(sum(amount) AS DECIMAL(38,2)) AS total_amount
FROM payments WHERE payment_status IN ('refunded', 'failed')
  AND CAST(transaction_date AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1998-06-30'
GROUP BY 1, 2""",
    "dispute_totals": """SELECT
  CAST(sum(amount) FILTER (payment_status = 'refunded') AS DECIMAL(38,2)) AS total_refunded,
  count(*) FILTER (payment_status = 'failed') AS total_failed, count(*) AS total_disputes
FROM payments WHERE payment_status IN ('refunded', 'failed')""",
    "avg_rating_by_driver": """SELECT driver_id, round(avg(score), 6) AS avg_rating,
  CAST((sum(score) * 200 + count(*)) // (2 * count(*)) * 0.01 AS DECIMAL(3,2)) AS stored_rating
FROM driver JOIN ratings ON rated_user_id = user_id GROUP BY driver_id""",
    "refreshed_driver_ratings": """SELECT d.* REPLACE (coalesce(
    (SELECT CAST((sum(score) * 200 + count(*)) // (2 * count(*)) * 0.01 AS DECIMAL(3,2)) FROM ratings WHERE rated_user_id = d.user_id),
    average_rating) AS average_rating)
FROM driver d""",
    # ranked
    "payment_method_breakdown": f"""WITH {_PAID}
SELECT payment_method, count(*) AS transactions, CAST(sum(amount) AS DECIMAL(38,2)) AS total_amount,
  round(CAST(count(*) AS DOUBLE) * 100 / (SELECT count(*) FROM paid), 2) AS percentage
FROM paid GROUP BY payment_method""",
    "latest_driver_location": """SELECT * FROM driver_location
QUALIFY row_number() OVER (PARTITION BY driver_id ORDER BY timestamp DESC, location_id DESC) = 1""",
    "first_verified_vehicle": """SELECT * FROM vehicles v
WHERE vehicle_id = (SELECT min(w.vehicle_id) FROM vehicles w
                    WHERE w.driver_id = v.driver_id AND w.verification_status = 'verified')""",
    "first_verified_premium_vehicle": """SELECT * FROM vehicles v
WHERE vehicle_id = (SELECT min(w.vehicle_id) FROM vehicles w WHERE w.driver_id = v.driver_id
                    AND w.verification_status = 'verified' AND w.vehicle_type = 'premium')""",
    "ride_status_timeline": """WITH tagged AS (
  SELECT *, lag(status) OVER (PARTITION BY ride_id ORDER BY timestamp, history_id) AS previous_status
  FROM ride_history),
changes AS (SELECT * FROM tagged WHERE previous_status IS DISTINCT FROM status),
spans AS (
  SELECT *, lead(timestamp) OVER (PARTITION BY ride_id ORDER BY timestamp, history_id) AS left_at
  FROM changes)
SELECT history_id, ride_id, status, previous_status, timestamp, left_at,
  CAST(date_sub('second', timestamp, left_at) AS BIGINT) AS seconds_in_status
FROM spans""",
    "driver_leaderboard": """SELECT driver_id, fname, lname, average_rating, total_trips
FROM driver JOIN users USING (user_id) WHERE verification_status = 'verified'
ORDER BY average_rating DESC, total_trips DESC, driver_id LIMIT 20""",
}
REPORTS_SQL["all_rides_page_by_key"] = REPORTS_SQL["all_rides_page"]
