"""DuckDB queries that check distances, matching, fares, surge and promos."""

from __future__ import annotations


def _cosine(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    return f"""CAST(round(6371 * acos(greatest(-1.0, least(1.0,
  sin(radians(CAST({lat1} AS DOUBLE))) * sin(radians(CAST({lat2} AS DOUBLE)))
  + cos(radians(CAST({lat1} AS DOUBLE))) * cos(radians(CAST({lat2} AS DOUBLE)))
    * cos(radians(CAST({lng2} AS DOUBLE)) - radians(CAST({lng1} AS DOUBLE)))))), 2) AS DECIMAL(10,2))"""


_SQUARE = """(pow(sin((radians(CAST(dropoff_lat AS DOUBLE)) - radians(CAST(pickup_lat AS DOUBLE))) / 2), 2)
  + cos(radians(CAST(pickup_lat AS DOUBLE))) * cos(radians(CAST(dropoff_lat AS DOUBLE)))
  * pow(sin((radians(CAST(dropoff_lng AS DOUBLE)) - radians(CAST(pickup_lng AS DOUBLE))) / 2), 2))"""
_HAVERSINE = f"(12742 * asin(sqrt({_SQUARE})))"

_ESTIMATED = f"""
measured AS (SELECT *, CAST(round({_HAVERSINE}, 1) AS DECIMAL(10,1)) AS distance_km FROM trips),
estimated AS (
  SELECT *, CASE WHEN distance_km IS NOT NULL
                 THEN greatest(5, CAST(round(distance_km * 2.4) AS INTEGER)) END AS duration_min
  FROM measured)"""


def _quoted(demand: str) -> str:
    return f"""{_ESTIMATED},
rated AS (
  SELECT e.*, coalesce(f.base_fare, 50) AS base, coalesce(f.per_km_rate, 20) AS per_km,
         coalesce(f.per_min_rate, 2) AS per_min,
         greatest(CASE WHEN hour(requested_at) IN (7, 8, 9, 17, 18, 19, 20)
                       THEN coalesce(f.surge_peak_mult, 1.5) ELSE 1 END,
                  CASE WHEN {demand} THEN coalesce(f.surge_demand_mult, 1.8) ELSE 1 END) AS surge
  FROM estimated e LEFT JOIN fare_rules f ON f.vehicle_type = lower(trim(e.vehicle_type)))"""


_QUOTE_COLUMNS = """trip_id, distance_km, duration_min,
  CAST(CASE WHEN distance_km IS NULL THEN 300
            ELSE round((base + per_km * distance_km + per_min * duration_min) * surge, 2) END
       AS DECIMAL(18,2)) AS fare,
  CAST(CASE WHEN distance_km IS NULL THEN 1 ELSE surge END AS DECIMAL(10,2)) AS surge_multiplier,
  distance_km IS NOT NULL AND surge > 1 AS surge_applied, distance_km IS NULL AS fallback,
  CAST(CASE WHEN distance_km IS NOT NULL THEN base END AS DECIMAL(18,2)) AS base_fare,
  CAST(round(per_km * distance_km, 2) AS DECIMAL(18,2)) AS distance_cost,
  CAST(CASE WHEN distance_km IS NOT NULL THEN per_min * duration_min END AS DECIMAL(18,2)) AS time_cost"""

_BOOKABLE = """
latest AS (
  SELECT driver_id, latitude, longitude FROM driver_location
  QUALIFY row_number() OVER (PARTITION BY driver_id ORDER BY timestamp DESC, location_id DESC) = 1),
car AS (
  SELECT * FROM vehicles WHERE verification_status = 'verified' {kind}
  QUALIFY row_number() OVER (PARTITION BY driver_id ORDER BY vehicle_id) = 1),
ready AS (
  SELECT d.driver_id, fname, lname, phone_number, average_rating, d.total_trips, car.vehicle_type,
         make, model, color, license_plate, latitude AS current_lat, longitude AS current_lng
  FROM driver d JOIN users u ON u.user_id = d.user_id AND account_status = 'active'
  JOIN car ON car.driver_id = d.driver_id JOIN latest ON latest.driver_id = d.driver_id
  WHERE availability_status = 'available' AND d.verification_status = 'verified')"""


def _within(radius: int, kind: str = "") -> str:
    distance = _cosine("pickup_lat", "pickup_lng", "current_lat", "current_lng")
    return f"""WITH {_BOOKABLE.format(kind=kind)}
SELECT * FROM (
  SELECT request_id, ready.*, {distance} AS distance_km FROM open_pickups CROSS JOIN ready)
WHERE distance_km <= {radius}"""


PRICING_SQL = {
    "trip_distances": f"""SELECT trip_id, CAST({_HAVERSINE} AS DECIMAL(12,4)) AS haversine_km,
  {_cosine("pickup_lat", "pickup_lng", "dropoff_lat", "dropoff_lng")} AS cosine_km FROM trips""",
    "nearest_driver": f"""WITH latest AS (
  SELECT driver_id, latitude, longitude FROM driver_location
  QUALIFY row_number() OVER (PARTITION BY driver_id ORDER BY timestamp DESC, location_id DESC) = 1)
SELECT request_id, driver_id,
  {_cosine("pickup_lat", "pickup_lng", "latitude", "longitude")} AS distance_km
FROM open_pickups CROSS JOIN latest JOIN driver USING (driver_id)
WHERE availability_status = 'available' AND verification_status = 'verified'
QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY distance_km, driver_id) = 1""",
    "drivers_within_radius": _within(50),
    "closest_drivers": f"""SELECT *, CAST(row_number() OVER (PARTITION BY request_id
    ORDER BY distance_km, average_rating DESC NULLS LAST, driver_id) AS INTEGER) AS place
FROM ({_within(50)}) QUALIFY place <= 5""",
    "premium_drivers_within_10_km": _within(10, "AND vehicle_type = 'premium'"),
    "trip_estimate": f"WITH {_ESTIMATED} SELECT trip_id, distance_km, duration_min FROM estimated",
    "fare_quote": f"""WITH {_quoted("(SELECT count(*) FROM rides WHERE ride_status = 'requested') > 10")}
SELECT {_QUOTE_COLUMNS} FROM rated""",
    "default_fare": f"""WITH {_quoted("false")}
SELECT trip_id, CAST(CASE lower(vehicle_type) WHEN 'bike' THEN 80 WHEN 'premium' THEN 350 ELSE 200 END
    AS DECIMAL(10,2)) AS booking_fare,
  CAST(CASE WHEN distance_km IS NULL THEN 300
            ELSE round((base + per_km * distance_km + per_min * duration_min) * surge, 2) END
       AS DECIMAL(18,2)) AS fare, distance_km IS NULL AS fallback
FROM rated""",
    "fare_breakdown": f"""WITH {_quoted("false")}
SELECT trip_id, base_fare, distance_cost, time_cost FROM (SELECT {_QUOTE_COLUMNS} FROM rated)""",
    "peak_surge": """SELECT trip_id, h IN (7, 8, 9, 17, 18, 19, 20) AS is_peak,
  CAST(CASE WHEN h IN (7, 8, 9, 17, 18, 19, 20) THEN coalesce(surge_peak_mult, 1.5) ELSE 1 END
       AS DECIMAL(10,2)) AS surge_multiplier
FROM (SELECT *, hour(requested_at + INTERVAL '5' HOUR) AS h FROM trips) z
LEFT JOIN fare_rules f ON f.vehicle_type = lower(z.vehicle_type)""",
    "demand_surge": """SELECT count(*) AS pending_requests, count(*) > 10 AS high_demand
FROM rides WHERE ride_status = 'requested'""",
    "demand_history": """WITH tagged AS (
  SELECT *, lag(status) OVER (PARTITION BY ride_id ORDER BY timestamp, history_id) AS before
  FROM ride_history),
placed AS (
  SELECT history_id, ride_id, lower(city) AS city, t.timestamp,
         CAST(status = 'requested' AS INTEGER)
           - CAST(coalesce(before = 'requested', false) AS INTEGER) AS step
  FROM tagged t JOIN rides USING (ride_id) JOIN location ON location_id = pickup_location_id),
summed AS (
  SELECT *, sum(step) OVER (PARTITION BY city ORDER BY timestamp, history_id) AS pending FROM placed)
SELECT history_id, ride_id, city, timestamp, CAST(pending AS BIGINT) AS pending,
  pending > 3 AS high_demand
FROM summed WHERE step = 1""",
    "demand_at_trips": """WITH tagged AS (
  SELECT *, lag(status) OVER (PARTITION BY ride_id ORDER BY timestamp, history_id) AS before
  FROM ride_history),
placed AS (
  SELECT lower(city) AS place, t.timestamp,
         CAST(status = 'requested' AS INTEGER)
           - CAST(coalesce(before = 'requested', false) AS INTEGER) AS step
  FROM tagged t JOIN rides USING (ride_id) JOIN location ON location_id = pickup_location_id),
counted AS (
  SELECT trip_id, lower(city) AS city, requested_at,
    (SELECT CAST(coalesce(sum(step), 0) AS BIGINT) FROM placed
     WHERE place IS NOT DISTINCT FROM lower(c.city) AND timestamp <= c.requested_at) AS pending
  FROM city_trips c)
SELECT *, pending > 3 AS high_demand FROM counted""",
    "resolve_addresses": """WITH known AS (
  SELECT lower(trim(address)) AS place, latitude, longitude FROM location
  QUALIFY row_number() OVER (PARTITION BY place ORDER BY location_id) = 1)
SELECT trip_id, requested_at, vehicle_type, pickup_address, dropoff_address, a.latitude AS pickup_lat,
  a.longitude AS pickup_lng, b.latitude AS dropoff_lat, b.longitude AS dropoff_lng
FROM addressed_trips LEFT JOIN known a ON a.place = lower(trim(pickup_address))
LEFT JOIN known b ON b.place = lower(trim(dropoff_address))""",
    "apply_promo": """SELECT ride_id, f.fare, f.promo_code, promo_id,
  CAST(coalesce(discount_amount, 0) AS DECIMAL(18,2)) AS discount_applied,
  CAST(CASE WHEN f.promo_code <> '' AND promo_id IS NULL THEN NULL
            ELSE greatest(0, f.fare - coalesce(discount_amount, 0)) END AS DECIMAL(18,2)) AS final_fare,
  CASE WHEN f.promo_code <> '' AND promo_id IS NULL THEN 'invalid_promo' END AS reject_reason
FROM promo_fares f
LEFT JOIN promo_code p ON lower(p.code) = lower(f.promo_code) AND expiry_date >= DATE '1998-08-02'""",
    "apply_promo_or_ignore": """SELECT ride_id, f.fare, f.promo_code, promo_id,
  CAST(coalesce(discount_amount, 0) AS DECIMAL(18,2)) AS discount_applied,
  CAST(greatest(0, f.fare - coalesce(discount_amount, 0)) AS DECIMAL(18,2)) AS final_fare,
  CAST(NULL AS VARCHAR) AS reject_reason
FROM promo_fares f
LEFT JOIN promo_code p ON lower(p.code) = lower(f.promo_code) AND expiry_date >= DATE '1998-08-02'""",
    "commission_split": """SELECT payment_id, amount,
  CAST(round(amount * 0.20, 2) AS DECIMAL(18,2)) AS platform_commission,
  CAST(round(amount * 0.80, 2) AS DECIMAL(18,2)) AS driver_net FROM payments""",
}
