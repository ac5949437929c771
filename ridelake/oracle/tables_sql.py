"""DuckDB definitions of the ride tables, used to check results against a second engine."""

from __future__ import annotations

import re

RIDE_TABLES_SQL = {
    "users": """
SELECT c_custkey AS user_id, c_mktsegment AS fname, c_name AS lname,
       'rider' || c_custkey || '@example.com' AS email,
       '03' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS phone_number, 'rider' AS role,
       CASE WHEN c_custkey % 20 = 0 THEN 'suspended' WHEN c_custkey % 20 = 1 THEN 'inactive'
            ELSE 'active' END AS account_status,
       CAST(c_acctbal AS DECIMAL(10,2)) AS wallet_balance,
       CASE WHEN c_custkey % 25 <> 0 THEN n_name END AS city,
       TIMESTAMP '1995-01-01' + to_days(CAST(c_custkey % 365 AS INTEGER)) AS registration_date
FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL
SELECT 10000000 + s_suppkey, 'Driver', s_name, 'driver' || s_suppkey || '@example.com',
       '04' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0'), 'driver',
       CASE WHEN s_suppkey % 10 = 9 THEN 'suspended' ELSE 'active' END,
       CAST(s_acctbal AS DECIMAL(10,2)), n_name,
       TIMESTAMP '1994-01-01' + to_days(CAST(s_suppkey % 365 AS INTEGER))
FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL
SELECT CAST(20000000 + r_regionkey AS BIGINT), 'Admin', r_name,
       'admin' || r_regionkey || '@example.com',
       '05' || lpad(CAST(r_regionkey AS VARCHAR), 9, '0'), 'admin', 'active',
       CAST(0 AS DECIMAL(10,2)), NULL, TIMESTAMP '1993-01-01'
FROM region""",
    "driver": """
SELECT s_suppkey AS driver_id, 10000000 + s_suppkey AS user_id,
       lpad(CAST(s_suppkey AS VARCHAR), 13, '0') AS cnic, 'LIC-' || s_suppkey AS license_number,
       CASE WHEN s_suppkey % 4 <> 0 THEN 'photos/' || s_suppkey || '.jpg' END AS profile_photo,
       CASE WHEN s_suppkey % 10 = 0 THEN 'pending' WHEN s_suppkey % 10 = 1 THEN 'rejected'
            ELSE 'verified' END AS verification_status,
       CASE WHEN s_suppkey % 3 = 0 THEN 'available' WHEN s_suppkey % 3 = 1 THEN 'busy'
            ELSE 'offline' END AS availability_status,
       CAST((250 + (s_suppkey * 37) % 251) * 0.01 AS DECIMAL(3,2)) AS average_rating,
       CAST((s_suppkey * 13) % 40 AS INTEGER) AS total_trips
FROM supplier""",
    "vehicles": """
SELECT p_partkey AS vehicle_id, p_partkey % (SELECT count(*) FROM supplier) AS driver_id,
       'LP-' || p_partkey AS license_plate, p_brand AS make, p_name AS model,
       2000 + p_size % 25 AS year,
       CASE p_partkey % 4 WHEN 0 THEN 'White' WHEN 1 THEN 'Silver' WHEN 2 THEN 'Black'
            ELSE 'Red' END AS color,
       CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'economy'
            WHEN p_type IN ('LARGE', 'PROMO') THEN 'premium' ELSE 'bike' END AS vehicle_type,
       CASE WHEN p_size % 5 = 0 THEN 'pending' WHEN p_size % 5 = 1 THEN 'rejected'
            ELSE 'verified' END AS verification_status,
       CAST(p_partkey % 50 AS INTEGER) AS total_trips
FROM part""",
    "rides": """
SELECT ride_id, user_id, driver_id, vehicle_id, ride_id * 2 AS pickup_location_id,
       ride_id * 2 + 1 AS dropoff_location_id, request_time,
       CASE WHEN ride_id % 17 = 0 THEN request_time + to_days(1) END AS scheduled_time,
       CASE WHEN ride_status = 'completed' THEN request_time + to_minutes(5) END AS start_time,
       CASE WHEN ride_status = 'completed'
            THEN request_time + to_minutes(10 + ride_id % 55) + to_seconds(ride_id % 60)
       END AS end_time,
       ride_status, fare
FROM (
  SELECT o_orderkey AS ride_id, CASE WHEN o_custkey % 10 = 9 THEN o_custkey - 1 ELSE o_custkey END AS user_id,
         CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey * 7) % (SELECT count(*) FROM supplier) END
           AS driver_id,
         CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % (SELECT count(*) FROM part) END
           AS vehicle_id,
         o_orderdate + to_minutes((o_orderkey * 37) % 1440) AS request_time,
         CASE WHEN o_orderstatus = 'F' THEN 'completed'
              WHEN o_orderstatus = 'P' THEN
                CASE WHEN o_orderkey % 2 = 0 THEN 'completed' ELSE 'cancelled' END
              WHEN o_orderpriority LIKE '1%' THEN 'requested'
              WHEN o_orderpriority LIKE '2%' THEN 'accepted'
              WHEN o_orderpriority LIKE '3%' THEN 'driver_en_route'
              WHEN o_orderpriority LIKE '4%' THEN 'in_progress'
              ELSE 'rejected_by_driver' END AS ride_status,
         CAST(o_totalprice AS DECIMAL(10,2)) AS fare
  FROM orders)""",
    "location": """
SELECT location_id, CAST(24.8 + (k * 31 % 1000) * 0.0004 AS DECIMAL(10,7)) AS latitude,
       CAST(66.9 + (k * 17 % 1000) * 0.0004 AS DECIMAL(10,7)) AS longitude, address,
       CASE WHEN NOT hide THEN n_name END AS city
FROM (
  SELECT o_orderkey * 2 AS location_id, o_orderkey AS k, 'P' || o_orderkey AS address,
         o_orderkey % 25 AS city_key, o_orderkey % 10 = 0 AS hide
  FROM orders
  UNION ALL
  SELECT o_orderkey * 2 + 1, o_orderkey * 3 + 1, 'D' || o_orderkey, (o_orderkey * 3) % 25, false
  FROM orders)
JOIN nation ON city_key = n_nationkey""",
    "ride_lines": """
SELECT l_orderkey AS ride_id, l_extendedprice AS price, l_suppkey AS suppkey, l_returnflag AS returnflag,
       l_linestatus AS linestatus, l_shipdate AS shipdate,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber NULLS FIRST, l_shipdate NULLS FIRST,
         l_extendedprice NULLS FIRST, l_suppkey NULLS FIRST, l_returnflag NULLS FIRST,
         l_linestatus NULLS FIRST) AS n
FROM lineitem""",
    "payments": """
SELECT ride_id * 1009 + n AS payment_id, ride_id, user_id,
       CAST(price AS DECIMAL(10,2)) AS amount,
       CASE suppkey % 3 WHEN 0 THEN 'cash' WHEN 1 THEN 'card' ELSE 'wallet' END AS payment_method,
       CASE returnflag WHEN 'A' THEN 'paid'
            WHEN 'N' THEN CASE WHEN linestatus = 'F' THEN 'paid' ELSE 'pending' END
            ELSE CASE WHEN linestatus = 'F' THEN 'refunded' ELSE 'failed' END END AS payment_status,
       shipdate + to_minutes((ride_id * 53) % 1440) AS transaction_date,
       CASE WHEN n = 1 THEN 1 + ride_id % (SELECT count(*) FROM part) END AS promo_id
FROM ride_lines JOIN rides USING (ride_id)""",
    "ratings": """
SELECT ride_id * 10 + CASE WHEN odd THEN 1 ELSE 2 END AS rating_id, ride_id,
       CASE WHEN odd THEN user_id ELSE 10000000 + driver_id END AS rated_by,
       CASE WHEN odd THEN 10000000 + driver_id ELSE user_id END AS rated_user_id,
       CAST(CASE WHEN driver_id % 4 = 2 THEN 1 + CAST(quantity AS INTEGER) % 4
                 ELSE 3 + CAST(quantity AS INTEGER) % 3 END AS INTEGER) AS score,
       CASE WHEN ride_id % 3 = 0 THEN 'Comment on ride ' || ride_id END AS comment,
       shipdate AS timestamp
FROM (
  SELECT l_orderkey AS ride_id, l_linenumber % 2 = 1 AS odd, max(l_shipdate) AS shipdate, min(l_quantity) AS quantity
  FROM lineitem GROUP BY 1, 2)
JOIN rides USING (ride_id)
WHERE ride_status = 'completed' AND driver_id IS NOT NULL""",
    "complaints": """
SELECT ride_id * 10 + k AS complaint_id, ride_id, user_id,
       'Complaint ' || k || ' on ride ' || ride_id AS description,
       CASE (ride_id + k) % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'resolved' ELSE 'closed' END AS status,
       request_time + to_days(1) + to_hours(k) AS timestamp
FROM rides, (VALUES (0), (1)) AS copies(k)
WHERE ride_id % 13 = 0 AND (k = 0 OR ride_id % 39 = 0)""",
    "driver_location": """
SELECT event_id AS location_id, user_id % (SELECT count(*) FROM supplier) AS driver_id,
       CAST(24.8 + (event_id * 31 % 1000) * 0.0004 AS DECIMAL(10,7)) AS latitude,
       CAST(66.9 + (event_id * 17 % 1000) * 0.0004 AS DECIMAL(10,7)) AS longitude,
       ts AS timestamp
FROM events""",
    "ride_history": """
SELECT event_id AS history_id, user_id AS ride_id,
       CASE event_type WHEN 'signup' THEN 'requested' WHEN 'click' THEN 'accepted'
            WHEN 'view' THEN 'in_progress' WHEN 'purchase' THEN 'completed'
            ELSE 'cancelled' END AS status, ts AS timestamp
FROM events""",
    "fare_rules": """
SELECT rule_id, vehicle_type, CAST(base_fare AS DECIMAL(10,2)) AS base_fare,
       CAST(per_km_rate AS DECIMAL(10,2)) AS per_km_rate,
       CAST(per_min_rate AS DECIMAL(10,2)) AS per_min_rate,
       CAST(surge_peak_mult AS DECIMAL(4,2)) AS surge_peak_mult,
       CAST(surge_demand_mult AS DECIMAL(4,2)) AS surge_demand_mult, TIMESTAMP '1995-01-01' AS updated_at
FROM (VALUES
  (1, 'economy', 50, 20, 2, 1.5, 1.8),
  (2, 'premium', 100, 40, 4, 1.5, 1.8),
  (3, 'bike', 30, 12, 1, 1.5, 1.8)
) AS rules(rule_id, vehicle_type, base_fare, per_km_rate, per_min_rate, surge_peak_mult,
           surge_demand_mult)
WHERE vehicle_type IN (SELECT vehicle_type FROM vehicles)""",
    "promo_code": """
SELECT p_partkey + 1 AS promo_id, 'PROMO' || (p_partkey + 1) AS code,
       CAST(5 + p_size AS DECIMAL(10,2)) AS discount_amount,
       CAST(DATE '1997-06-01' + to_days(CAST((p_partkey * 7) % 1000 AS INTEGER)) AS DATE)
         AS expiry_date,
       CAST(p_partkey % 7 AS INTEGER) AS usage_count,
       CASE WHEN p_partkey % 3 = 0 THEN 5 END AS max_uses
FROM part""",
    "admin_notifications": """
SELECT rating_id AS notification_id, 'low_driver_rating' AS type,
       'Driver user_id=' || rated_user_id || ' has average rating '
         || CAST(score AS DECIMAL(3,2))
         || ' (below 3.5). Account suspended for review.' AS message,
       rated_user_id AS ref_user_id, rating_id % 4 = 1 AS is_read, timestamp AS created_at
FROM ratings WHERE score < 3 AND rated_user_id >= 10000000""",
    "driver_payouts": """
SELECT payout_id, driver_id, CAST(round(gross * 0.80, 2) AS DECIMAL(18,2)) AS amount,
       CASE payout_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'failed'
            ELSE 'paid' END AS status,
       period_end - 7 AS period_start, period_end,
       CASE WHEN payout_id % 5 = 2 THEN 'bank rejected' END AS notes,
       CAST(period_end AS TIMESTAMP) AS requested_at,
       CASE WHEN payout_id % 5 > 2 THEN CAST(period_end AS TIMESTAMP) + to_days(2) END
         AS processed_at
FROM (
  SELECT driver_id * 100000 + week AS payout_id, driver_id, gross,
         DATE '1990-01-01' + CAST(week * 7 + 7 AS INTEGER) AS period_end
  FROM (
    SELECT driver_id, (CAST(transaction_date AS DATE) - DATE '1990-01-01') // 7 AS week,
           sum(amount) AS gross
    FROM payments JOIN rides USING (ride_id)
    WHERE payment_status = 'paid' AND driver_id IS NOT NULL GROUP BY 1, 2))""",
}


def with_ride_tables(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the table definitions it uses, directly or through others."""
    definitions = {**RIDE_TABLES_SQL, **(extra or {})}
    needed: list[str] = []

    def visit(sql: str, own: str | None = None) -> None:
        for name in definitions:
            if name != own and name not in needed and re.search(rf"\b{name}\b", sql):
                visit(definitions[name], name)
                if name not in needed:
                    needed.append(name)

    visit(body)
    ctes = ",\n".join(f"{name} AS ({definitions[name].strip()})" for name in needed)
    text = body.strip()
    keyword = "WITH"
    for start in ("WITH RECURSIVE ", "WITH "):
        if text.upper().startswith(start):
            keyword = start.strip()
            text = text[len(start):]
            return f"{keyword} {ctes},\n{text}" if ctes else f"{keyword} {text}"
    return f"{keyword} {ctes}\n{text}" if ctes else text
