"""Table schemas, enum domains and money constants of the ride-hailing model."""

from __future__ import annotations

from decimal import Decimal
from functools import cache

from pyspark.sql import types as T

# The column layout of the 14 tables.
SCHEMAS = {
    "users": """user_id BIGINT, fname STRING, lname STRING, email STRING, phone_number STRING,
        role STRING, account_status STRING, wallet_balance DECIMAL(10,2), city STRING,
        registration_date TIMESTAMP_NTZ""",
    "driver": """driver_id BIGINT, user_id BIGINT, cnic STRING, license_number STRING,
        profile_photo STRING, verification_status STRING, availability_status STRING,
        average_rating DECIMAL(3,2), total_trips INT""",
    "vehicles": """vehicle_id BIGINT, driver_id BIGINT, license_plate STRING, make STRING,
        model STRING, year INT, color STRING, vehicle_type STRING, verification_status STRING,
        total_trips INT""",
    "location": """location_id BIGINT, latitude DECIMAL(10,7), longitude DECIMAL(10,7),
        address STRING, city STRING""",
    "driver_location": """location_id BIGINT, driver_id BIGINT, latitude DECIMAL(10,7),
        longitude DECIMAL(10,7), timestamp TIMESTAMP_NTZ""",
    "fare_rules": """rule_id INT, vehicle_type STRING, base_fare DECIMAL(10,2),
        per_km_rate DECIMAL(10,2), per_min_rate DECIMAL(10,2), surge_peak_mult DECIMAL(4,2),
        surge_demand_mult DECIMAL(4,2), updated_at TIMESTAMP_NTZ""",
    "promo_code": """promo_id BIGINT, code STRING, discount_amount DECIMAL(10,2),
        expiry_date DATE, usage_count INT, max_uses INT""",
    "rides": """ride_id BIGINT, user_id BIGINT, driver_id BIGINT, vehicle_id BIGINT,
        pickup_location_id BIGINT, dropoff_location_id BIGINT, request_time TIMESTAMP_NTZ,
        scheduled_time TIMESTAMP_NTZ, start_time TIMESTAMP_NTZ, end_time TIMESTAMP_NTZ,
        ride_status STRING, fare DECIMAL(10,2)""",
    "ride_history": "history_id BIGINT, ride_id BIGINT, status STRING, timestamp TIMESTAMP_NTZ",
    "payments": """payment_id BIGINT, ride_id BIGINT, user_id BIGINT, amount DECIMAL(10,2),
        payment_method STRING, payment_status STRING, transaction_date TIMESTAMP_NTZ,
        promo_id BIGINT""",
    "ratings": """rating_id BIGINT, ride_id BIGINT, rated_by BIGINT, rated_user_id BIGINT,
        score INT, comment STRING, timestamp TIMESTAMP_NTZ""",
    "complaints": """complaint_id BIGINT, ride_id BIGINT, user_id BIGINT, description STRING,
        status STRING, timestamp TIMESTAMP_NTZ""",
    "admin_notifications": """notification_id BIGINT, type STRING, message STRING,
        ref_user_id BIGINT, is_read BOOLEAN, created_at TIMESTAMP_NTZ""",
    "driver_payouts": """payout_id BIGINT, driver_id BIGINT, amount DECIMAL(18,2), status STRING,
        period_start DATE, period_end DATE, notes STRING, requested_at TIMESTAMP_NTZ,
        processed_at TIMESTAMP_NTZ""",
}
TABLES = tuple(SCHEMAS)


@cache
def table_schema(name: str) -> T.StructType:
    """Parsed schema of a table; needs a running session."""
    return T.StructType.fromDDL(SCHEMAS[name])


# Enum domains. Their order is the sort order of the column.
ROLES = ("rider", "driver", "admin")
ACCOUNT_STATUSES = ("active", "inactive", "suspended")
VERIFICATION_STATUSES = ("pending", "verified", "rejected")
AVAILABILITY_STATUSES = ("available", "busy", "offline")
VEHICLE_TYPES = ("economy", "premium", "bike")
RIDE_STATUSES = (
    "requested", "accepted", "driver_en_route", "in_progress", "completed", "cancelled",
    "rejected_by_driver",
)
PAYMENT_METHODS = ("cash", "card", "wallet")
PAYMENT_STATUSES = ("pending", "paid", "failed", "refunded")
COMPLAINT_STATUSES = ("open", "resolved", "closed")

# Status groups.
ACTIVE_RIDE_STATUSES = ("requested", "accepted", "driver_en_route", "in_progress")
DRIVER_BUSY_STATUSES = ("accepted", "driver_en_route", "in_progress")

# Money, rating and geo constants.
COMMISSION = Decimal("0.20")
DRIVER_SHARE = Decimal("0.80")
LOW_DRIVER_RATING = Decimal("3.5")
LOW_RIDER_RATING = Decimal("3.0")
TOP_DRIVER_RATING = Decimal("4.5")
MIN_TRIPS_TO_FLAG = 5
EARTH_RADIUS_KM = 6371
MATCH_RADIUS_KM = 50
CITY_SPEED_KMH = 25
MIN_TRIP_MINUTES = 5
DEMAND_THRESHOLD = 10
PEAK_HOURS = (7, 8, 9, 17, 18, 19, 20)
FALLBACK_FARE = Decimal("300")
PAYOUT_DAYS = 7
REPORT_DAYS = 30
PAGE_SIZE = 50
TOP_K = 20

# Seed fare rules (base, per km, per minute, peak and demand multipliers).
SEED_FARE_RULES = {
    "economy": ("50.00", "20.00", "2.00", "1.50", "1.80"),
    "premium": ("100.00", "40.00", "4.00", "1.50", "1.80"),
    "bike": ("30.00", "12.00", "1.00", "1.50", "1.80"),
}
DEFAULT_VEHICLE_TYPE = "economy"

# Flat booking estimates.
BOOKING_FARE = {"bike": "80", "economy": "200", "premium": "350"}
