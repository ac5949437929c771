"""Derive the ride tables from the star-schema test tables.

Every expression is integer or exact-decimal arithmetic so that another SQL engine builds the
same rows. Row counts used as moduli are scalar subqueries, not joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridelake.functions.text import low_rating_message
from ridelake.schema import SEED_FARE_RULES, VEHICLE_TYPES
from ridelake.sources.tables import RideTables

# Layout of the star-schema tables used here.
BASE_SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": """c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE,
        c_mktsegment STRING""",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": """p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT,
        p_retailprice DOUBLE""",
    "orders": """o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,
        o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING""",
    "lineitem": """l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT,
        l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE,
        l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ""",
    "events": """event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING,
        value DOUBLE, props STRING""",
}
# Every tenth customer rides under the account of the one before, so some riders have no ride.
RIDER = "CASE WHEN o_custkey % 10 = 9 THEN o_custkey - 1 ELSE o_custkey END AS user_id"
DRIVER_USER_BASE = 10_000_000
ADMIN_USER_BASE = 20_000_000


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(BASE_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


LINES_PER_TASK = 500_000  # sorted with an order's rows beside them, some 300 MB


def spread(rows: DataFrame, key: str, per_task: int | None = None) -> DataFrame:
    """``rows`` dealt by ``key`` so that a task sorts ``per_task`` of them, however many there are.

    Spark joins small partitions together by their compressed bytes; rows that compress well would make tasks that
    take several GB. Where there are few rows for each core, Spark's own choice stays.
    """
    spark, per_task = rows.sparkSession, per_task or LINES_PER_TASK
    tasks = -(-rows.count() // per_task)  # from the files' footers
    if tasks <= spark.sparkContext.defaultParallelism:
        return rows
    return rows.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def _minutes(column: str):
    return f"make_dt_interval(0, 0, CAST({column} AS INT), 0)"


def _days(column: str):
    return f"make_dt_interval(CAST({column} AS INT), 0, 0, 0)"


def _coordinate(key: str) -> list[str]:
    return [
        f"CAST(24.8 + (({key}) * 31 % 1000) * 0.0004 AS DECIMAL(10,7)) AS latitude",
        f"CAST(66.9 + (({key}) * 17 % 1000) * 0.0004 AS DECIMAL(10,7)) AS longitude",
    ]


def ride_tables(spark: SparkSession, sf_dir: str) -> RideTables:
    """Lazy ride tables over ``sf_dir``."""

    def base(name: str) -> DataFrame:
        return base_table(spark, sf_dir, name)

    def row_count(name: str):
        return base(name).agg(F.count(F.lit(1))).scalar()

    def users(_t):
        nation = base("nation").select("n_nationkey", "n_name")
        riders = base("customer").join(nation, F.expr("c_nationkey = n_nationkey")).selectExpr(
            "c_custkey AS user_id",
            "c_mktsegment AS fname",
            "c_name AS lname",
            "concat('rider', c_custkey, '@example.com') AS email",
            "concat('03', lpad(CAST(c_custkey AS STRING), 9, '0')) AS phone_number",
            "'rider' AS role",
            """CASE c_custkey % 20 WHEN 0 THEN 'suspended' WHEN 1 THEN 'inactive'
               ELSE 'active' END AS account_status""",
            "CAST(c_acctbal AS DECIMAL(10,2)) AS wallet_balance",
            "CASE WHEN c_custkey % 25 <> 0 THEN n_name END AS city",
            f"TIMESTAMP_NTZ'1995-01-01' + {_days('c_custkey % 365')} AS registration_date",
        )
        drivers = base("supplier").join(nation, F.expr("s_nationkey = n_nationkey")).selectExpr(
            f"{DRIVER_USER_BASE} + s_suppkey AS user_id",
            "'Driver' AS fname",
            "s_name AS lname",
            "concat('driver', s_suppkey, '@example.com') AS email",
            "concat('04', lpad(CAST(s_suppkey AS STRING), 9, '0')) AS phone_number",
            "'driver' AS role",
            "CASE WHEN s_suppkey % 10 = 9 THEN 'suspended' ELSE 'active' END AS account_status",
            "CAST(s_acctbal AS DECIMAL(10,2)) AS wallet_balance",
            "n_name AS city",
            f"TIMESTAMP_NTZ'1994-01-01' + {_days('s_suppkey % 365')} AS registration_date",
        )
        admins = base("region").selectExpr(
            f"CAST({ADMIN_USER_BASE} + r_regionkey AS BIGINT) AS user_id",
            "'Admin' AS fname",
            "r_name AS lname",
            "concat('admin', r_regionkey, '@example.com') AS email",
            "concat('05', lpad(CAST(r_regionkey AS STRING), 9, '0')) AS phone_number",
            "'admin' AS role",
            "'active' AS account_status",
            "CAST(0 AS DECIMAL(10,2)) AS wallet_balance",
            "CAST(NULL AS STRING) AS city",
            "TIMESTAMP_NTZ'1993-01-01' AS registration_date",
        )
        return riders.unionByName(drivers).unionByName(admins)

    def driver(_t):
        return base("supplier").selectExpr(
            "s_suppkey AS driver_id",
            f"{DRIVER_USER_BASE} + s_suppkey AS user_id",
            "lpad(CAST(s_suppkey AS STRING), 13, '0') AS cnic",
            "concat('LIC-', s_suppkey) AS license_number",
            "CASE WHEN s_suppkey % 4 <> 0 THEN concat('photos/', s_suppkey, '.jpg') END AS profile_photo",
            """CASE s_suppkey % 10 WHEN 0 THEN 'pending' WHEN 1 THEN 'rejected'
               ELSE 'verified' END AS verification_status""",
            """CASE s_suppkey % 3 WHEN 0 THEN 'available' WHEN 1 THEN 'busy'
               ELSE 'offline' END AS availability_status""",
            "CAST((250 + (s_suppkey * 37) % 251) * 0.01 AS DECIMAL(3,2)) AS average_rating",
            "CAST((s_suppkey * 13) % 40 AS INT) AS total_trips",
        )

    def vehicles(_t):
        return (
            base("part")
            .withColumn("ns", row_count("supplier"))
            .selectExpr(
                "p_partkey AS vehicle_id",
                "p_partkey % ns AS driver_id",
                "concat('LP-', p_partkey) AS license_plate",
                "p_brand AS make",
                "p_name AS model",
                "2000 + p_size % 25 AS year",
                """CASE p_partkey % 4 WHEN 0 THEN 'White' WHEN 1 THEN 'Silver' WHEN 2 THEN 'Black'
                   ELSE 'Red' END AS color""",
                """CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'economy'
                   WHEN p_type IN ('LARGE', 'PROMO') THEN 'premium' ELSE 'bike' END AS vehicle_type""",
                """CASE p_size % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'rejected'
                   ELSE 'verified' END AS verification_status""",
                "CAST(p_partkey % 50 AS INT) AS total_trips",
            )
        )

    def rides(_t):
        requested = (
            base("orders")
            .withColumn("request_time", F.expr(f"o_orderdate + {_minutes('(o_orderkey * 37) % 1440')}"))
            .withColumn(
                "ride_status",
                F.expr(
                    """CASE WHEN o_orderstatus = 'F' THEN 'completed'
                       WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 'completed'
                       WHEN o_orderstatus = 'P' THEN 'cancelled'
                       ELSE CASE substr(o_orderpriority, 1, 1)
                         WHEN '1' THEN 'requested' WHEN '2' THEN 'accepted'
                         WHEN '3' THEN 'driver_en_route' WHEN '4' THEN 'in_progress'
                         ELSE 'rejected_by_driver' END END"""
                ),
            )
            .withColumn("ns", row_count("supplier"))
            .withColumn("np", row_count("part"))
        )
        start = f"request_time + {_minutes('5')}"
        ride_span = "make_dt_interval(0, 0, CAST(10 + o_orderkey % 55 AS INT), o_orderkey % 60)"
        return requested.selectExpr(
            "o_orderkey AS ride_id",
            RIDER,
            "CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey * 7) % ns END AS driver_id",
            "CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey % np END AS vehicle_id",
            "o_orderkey * 2 AS pickup_location_id",
            "o_orderkey * 2 + 1 AS dropoff_location_id",
            "request_time",
            f"CASE WHEN o_orderkey % 17 = 0 THEN request_time + {_days('1')} END AS scheduled_time",
            f"CASE WHEN ride_status = 'completed' THEN {start} END AS start_time",
            f"CASE WHEN ride_status = 'completed' THEN request_time + {ride_span} END AS end_time",
            "ride_status",
            "CAST(o_totalprice AS DECIMAL(10,2)) AS fare",
        )

    def location(_t):
        # One scan of the orders, two rows out of each, instead of a union of two scans.
        points = (
            base("orders")
            .selectExpr(
                """inline(array(
                     named_struct('location_id', o_orderkey * 2, 'k', o_orderkey,
                       'address', concat('P', o_orderkey), 'city_key', o_orderkey % 25,
                       'hide', o_orderkey % 10 = 0),
                     named_struct('location_id', o_orderkey * 2 + 1, 'k', o_orderkey * 3 + 1,
                       'address', concat('D', o_orderkey), 'city_key', (o_orderkey * 3) % 25,
                       'hide', false)))"""
            )
        )
        nation = base("nation").select("n_nationkey", "n_name")
        return points.join(nation, F.expr("city_key = n_nationkey")).selectExpr(
            "location_id", *_coordinate("k"), "address", "CASE WHEN NOT hide THEN n_name END AS city"
        )

    def payments(_t):
        """One payment per line item; lines of an order are numbered for the id, by all columns used here."""
        in_order = Window.partitionBy("l_orderkey").orderBy(
            "l_linenumber", "l_shipdate", "l_extendedprice", "l_suppkey", "l_returnflag", "l_linestatus"
        )
        riders = base("orders").selectExpr("o_orderkey", RIDER).withColumn("np", row_count("part"))
        numbered = spread(base("lineitem"), "l_orderkey").withColumn("n", F.row_number().over(in_order))
        return numbered.join(riders, F.expr("l_orderkey = o_orderkey")).selectExpr(
            "l_orderkey * 1009 + n AS payment_id",
            "l_orderkey AS ride_id",
            "user_id",
            "CAST(l_extendedprice AS DECIMAL(10,2)) AS amount",
            "CASE l_suppkey % 3 WHEN 0 THEN 'cash' WHEN 1 THEN 'card' ELSE 'wallet' END AS payment_method",
            """CASE WHEN l_returnflag = 'A' THEN 'paid'
               WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'paid'
               WHEN l_returnflag = 'N' THEN 'pending'
               WHEN l_linestatus = 'F' THEN 'refunded' ELSE 'failed' END AS payment_status""",
            f"l_shipdate + {_minutes('(l_orderkey * 53) % 1440')} AS transaction_date",
            "CASE WHEN n = 1 THEN 1 + l_orderkey % np END AS promo_id",
        )

    def ratings(t):
        """One rating per side of a completed ride: odd line items make the rider's, even ones the driver's."""
        done = t["rides"].where("ride_status = 'completed' AND driver_id IS NOT NULL").select(
            "ride_id", "user_id", "driver_id"
        )
        sides = base("lineitem").groupBy("l_orderkey", F.expr("l_linenumber % 2 = 1").alias("by_rider")).agg(
            F.max("l_shipdate").alias("shipdate"), F.min("l_quantity").alias("quantity")
        )
        return (
            sides.join(done, F.expr("l_orderkey = ride_id"))
            .withColumn("driver_user", F.col("driver_id") + DRIVER_USER_BASE)
            .selectExpr(
                "l_orderkey * 10 + if(by_rider, 1, 2) AS rating_id",
                "ride_id",
                "CASE WHEN by_rider THEN user_id ELSE driver_user END AS rated_by",
                "CASE WHEN by_rider THEN driver_user ELSE user_id END AS rated_user_id",
                """CAST(CASE WHEN driver_id % 4 = 2 THEN 1 + CAST(quantity AS INT) % 4
                   ELSE 3 + CAST(quantity AS INT) % 3 END AS INT) AS score""",
                "CASE WHEN l_orderkey % 3 = 0 THEN concat('Comment on ride ', l_orderkey) END AS comment",
                "shipdate AS timestamp",
            )
        )

    def complaints(t):
        return (
            t["rides"]
            .where("ride_id % 13 = 0")
            .selectExpr(
                "ride_id", "user_id", "request_time",
                "explode(CASE WHEN ride_id % 39 = 0 THEN array(0, 1) ELSE array(0) END) AS k",
            )
            .selectExpr(
                "ride_id * 10 + k AS complaint_id",
                "ride_id",
                "user_id",
                "concat('Complaint ', k, ' on ride ', ride_id) AS description",
                """CASE (ride_id + k) % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'resolved'
                   ELSE 'closed' END AS status""",
                "request_time + make_dt_interval(1, k, 0, 0) AS timestamp",
            )
        )

    def driver_location(_t):
        return base("events").withColumn("ns", row_count("supplier")).selectExpr(
            "event_id AS location_id",
            "user_id % ns AS driver_id",
            *_coordinate("event_id"),
            "ts AS timestamp",
        )

    def ride_history(_t):
        return base("events").selectExpr(
            "event_id AS history_id",
            "user_id AS ride_id",
            """CASE event_type WHEN 'signup' THEN 'requested' WHEN 'click' THEN 'accepted'
               WHEN 'view' THEN 'in_progress' WHEN 'purchase' THEN 'completed'
               ELSE 'cancelled' END AS status""",
            "ts AS timestamp",
        )

    def fare_rules(t):
        """Seed rates for the vehicle types in use."""
        rates = t["vehicles"].groupBy("vehicle_type").agg(F.count(F.lit(1)).alias("n"))
        types = F.array(*[F.lit(v) for v in VEHICLE_TYPES])

        def rate(position: int, decimal_type: str):
            chosen = F.lit(None)
            for vehicle_type, values in SEED_FARE_RULES.items():
                chosen = F.when(
                    F.col("vehicle_type") == vehicle_type, F.lit(values[position])
                ).otherwise(chosen)
            return chosen.cast(decimal_type)

        return rates.select(
            F.array_position(types, F.col("vehicle_type")).cast("int").alias("rule_id"),
            "vehicle_type",
            rate(0, "decimal(10,2)").alias("base_fare"),
            rate(1, "decimal(10,2)").alias("per_km_rate"),
            rate(2, "decimal(10,2)").alias("per_min_rate"),
            rate(3, "decimal(4,2)").alias("surge_peak_mult"),
            rate(4, "decimal(4,2)").alias("surge_demand_mult"),
            F.expr("TIMESTAMP_NTZ'1995-01-01'").alias("updated_at"),
        )

    def promo_code(_t):
        return base("part").selectExpr(
            "p_partkey + 1 AS promo_id",
            "concat('PROMO', p_partkey + 1) AS code",
            "CAST(5 + p_size AS DECIMAL(10,2)) AS discount_amount",
            "date_add(DATE'1997-06-01', CAST((p_partkey * 7) % 1000 AS INT)) AS expiry_date",
            "CAST(p_partkey % 7 AS INT) AS usage_count",
            "CASE WHEN p_partkey % 3 = 0 THEN 5 END AS max_uses",
        )

    def admin_notifications(t):
        """One notification per driver rating that is itself below 3."""
        low = t["ratings"].where(f"score < 3 AND rated_user_id >= {DRIVER_USER_BASE}")
        return low.select(
            F.col("rating_id").alias("notification_id"),
            F.lit("low_driver_rating").alias("type"),
            low_rating_message(F.col("rated_user_id"), F.col("score").cast("decimal(3,2)")).alias("message"),
            F.col("rated_user_id").alias("ref_user_id"),
            F.expr("rating_id % 4 = 1").alias("is_read"),
            F.col("timestamp").alias("created_at"),
        )

    def driver_payouts(t):
        """One payout per driver and week of paid amounts."""
        paid = t["payments"].where("payment_status = 'paid'").select(
            "ride_id", "amount", F.expr("datediff(to_date(transaction_date), DATE'1990-01-01') div 7").alias("week")
        )
        rides_by_driver = t["rides"].where("driver_id IS NOT NULL").select("ride_id", "driver_id")
        weekly = (
            # A ride has few payments in a week: summing them before the join would hold nearly all of them.
            paid.join(rides_by_driver, "ride_id")
            .groupBy("driver_id", "week").agg(F.sum("amount").alias("gross"))
            .withColumn("payout_id", F.expr("driver_id * 100000 + week"))
            .withColumn("period_end", F.expr("date_add(DATE'1990-01-01', CAST(week * 7 + 7 AS INT))"))
        )
        return weekly.selectExpr(
            "payout_id",
            "driver_id",
            "CAST(round(gross * 0.80, 2) AS DECIMAL(18,2)) AS amount",
            """CASE payout_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'failed'
               ELSE 'paid' END AS status""",
            "date_add(period_end, -7) AS period_start",
            "period_end",
            "CASE WHEN payout_id % 5 = 2 THEN 'bank rejected' END AS notes",
            "CAST(period_end AS TIMESTAMP_NTZ) AS requested_at",
            f"CASE WHEN payout_id % 5 > 2 THEN CAST(period_end AS TIMESTAMP_NTZ) + {_days('2')} END AS processed_at",
        )

    return RideTables(
        {
            "users": users, "driver": driver, "vehicles": vehicles, "location": location,
            "driver_location": driver_location, "fare_rules": fare_rules, "promo_code": promo_code,
            "rides": rides, "ride_history": ride_history, "payments": payments, "ratings": ratings,
            "complaints": complaints, "admin_notifications": admin_notifications,
            "driver_payouts": driver_payouts,
        }
    )
