"""Typed table scans, the seed rows, and report sinks."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Mapping
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelake.schema import SCHEMAS, SEED_FARE_RULES, TABLES, table_schema


class RideTables(Mapping[str, DataFrame]):
    """The ride tables by name; each frame is built when first asked for.

    Reports touch two to six of the fourteen tables, so unused ones are never analysed.
    """

    def __init__(self, builders: Mapping[str, Callable[["RideTables"], DataFrame]]):
        self._builders = dict(builders)
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name](self)
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)

    def replace(self, **frames: DataFrame) -> "RideTables":
        """A copy in which some tables are swapped, e.g. for a new snapshot."""
        builders = dict(self._builders)
        builders.update({name: (lambda _t, f=frame: f) for name, frame in frames.items()})
        return RideTables(builders)


def load_tables(spark: SparkSession, directory: str) -> RideTables:
    """Scan ``<directory>/<table>`` parquet with the declared schemas (no inference pass)."""

    def scan(name: str) -> Callable[[RideTables], DataFrame]:
        return lambda _t: spark.read.schema(SCHEMAS[name]).parquet(f"{directory}/{name}")

    return RideTables({name: scan(name) for name in TABLES})


# Time column that reports on a fact table filter by.
EVENT_TIMES = {
    "rides": "request_time", "payments": "transaction_date", "ride_history": "timestamp",
    "driver_location": "timestamp", "ratings": "timestamp", "complaints": "timestamp",
}


def write_tables(
    tables: Mapping[str, DataFrame], directory: str, names=TABLES, cluster: bool = False
) -> None:
    """Write tables as parquet.

    ``cluster`` lays facts out by event time, so that the file and row-group ranges let a report on
    some days skip the rest.
    """
    for name in names:
        df = tables[name]
        if cluster and name in EVENT_TIMES:
            df = df.repartitionByRange(EVENT_TIMES[name]).sortWithinPartitions(EVENT_TIMES[name])
        df.write.mode("overwrite").parquet(f"{directory}/{name}")


def write_report(
    df: DataFrame, path: str, fmt: str = "parquet", partition_by: str | None = None
) -> None:
    """Persist a report; a daily one is laid out by its date column."""
    if fmt not in ("parquet", "json", "orc", "csv"):
        raise ValueError(f"unsupported report format: {fmt}")
    if partition_by:
        # Few files per folder, and a hot day still spreads over several writers.
        df.hint("rebalance", partition_by).write.mode("overwrite").partitionBy(partition_by).format(fmt).save(path)
    else:
        df.write.mode("overwrite").format(fmt).save(path)


def table_profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Row count and distinct-key checksum per table, for load checks."""
    parts = []
    for name in TABLES:
        key = table_schema(name).fieldNames()[0]
        parts.append(
            tables[name].agg(
                F.lit(name).alias("table_name"),
                F.count(F.lit(1)).alias("row_count"),
                F.coalesce(F.sum(F.col(key).cast("decimal(20,0)")), F.lit(0))
                .cast("decimal(38,0)").alias("key_sum"),
            )
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def seed_fare_rules(spark: SparkSession, updated_at: dt.datetime) -> DataFrame:
    rows = [
        (i, vehicle_type, *map(Decimal, rates), updated_at)
        for i, (vehicle_type, rates) in enumerate(SEED_FARE_RULES.items(), start=1)
    ]
    return spark.createDataFrame(rows, SCHEMAS["fare_rules"])


def seed_tables(spark: SparkSession, now: dt.datetime) -> RideTables:
    """The published seed rows, for golden tests. ``now`` stands for the load time.

    Stored driver ratings are the ones left by the rating trigger (5.00 and 4.00).
    """
    d = Decimal

    def ago(**kw) -> dt.datetime:
        return now - dt.timedelta(**kw)

    # Seed rows.
    users = [
        (1, "Admin", "Admin", "admin@example.com", "03000000000", "admin"),
        (2, "Ali", "Khan", "ali@example.com", "03001111111", "rider"),
        (3, "Sara", "Ahmed", "sara@example.com", "03002222222", "rider"),
        (4, "Bilal", "Malik", "bilal@example.com", "03003333333", "driver"),
        (5, "Hamza", "Sheikh", "hamza@example.com", "03004444444", "driver"),
        (6, "Zainab", "Raza", "zainab@example.com", "03005555555", "rider"),
    ]
    first_ride = ago(days=2)
    second_ride = ago(days=1)
    minutes = lambda base, n: base + dt.timedelta(minutes=n)
    history = {
        1: ["requested", "accepted", "driver_en_route", "in_progress", "completed"],
        2: ["requested", "accepted", "driver_en_route", "in_progress", "completed"],
        3: ["requested", "cancelled"],
    }
    feed = [(ride, status) for ride, statuses in history.items() for status in statuses]
    rows = {
        "users": [u + ("active", d("0.00"), None, now) for u in users],
        "driver": [
            (1, 4, "4210101234561", "LHR-2020-12345", None, "verified", "available", d("5.00"), 120),
            (2, 5, "4210109876542", "LHR-2019-98765", None, "verified", "offline", d("4.00"), 85),
        ],
        "vehicles": [
            (1, 1, "LEA-123", "Toyota", "Corolla", 2021, "White", "economy", "verified", 120),
            (2, 2, "LEB-456", "Honda", "Civic", 2022, "Silver", "premium", "verified", 85),
        ],
        "location": [
            (1, d("24.8607"), d("67.0011"), "Saddar, Karachi", None),
            (2, d("24.9215"), d("67.0875"), "Gulshan-e-Iqbal, Karachi", None),
            (3, d("24.8810"), d("67.0650"), "Clifton, Karachi", None),
            (4, d("24.9014"), d("67.1323"), "Johar, Karachi", None),
        ],
        "driver_location": [
            (1, 1, d("24.8607"), d("67.0011"), now),
            (2, 2, d("24.9215"), d("67.0875"), now),
        ],
        "promo_code": [
            (1, "WELCOME50", d("50.00"), dt.date(2027, 12, 31), 0, None),
            (2, "SAVE100", d("100.00"), dt.date(2026, 12, 31), 0, None),
            (3, "RIDE25", d("25.00"), dt.date(2026, 6, 30), 0, None),
        ],
        "rides": [
            (1, 2, 1, 1, 1, 2, first_ride, None, minutes(first_ride, 5), minutes(first_ride, 25),
             "completed", d("350.00")),
            (2, 3, 2, 2, 3, 4, second_ride, None, minutes(second_ride, 3), minutes(second_ride, 30),
             "completed", d("500.00")),
            (3, 2, 1, 1, 2, 3, ago(hours=3), None, None, None, "cancelled", None),
        ],
        "ride_history": [(i, r, s, now) for i, (r, s) in enumerate(feed, start=1)],
        "payments": [
            (1, 1, 2, d("350.00"), "cash", "paid", now, None),
            (2, 2, 3, d("500.00"), "wallet", "paid", now, None),
        ],
        "ratings": [
            (1, 1, 2, 4, 5, "Excellent driver, very punctual!", now),
            (2, 1, 4, 2, 4, "Good rider, no issues.", now),
            (3, 2, 3, 5, 4, "Smooth ride, comfortable car.", now),
            (4, 2, 5, 3, 5, "Great passenger!", now),
        ],
        "complaints": [
            (1, 1, 2, "Driver took a longer route than necessary.", "resolved", now),
        ],
        "admin_notifications": [],
        "driver_payouts": [],
    }
    builders = {
        name: (lambda _t, n=name, r=data: spark.createDataFrame(r, SCHEMAS[n]))
        for name, data in rows.items()
    }
    builders["fare_rules"] = lambda _t: seed_fare_rules(spark, now)
    return RideTables(builders)
