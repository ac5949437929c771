"""Upgrade frames in the older, narrower table layout to the current one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridelake.schema import table_schema

# Defaults of the columns that the older layout lacks.
_DEFAULTS = {
    "users": {"wallet_balance": 0, "account_status": "active"},
    "driver": {
        "verification_status": "pending", "availability_status": "offline",
        "average_rating": 0, "total_trips": 0,
    },
    "vehicles": {"verification_status": "pending", "total_trips": 0},
    "promo_code": {"usage_count": 0},
    "rides": {"ride_status": "requested"},
    "payments": {"payment_status": "pending"},
    "complaints": {"status": "open"},
}


def upgrade_legacy_schema(df: DataFrame, table: str) -> DataFrame:
    """Bring ``df`` to the current layout of ``table``: add missing columns, fill defaults, cast.

    A pure projection, so it pipelines with the scan that feeds it.
    """
    defaults = _DEFAULTS.get(table, {})
    present = {name.lower(): name for name in df.columns}
    columns = []
    for field in table_schema(table).fields:
        source = present.get(field.name)
        value = F.col(source) if source else F.lit(None)
        if field.name in defaults:
            value = F.coalesce(value, F.lit(defaults[field.name]))
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)
