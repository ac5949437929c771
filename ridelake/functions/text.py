"""Text normalisation and the fixed text formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(column: Column) -> Column:
    """Key form of a text column: comparisons ignore case and outer blanks."""
    return F.lower(F.trim(column))


def leading_int(column: Column) -> Column:
    """Integer prefix of a text value ('4.7' and '4x' give 4); NULL when there is none."""
    digits = F.regexp_extract(column.cast("string"), r"^\s*([+-]?[0-9]+)", 1)
    return digits.try_cast("int")


def is_blank(column: Column) -> Column:
    """Missing in the sense of a required field: NULL or empty text."""
    return column.isNull() | (column.cast("string") == "")


def plain_number(column: Column) -> Column:
    """A two-place decimal as text without trailing zeros (280.00 gives 280)."""
    return F.regexp_replace(column.cast("decimal(18,2)").cast("string"), r"\.?0+$", "")


# Message and audit formats.
def low_rating_message(user_id: Column, average: Column) -> Column:
    return F.concat(
        F.lit("Driver user_id="), user_id, F.lit(" has average rating "), average,
        F.lit(" (below 3.5). Account suspended for review."),
    )


def audit_status(method: Column, driver_net: Column) -> Column:
    return F.concat(
        F.lit("payment_completed:"), method, F.lit(":driver_net_"), plain_number(driver_net)
    )


AUDIT_PATTERN = r"^payment_completed:([^:]*):driver_net_(-?[0-9]+(?:\.[0-9]+)?)$"


def payout_note(gross: Column) -> Column:
    return F.concat(
        F.lit("Weekly payout request — net 80% of Rs."), gross.cast("decimal(18,2)").cast("string"),
        F.lit(" gross"),
    )
