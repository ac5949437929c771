"""Exact decimal money expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridelake.schema import COMMISSION, DRIVER_SHARE


def money(column: Column) -> Column:
    return column.cast("decimal(18,2)")


def total_money(column: Column) -> Column:
    """A sum of any number of amounts; ``money`` is for a single one."""
    return column.cast("decimal(38,2)")


def money4(column: Column) -> Column:
    return column.cast("decimal(38,4)")


def commission(amount: Column) -> Column:
    """Platform share of an amount or of a sum of amounts, unrounded."""
    return money4(amount * F.lit(COMMISSION))


def driver_net(amount: Column) -> Column:
    return money4(amount * F.lit(DRIVER_SHARE))


def commission2(amount: Column, kind=money) -> Column:
    return kind(F.round(amount * F.lit(COMMISSION), 2))


def driver_net2(amount: Column, kind=money) -> Column:
    return kind(F.round(amount * F.lit(DRIVER_SHARE), 2))


def less_discount(fare: Column, discount: Column) -> Column:
    """Fare minus discount, never below zero, NULL when the fare is unknown.

    ``greatest`` skips NULLs, hence the guard.
    """
    reduced = F.greatest(F.lit(0), fare - F.coalesce(discount, F.lit(0)))
    return F.when(fare.isNotNull(), reduced)


def mean(total: Column, n: Column) -> Column:
    """Average to six places as a double, NULL over no rows."""
    return F.round(F.try_divide(total.cast("double"), n), 6)


def rating2(total: Column, n: Column) -> Column:
    """Mean of whole scores to two places, half up, in integer arithmetic."""
    total, n = total.cast("bigint"), n.cast("bigint")
    hundredths = F.call_function("div", total * 200 + n, n * 2)
    return (hundredths.cast("decimal(10,0)") * F.lit("0.01").cast("decimal(2,2)")).cast("decimal(3,2)")
