"""Shared pattern of the request jobs: give each request a reject reason, or none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelake.plans.keyed import HotKeys, running_totals
from ridelake.plans.session import cut


def first_reason(*rules: tuple[str, Column]) -> Column:
    """Name of the first rule whose condition holds, NULL when none does."""
    reason = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        reason = F.when(broken, F.lit(name)).otherwise(reason)
    return reason


def fixed(decided: DataFrame) -> DataFrame:
    """Materialise the decisions of a job.

    Its outputs then share them instead of repeating the joins, and still agree with each other
    when the first one written replaces a table that the decisions were made from.
    """
    return cut(decided)


def accepted(decided: DataFrame) -> DataFrame:
    return decided.where("reject_reason IS NULL")


def rejected(decided: DataFrame) -> DataFrame:
    return decided.where("reject_reason IS NOT NULL")


def with_first(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], eligible: Column, hot: HotKeys | None = None
) -> DataFrame:
    """Add ``is_first`` and ``after_first``: the earliest eligible row per key, and rows past it.

    Eligible rows are counted along the key's timeline in slices, so a key with very many requests
    is neither sorted nor joined in one task. The requests, joined by then, are materialised once. Where
    it is known that no key is hot (``hot={}``), nothing is, and rows dealt by ``keys`` stay where they are.
    """
    marked, by = df.withColumn("_eligible", F.coalesce(eligible, F.lit(False)).cast("int")), list(keys)
    if hot is None:
        marked, by = cut(marked.withColumn("_key", F.struct(*keys))), ["_key"]
    counted = running_totals(marked, by, order, {"_count": F.col("_eligible")}, hot=hot)
    return counted.withColumn(
        "is_first", (F.col("_eligible") == 1) & (F.col("_count") == 1)
    ).withColumn("after_first", F.col("_count") > F.col("_eligible")).drop("_key", "_eligible", "_count")
