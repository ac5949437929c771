"""Places of rows in one order over a whole table, without passing a group through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridelake.plans.session import cut


def positions(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds ``position`` (from 0, by ``order`` ascending) and ``total``, both within ``group``.

    The rows are range-partitioned by (group, order, their place in the input), so neither a busy group nor a busy value
    of the order fills a task, and rows alike in both have some fixed order. Only counts per (task, group) are
    windowed. Columns of ``group`` must not be null; nulls in ``order`` come first.
    """
    by = [*group, *order, "_place"]
    placed = cut(
        cut(rows.withColumn("_place", F.monotonically_increasing_id()))
        .repartitionByRange(*by).sortWithinPartitions(*by)
        .select(*rows.columns, F.spark_partition_id().alias("_task"), F.monotonically_increasing_id().alias("_at"))
    )
    stretches = placed.groupBy(*group, "_task").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = stretches.select(
        *group, "_task", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_start"),
        F.sum("_n").over(whole).alias("total"),
    )
    return placed.join(starts, [*group, "_task"]).select(
        *rows.columns, (F.col("_at") + F.col("_start")).alias("position"), "total"
    )
