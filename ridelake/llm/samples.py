"""Bounded, reproducible samples of labelled rows for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelake.plans.keyed import top_per_key

_SALTS = 64


def fold(doc_id: str, folds: int) -> Column:
    """The fold of a document: CRC-32 of its id as text, by remainder. A null id has none."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(folds))


def smallest_hashes(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """The rows whose hashed key is among the ``limit`` smallest; fewer rows stay whole.

    Only keys are ordered; the rows are then filtered by one number. Rows sharing the last key all stay.
    """
    hashed = F.xxhash64(F.col(key))
    last = rows.select(hashed.alias("h")).orderBy("h").limit(limit).agg(F.max("h")).first()[0]
    return rows.where(hashed <= F.lit(last)) if last is not None else rows.limit(0)


def smallest_hashes_per_group(rows: DataFrame, key: str, group: str, limit: int) -> DataFrame:
    """Per non-null value of ``group``, the rows whose hashed key is among its ``limit`` smallest; smaller groups stay whole.

    Each task keeps ``limit`` keys per group and salt before they are shuffled, so a busy group is met by many tasks first. The
    rows are then filtered by one number per group, which every task gets: for groups as few as the languages of a
    model. Rows sharing a group's last key all stay.
    """
    keyed = rows.where(F.col(group).isNotNull()).withColumn("_h", F.xxhash64(F.col(key)))
    narrow = keyed.select(F.col(group).alias("_group"), "_h", F.pmod("_h", F.lit(_SALTS)).alias("_salt"))
    salted = top_per_key(narrow, ["_group", "_salt"], [F.asc("_h")], limit)
    last = top_per_key(salted, ["_group"], [F.asc("_h")], limit).groupBy("_group").agg(F.max("_h").alias("_last"))
    near = keyed.join(F.broadcast(last), F.col(group) == F.col("_group"))
    return near.where(F.col("_h") <= F.col("_last")).select(*rows.columns)
