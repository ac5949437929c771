"""Bucketed snapshots: what a merge touches, replays, and merges that died."""

import os

import pytest
from conftest import rows
from pyspark.sql import functions as F

from ridelake.operators import changes
from ridelake.sources.feeds import feed
from ridelake.sources.snapshots import Snapshot

SCHEMA = "k long, n long"


def _kept(spark, folder, buckets=8):
    return Snapshot(spark, folder, SCHEMA, ("k",), buckets)


def _add(rows):
    return rows.groupBy("k").agg(F.sum("n").alias("n"))


def _files(folder):
    found = {}
    for base, _, names in os.walk(f"{folder}/data"):
        for name in names:
            if name.endswith(".parquet"):
                path = os.path.join(base, name)
                found[path] = os.stat(path).st_mtime_ns
    return found


def test_reading_does_not_grow_with_merges(spark, folder):
    kept = _kept(spark, folder, 4)
    assert kept.read().count() == 0 and kept.version() == -1
    opened = []
    for i in range(9):
        kept.merge(spark.range(40).select(F.col("id").alias("k"), F.lit(1).alias("n")), _add)
        opened.append((len(kept.folders()), len(kept.read().inputFiles())))
    assert set(opened) == {(4, 4)} and len(_files(folder)) <= 3 * 4
    assert rows(kept.read()) == sorted([(i, 9) for i in range(40)], key=repr)


def test_replay_and_a_merge_that_died(spark, folder):
    kept = _kept(spark, folder)
    one = spark.createDataFrame([(1, 1), (None, 5)], SCHEMA)
    for version in (0, 0, 1, 1, 0):
        kept.merge(one, _add, version)
    assert rows(kept.read()) == [(1, 2), (None, 10)] and kept.version() == 1

    def dies(rows):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        kept.merge(one, dies, 2)
    os.remove(f"{folder}/marker=1/_SUCCESS")  # as if the newest marker had been half written: the one before holds
    assert rows(kept.read()) == [(1, 1), (None, 5)]
    kept.merge(one, _add, 1)
    kept.merge(one, _add, 2)
    assert rows(kept.read()) == [(1, 3), (None, 15)]


def test_ten_changes_touch_ten_buckets(spark, tables, folder):
    users = tables["users"]
    kept = Snapshot(spark, folder, users.schema, ("user_id",), buckets=32)
    kept.merge(users, lambda rows: rows)
    before = _files(folder)
    some = feed(tables, "account_changes").orderBy("change_id").limit(10)
    out = kept.change(some, changes.change_account_status)
    after = _files(folder)
    assert all(after[path] == at for path, at in before.items())  # written beside, nothing replaced
    assert 0 < len(after) - len(before) <= 10
    want = changes.change_account_status(users, some)
    assert rows(kept.read()) == rows(want["snapshot"]) and rows(out["rejected"]) == rows(want["rejected"])


def test_deleted_rows_and_strange_keys(spark, folder):
    kept = _kept(spark, folder, 2)
    kept.merge(spark.range(10).select(F.col("id").alias("k"), F.col("id").alias("n")), lambda rows: rows)
    kept.change(spark.range(10).withColumnRenamed("id", "k"), lambda old, feed: {"snapshot": old.limit(0)})
    assert kept.read().count() == 0
    with pytest.raises(ValueError):
        _kept(spark, folder, 64).change(
            spark.createDataFrame([(1,)], "k long"), lambda old, feed: {"snapshot": spark.range(50).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("n"))}
        )
