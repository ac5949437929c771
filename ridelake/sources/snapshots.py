"""Kept tables in hashed buckets, of which a merge reads and rewrites only those its rows touch.

A bucket's rows are in ``data/slot=<s>/bucket=<b>``; a merge writes the touched buckets to their next slot and then a marker
that names the slot of every bucket. Readers follow the newest whole marker, of which there are two in turn, so
a merge that dies half way changes nothing and is simply done again. Reading opens one folder per bucket, whatever the
number of merges. A reader has until the second next merge of a bucket to finish.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridelake.plans.session import cut

SLOTS = 3
_MARK = "version BIGINT, slots MAP<INT,INT>"


class Snapshot:
    """A table by ``key``. ``buckets`` is fixed when the first version is written; choose it so that a bucket fits a task."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: tuple[str, ...], buckets: int = 64):
        self._spark, self._path, self._schema, self._key, self._buckets = spark, path, schema, key, buckets

    def _exists(self, path: str) -> bool:
        target = self._spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self._spark._jsc.hadoopConfiguration()).exists(target)

    def _marker(self) -> tuple[int, dict[int, int]]:
        """Newest version and the slot of each bucket that has rows."""
        whole = [p for p in (f"{self._path}/marker={i}" for i in (0, 1)) if self._exists(f"{p}/_SUCCESS")]
        marks = [self._spark.read.schema(_MARK).parquet(p).first() for p in whole]
        newest = max(marks, key=lambda m: m.version, default=None)
        return (newest.version, dict(newest.slots)) if newest else (-1, {})

    def version(self) -> int:
        return self._marker()[0]

    def folders(self, touched: set[int] | None = None) -> list[str]:
        """The folders that hold the present version, or its ``touched`` buckets."""
        return [
            f"{self._path}/data/slot={slot}/bucket={bucket}"
            for bucket, slot in sorted(self._marker()[1].items()) if touched is None or bucket in touched
        ]

    def read(self, touched: set[int] | None = None) -> DataFrame:
        folders = self.folders(touched)
        if not folders:
            return self._spark.createDataFrame([], self._schema)
        return self._spark.read.schema(self._schema).parquet(*folders)

    def _with_bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*self._key), F.lit(self._buckets)).cast("int"))

    def _buckets_of(self, rows: DataFrame) -> set[int]:
        return {r.bucket for r in self._with_bucket(rows).select("bucket").distinct().collect()}  # at most all buckets

    def change(
        self, feed: DataFrame, rule: Callable[[DataFrame, DataFrame], Mapping[str, DataFrame]], version: int | None = None,
    ) -> Mapping[str, DataFrame]:
        """Apply ``rule(old rows, feed)`` to the buckets that ``feed`` touches; its ``snapshot`` becomes their rows.

        The rule must map keys of the feed to rows of the same keys only. ``version`` numbers the feed: one that is already in
        is not applied again (then the result is empty). Default: the next one.
        """
        last, slots = self._marker()
        version = last + 1 if version is None else version
        if version <= last:
            return {}
        feed = cut(feed)  # read three times
        touched = self._buckets_of(feed)
        out = rule(self.read(touched), feed)
        self._put(out["snapshot"], touched, version, slots)
        return out

    def merge(self, rows: DataFrame, fold: Callable[[DataFrame], DataFrame], version: int | None = None) -> None:
        """``fold`` the old rows of the touched buckets and ``rows`` together, giving one row per key."""
        columns = self._spark.createDataFrame([], self._schema).columns
        self.change(
            rows.select(*columns), lambda old, new: {"snapshot": fold(old.unionByName(new)).select(*columns)}, version
        )

    def _put(self, rows: DataFrame, touched: set[int], version: int, slots: dict[int, int]) -> None:
        if touched:
            target = {b: (slots.get(b, -1) + 1) % SLOTS for b in touched}
            slot_of = F.create_map(*[F.lit(x) for pair in target.items() for x in pair])
            new = cut(self._with_bucket(rows))
            present = {r.bucket for r in new.select("bucket").distinct().collect()}
            if present - touched:
                raise ValueError("a rule gave rows of keys that its feed does not have")
            # Only slots that no whole marker names are replaced.
            new.withColumn("slot", slot_of[F.col("bucket")]).repartition("bucket").write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic"
            ).partitionBy("slot", "bucket").parquet(f"{self._path}/data")
            slots = {b: s for b, s in slots.items() if b not in touched} | {b: target[b] for b in present}
        mark = self._spark.createDataFrame([(version, slots)], _MARK)
        mark.coalesce(1).write.mode("overwrite").parquet(f"{self._path}/marker={version % 2}")
