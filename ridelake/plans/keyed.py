"""Skew-safe building blocks: top rows per key, prefix sums and neighbours along a key's timeline,
joins to one row per key.

A window or join partitioned by one key puts all rows of that key into one task. The helpers here
first find the hot keys, with a sketch that reads the key once and shuffles nothing. Other keys take
the plain way, one shuffle. The timeline of a hot key is cut into slices: work runs within (key,
slice) and a small summary per slice is carried across. In joins the rows of a hot key are dealt to
several groups. The list of hot keys is fixed before the work starts, so replays agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_MINUTES = 60
HOT_SHARE = 10_000  # a key with more than 1/HOT_SHARE of all rows is hot, unless
MIN_HOT_ROWS = 100_000  # it has too few rows to keep one task busy
_SKETCH_ITEMS = 100_000

HotKeys = dict[int, int]


def _hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(F.struct(*keys))


def hot_keys(rows: DataFrame, keys: Sequence[str]) -> HotKeys:
    """Hashes of the hot keys with their row counts: fewer than ``HOT_SHARE`` entries.

    Counts are estimates from a frequent-items sketch. They steer how work is split, not results.
    """
    hashed = rows.select(_hash(keys).alias("_h"))
    row = hashed.agg(
        F.expr(f"approx_top_k(_h, {HOT_SHARE}, {_SKETCH_ITEMS})").alias("top"), F.count(F.lit(1)).alias("n")
    ).first()
    floor = max(row.n / HOT_SHARE, MIN_HOT_ROWS)
    return {item["item"]: item["count"] for item in row.top if item["count"] > floor}


def is_hot(keys: Sequence[str], hot: HotKeys) -> Column:
    return _hash(keys).isin(list(hot))


def deal(rows: DataFrame, keys: Sequence[str], count: int, per_task: int = 500_000) -> DataFrame:
    """``rows`` dealt by ``keys`` so that a task sorts about ``per_task`` of ``count`` rows, however many there are.

    Where there are few rows for each core, the next join or window deals them itself.
    """
    spark, tasks = rows.sparkSession, -(-count // per_task)
    if tasks <= spark.sparkContext.defaultParallelism:
        return rows
    return rows.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows per key. Spark prunes to ``k`` per key in each task before shuffling."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= k).drop("_rank")


def time_slice(ts: Column, minutes: int = SLICE_MINUTES) -> Column:
    """Number of the ``minutes``-wide slice of a zone-less time. Never decreases with time.

    Rows without a time share the first slice, as they come first in order.
    """
    minute = F.unix_date(F.to_date(ts)).cast("long") * 1440 + F.hour(ts) * 60 + F.minute(ts)
    return F.coalesce(F.call_function("div", minute, F.lit(minutes)), F.lit(-(2**40)))


def _split_by_heat(df: DataFrame, keys: Sequence[str], hot: HotKeys | None, plain, sliced) -> DataFrame:
    """``plain`` over the rows of ordinary keys, ``sliced`` over those of hot ones."""
    hot = hot_keys(df, keys) if hot is None else hot
    if not hot:
        return plain(df)
    heat = is_hot(keys, hot)
    return plain(df.where(~heat)).unionByName(sliced(df.where(heat)))


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    totals: dict[str, Column],
    slice_minutes: int = SLICE_MINUTES,
    initial: DataFrame | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Add running sums per key, up to and including each row.

    ``order`` starts with the time column and is unique within a key. Keys must not be NULL; wrap a
    nullable one in a struct. ``initial`` gives starting sums per key, one row each. ``df`` is read
    more than once, so cut an expensive one first.
    """
    names = list(totals)
    starts = None
    if initial is not None:
        starts = initial.select(*keys, *[F.col(n).alias(f"_start_{n}") for n in names])

    def with_starts(frame: DataFrame, prefix: str) -> DataFrame:
        if starts is None:
            return frame
        joined = frame.join(starts, list(keys), "left")
        kept = [c for c in frame.columns if c not in [f"{prefix}{n}" for n in names]]
        added = [
            (F.col(f"{prefix}{n}") + F.coalesce(f"_start_{n}", F.lit(0))).alias(f"{prefix}{n}") for n in names
        ]
        return joined.select(*kept, *added)

    def sums(frame: DataFrame, partition: Sequence[str], prefix: str) -> DataFrame:
        window = Window.partitionBy(*partition).orderBy(*order).rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
        return frame.select("*", *[F.sum(totals[n]).over(window).alias(f"{prefix}{n}") for n in names])

    def plain(frame: DataFrame) -> DataFrame:
        return with_starts(sums(frame, keys, ""), "").select(*df.columns, *names)

    def sliced(frame: DataFrame) -> DataFrame:
        rows = frame.withColumn("_slice", time_slice(F.col(order[0]), slice_minutes))
        per_slice = rows.groupBy(*keys, "_slice").agg(
            *[F.sum(totals[n]).alias(f"_sum_{n}") for n in names]
        )
        earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        carried = per_slice.select(
            *keys, "_slice",
            *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_carry_{n}") for n in names],
        )
        # Joined on what the window was partitioned by, so the rows are not shuffled again.
        local = sums(rows, [*keys, "_slice"], "_local_")
        return local.join(with_starts(carried, "_carry_"), [*keys, "_slice"]).select(
            *df.columns, *[(F.col(f"_local_{n}") + F.col(f"_carry_{n}")).alias(n) for n in names]
        )

    return _split_by_heat(df, keys, hot, plain, sliced)


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    previous: dict[str, str] | None = None,
    following: dict[str, str] | None = None,
    slice_minutes: int = SLICE_MINUTES,
    initial: DataFrame | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Add values of the previous and following row of the same key.

    ``previous`` and ``following`` map new column names to source columns. ``initial`` gives the
    source values before a key's first row. The same conditions as for ``running_totals`` hold.
    """
    previous, following = previous or {}, following or {}
    sources = sorted({*previous.values(), *following.values()})
    values = F.struct(*sources)
    starts = None
    if initial is not None and previous:
        starts = initial.select(*keys, F.struct(*sources).alias("_start"))

    def beside(frame: DataFrame, partition: Sequence[str]) -> DataFrame:
        window = Window.partitionBy(*partition).orderBy(*order)
        return frame.select("*", F.lag(values).over(window).alias("_prev"), F.lead(values).over(window).alias("_next"))

    def result(frame: DataFrame, prev: Column, nxt: Column) -> DataFrame:
        return frame.select(
            *df.columns, *[prev[src].alias(name) for name, src in previous.items()],
            *[nxt[src].alias(name) for name, src in following.items()],
        )

    def plain(frame: DataFrame) -> DataFrame:
        local = beside(frame, keys)
        prev = F.col("_prev")
        if starts is not None:
            local, prev = local.join(starts, list(keys), "left"), F.coalesce("_prev", "_start")
        return result(local, prev, F.col("_next"))

    def sliced(frame: DataFrame) -> DataFrame:
        rows = frame.withColumn("_slice", time_slice(F.col(order[0]), slice_minutes))
        position = F.struct(*order)
        edges = rows.groupBy(*keys, "_slice").agg(
            F.max_by(values, position).alias("_tail"), F.min_by(values, position).alias("_head")
        )
        by_slice = Window.partitionBy(*keys).orderBy("_slice")
        summary = edges.select(
            *keys, "_slice", F.lag("_tail").over(by_slice).alias("_before"),
            F.lead("_head").over(by_slice).alias("_after"),
        )
        if starts is not None:
            summary = summary.join(starts, list(keys), "left").select(
                *keys, "_slice", F.coalesce("_before", "_start").alias("_before"), "_after"
            )
        local = beside(rows, [*keys, "_slice"]).join(summary, [*keys, "_slice"])
        return result(local, F.coalesce("_prev", "_before"), F.coalesce("_next", "_after"))

    return _split_by_heat(df, keys, hot, plain, sliced)


def left_join_many(
    left: DataFrame, left_keys: DataFrame, right: DataFrame, on: Sequence[str]
) -> DataFrame:
    """Left join to a side that may hold very many rows for one key.

    A left outer join cannot split a hot right-hand key, an inner join can. So for hot keys the right
    side gets one empty row per unmatched key, and their join is an inner one; other keys take the
    plain left join. ``left_keys`` are the key columns of ``left`` from a cheap source, one row per key.
    """
    keys = list(on)
    hot = hot_keys(right, keys)
    if not hot:
        return left.join(right, keys, "left")
    heat = is_hot(keys, hot)
    for key in keys:  # a NULL matches nothing, so it needs no filler
        heat = heat & F.col(key).isNotNull()
    many = right.where(heat)
    empty = left_keys.where(heat).join(many.select(*keys).distinct(), keys, "left_anti")
    filled = left.where(heat).join(many.unionByName(empty, allowMissingColumns=True), keys)
    return left.where(~heat).join(right.where(~heat), keys, "left").unionByName(filled)


def join_per_key(
    rows: DataFrame, per_key: DataFrame, on: Sequence[str], how: str = "left", hot: HotKeys | None = None
) -> DataFrame:
    """Join many rows to a side with one row per key, splitting hot keys.

    Spark splits skewed partitions only where both join sides come straight from a shuffle, so not
    where one is an aggregate on the join key, and not inside a stream. Here the rows of a hot key
    are dealt to groups of at most ``MIN_HOT_ROWS`` rows or so, to each of which the key's one row is
    copied. Rows with a NULL key count as one key, match nothing and are dealt alike.
    """
    if how not in ("left", "inner"):
        raise ValueError("join_per_key supports left and inner joins")
    keys = list(on)
    hot = hot_keys(rows, keys) if hot is None else hot
    if not hot:
        return rows.join(per_key, keys, how)
    groups = [(item, -(-count // MIN_HOT_ROWS)) for item, count in hot.items()]
    # Fewer than HOT_SHARE rows, whatever the size of the data.
    listed = F.broadcast(rows.sparkSession.createDataFrame(groups, "_h BIGINT, _splits BIGINT"))

    def heated(frame: DataFrame) -> DataFrame:
        return frame.withColumn("_h", _hash(keys)).join(listed, "_h", "left").withColumn(
            "_splits", F.coalesce("_splits", F.lit(1))
        )

    dealt = heated(rows).withColumn("_split", F.pmod(F.xxhash64(*rows.columns), F.col("_splits")))
    copies = heated(per_key).withColumn(
        "_split", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_splits") - 1))
    )
    joined = dealt.drop("_h", "_splits").join(copies.drop("_h", "_splits"), [*keys, "_split"], how)
    return joined.drop("_split")
