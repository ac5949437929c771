"""Distance joins as equi-joins on grid cells.

The globe is cut into latitude bands and each band into longitude cells whose sides are at least
``cell_km``. A point lies in exactly one cell; a site is copied to every cell that a circle of
``reach_km`` around it touches (about nine when the reach equals the cell side). Joining on the cell
then finds every pair within reach once, without comparing all points with all sites.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridelake.plans.keyed import join_per_key
from ridelake.plans.session import cut
from ridelake.schema import EARTH_RADIUS_KM

_KM_PER_DEGREE = math.pi * EARTH_RADIUS_KM / 180
_EDGE = 1e-9  # degrees; keeps points on a cell edge inside the copies
HALF_EARTH_KM = math.pi * EARTH_RADIUS_KM


def _band(lat: Column, cell_km: float) -> Column:
    return F.floor((lat + 90) / (cell_km / _KM_PER_DEGREE))


def _cells_in_band(band: Column, cell_km: float) -> Column:
    """Number of longitude cells in a band, from its narrowest parallel."""
    height = cell_km / _KM_PER_DEGREE
    south = band * height - 90
    widest = F.least(F.lit(90.0), F.greatest(F.abs(south), F.abs(south + height)))
    around = F.lit(2 * math.pi * EARTH_RADIUS_KM) * F.cos(F.radians(widest))
    return F.greatest(F.lit(1), F.floor(around / cell_km))


def _turn(lng: Column) -> Column:
    """Longitude as a fraction of a full turn, in [0, 1)."""
    return F.pmod(lng + 180, F.lit(360.0)) / 360


def cell_of(lat: Column, lng: Column, cell_km: float) -> tuple[Column, Column]:
    """Band and cell number of a point."""
    lat, lng = lat.cast("double"), lng.cast("double")
    band = _band(lat, cell_km)
    n = _cells_in_band(band, cell_km)
    return band, F.least(n - 1, F.floor(_turn(lng) * n))


def cells_within(lat: Column, lng: Column, reach_km: float, cell_km: float) -> Column:
    """All cells touched by a circle of ``reach_km`` (not above ``cell_km``) around a site."""
    lat, lng = lat.cast("double"), lng.cast("double")
    angle = min(reach_km / EARTH_RADIUS_KM, math.pi)
    pole_free = F.abs(lat) + math.degrees(angle) < 90
    ratio = F.lit(math.sin(min(angle, math.pi / 2))) / F.cos(F.radians(lat))
    spread = F.when(pole_free, F.degrees(F.asin(F.least(F.lit(1.0), ratio))) + _EDGE).otherwise(F.lit(180.0))
    half = spread / 360
    own = _band(lat, cell_km)

    def in_band(band: Column) -> Column:
        n = _cells_in_band(band, cell_km)
        first = F.floor((_turn(lng) - half) * n)
        last = F.least(F.floor((_turn(lng) + half) * n), first + n - 1)
        return F.transform(
            F.sequence(first, last),
            lambda i: F.struct(band.alias("band"), F.pmod(i, n).alias("cell")),
        )

    bands = F.sequence(own - 1, own + 1)
    return F.array_distinct(F.flatten(F.transform(bands, in_band)))


def _quad(lat: Column, lng: Column, level: int) -> Column:
    """The cell of a point in a quadtree of ``level`` halvings of latitude and longitude."""
    side = 1 << level
    inside = lambda share: F.greatest(F.lit(0), F.least(F.lit(side - 1), F.floor(share * side)))
    return F.struct(inside((lat.cast("double") + 90) / 180).alias("y"), inside(_turn(lng.cast("double"))).alias("x"))


def start_reach(
    points: DataFrame, sites: DataFrame, point: tuple[str, str], site: tuple[str, str], reaches: list[float], k: int,
) -> DataFrame:
    """Adds ``_step``, the place in the falling ``reaches`` at which a search for ``k`` sites should begin.

    That is the smallest reach whose quadtree cell, no higher than it, holds ``k`` sites; 0 where none does.
    Sites are counted once, in the smallest cells; larger cells add those counts up. Of the points only
    their distinct smallest cells look for a cell with enough sites, so a busy place weighs no more than its area.
    """
    levels = [max(0, math.ceil(math.log2(180 * _KM_PER_DEGREE / r))) for r in reaches]
    finest = max(levels)

    def climb(cells: DataFrame) -> DataFrame:
        """Each cell with the cells around it at every step."""
        up = lambda part, level: F.shiftright(F.col(f"_q.{part}"), finest - level)
        steps = [F.struct(F.lit(i).alias("_step"), up("y", v).alias("_y"), up("x", v).alias("_x")) for i, v in enumerate(levels)]
        return cells.select("*", F.inline(F.array(*steps)))

    counted = sites.groupBy(_quad(F.col(site[0]), F.col(site[1]), finest).alias("_q")).agg(F.count(F.lit(1)).alias("_n"))
    enough = climb(counted).groupBy("_step", "_y", "_x").agg(F.sum("_n").alias("_n")).where(F.col("_n") >= k).drop("_n")
    placed = points.withColumn("_q", _quad(F.col(point[0]), F.col(point[1]), finest))
    asked = climb(placed.select("_q").distinct())
    begin = join_per_key(asked, enough, ["_step", "_y", "_x"], "inner").groupBy("_q").agg(F.max("_step").alias("_step"))
    return join_per_key(placed, begin, ["_q"]).withColumn("_step", F.coalesce("_step", F.lit(0))).drop("_q")


def join_within(
    points: DataFrame,
    sites: DataFrame,
    point_id: list[str],
    point: tuple[str, str],
    site: tuple[str, str],
    reach_km: float,
    pairs_per_split: int = 250_000,
    blocks_per_task: int = 16,
) -> DataFrame:
    """Candidate pairs: all within ``reach_km`` and some beyond; filter on the distance after.

    Busy cells are cut into blocks by the measured numbers of their points and sites: both sides are
    dealt to groups, and each group of points meets each group of sites once. A block holds about
    ``pairs_per_split`` pairs, as a square where both sides are large, so the copies come to
    2 / sqrt(``pairs_per_split``) rows per pair; a few points against very many sites cut only the
    sites, and the other way round. Cells without both sides drop out. The number of tasks grows with
    the number of blocks, so that a task has about ``blocks_per_task`` of them at any size.
    """
    band, cell = cell_of(F.col(point[0]), F.col(point[1]), reach_km)
    placed = points.withColumn("_band", band).withColumn("_cell", cell)
    touched = cells_within(F.col(site[0]), F.col(site[1]), reach_km, reach_km)
    copied = sites.select("*", F.inline(touched).alias("_band", "_cell"))
    here = placed.groupBy("_band", "_cell").agg(F.count(F.lit(1)).alias("_points"))
    there = copied.groupBy("_band", "_cell").agg(F.count(F.lit(1)).alias("_sites"))

    def groups(own: str, other: str) -> Column:
        size = F.greatest(F.lit(math.sqrt(pairs_per_split)), F.lit(float(pairs_per_split)) / F.col(other))
        return F.ceil(F.col(own) / size)

    load = cut(here.join(there, ["_band", "_cell"]).select(
        "_band", "_cell", groups("_points", "_sites").alias("_ps"), groups("_sites", "_points").alias("_ss"),
        (F.col("_points") * F.col("_sites") / pairs_per_split).alias("_full"),
    ))
    full = load.agg(F.sum("_full")).first()[0] or 0.0
    load = load.drop("_full")

    def blocks(rows: DataFrame, by: list[str], own: str, group: str, other: str, all_groups: str) -> DataFrame:
        """The rows in their own group, copied to each group of the other side."""
        sized = join_per_key(rows, load, ["_band", "_cell"], "inner")
        return sized.withColumn(group, F.pmod(F.xxhash64(*by), F.col(own))).withColumn(
            all_groups, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1))
        ).drop("_ps", "_ss")

    # Both sides are dealt by block, so that whichever of them a join streams, its tasks are even; and to
    # a number of partitions set by the pairs: the input is small next to the pairs it makes, and sizing
    # the tasks by input bytes would put busy cells back together.
    tasks = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(full / blocks_per_task))
    keys = ["_band", "_cell", "_p", "_s"]
    dealt = blocks(placed, point_id, "_ps", "_p", "_ss", "_s").repartition(tasks, *keys)
    copies = blocks(copied, sites.columns, "_ss", "_s", "_ps", "_p").repartition(tasks, *keys)
    return dealt.join(copies, keys).drop(*keys)
