"""Places within a radius of a centre."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outings.functions.geo import EARTH_RADIUS_M, RadiusGrid
from outings.operators.keyed import top_per_group
from outings.operators.nearest import Rows, best_partners


def radius_cost(radius_m: float):
    """Whole metres between the points of two tables; not a number beyond the radius."""

    def cost(left: Rows, right: Rows) -> np.ndarray:
        lat1, lon1 = (np.radians(left.column(c).to_numpy())[:, None] for c in ("_lat", "_lon"))
        lat2, lon2 = (np.radians(right.column(c).to_numpy())[None, :] for c in ("_place_lat", "_place_lon"))
        chord = (np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin((lon2 - lon1) / 2) ** 2)
        chord = np.minimum(chord, 1.0)
        metres = np.round(2 * EARTH_RADIUS_M * np.arctan2(np.sqrt(chord), np.sqrt(1 - chord)))
        return np.where(metres <= radius_m, metres, np.nan)

    return cost


# A cell is at most a bit over four radii of its grid across, also next to a pole; three levels up, the radius is eight times as large.
LEVELS_UP = 3


def places_within_radius(centres: DataFrame, places: DataFrame, radius_m: float = 10_000, limit: int = 10,
                         centre_id: str = "centre_id", place_id: str = "place_id") -> DataFrame:
    """The nearest ``limit`` places within the radius of every centre: both ids, distance_m and rank.

    Both frames have latitude and longitude; ids are whole numbers. Centres with the same coordinates are
    searched once, and of the places with the same coordinates only the ``limit`` smallest ids can ever be in a
    result, so a crowded point costs no more than any other.

    The search goes by a tree of cells: level 0 for the full radius, each further level for half of it. A centre whose
    own cell has ``limit`` places on some level needs no more than a few of these cells around it, so it is searched on the level that
    fits its neighbourhood; the others are searched on level 0. Which level that is comes from counts that are joined, and
    all levels are one search.
    """
    lat, lon = F.col("latitude"), F.col("longitude")
    located = centres.where(lat.isNotNull() & lon.isNotNull())
    points = located.groupBy("latitude", "longitude").agg(F.min(centre_id).alias("_point"))
    targets = top_per_group(places.where(lat.isNotNull() & lon.isNotNull()), ["latitude", "longitude"],
                            [F.col(place_id)], limit).select(place_id, "latitude", "longitude")
    grids = [RadiusGrid(radius_m / 2 ** level) for level in range(max(1, math.ceil(math.log2(max(2.0, radius_m)))))]
    best = _search(_levels(points, targets, grids, limit), targets, grids, radius_m, limit, place_id)
    members = (located.select(centre_id, "latitude", "longitude")
               .join(points, ["latitude", "longitude"]).select(centre_id, "_point"))
    return members.join(best, "_point").select(centre_id, place_id, F.col("cost").alias("distance_m"), "rank")


CELL = ["_level", "_band", "_cell"]


def _cells(grids: Sequence[RadiusGrid]) -> Column:
    """The cell of a row on every level."""
    lat, lon = F.col("latitude"), F.col("longitude")
    return F.array(*[F.struct(F.lit(level).alias("_level"), grid.band(lat).alias("_band"), grid.cell(lat, lon).alias("_cell"))
                     for level, grid in enumerate(grids)])


def _levels(points: DataFrame, places: DataFrame, grids: Sequence[RadiusGrid], limit: int) -> DataFrame:
    """The points with the level on which each is searched."""
    full = places.select(F.inline(_cells(grids))).groupBy(*CELL).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= limit)
    own = points.select("_point", F.inline(_cells(grids[LEVELS_UP:]))).withColumn("_level", F.col("_level") + LEVELS_UP)
    deepest = own.join(full, CELL).groupBy("_point").agg((F.max("_level") - LEVELS_UP).alias("_level"))
    return points.join(deepest, "_point", "left").withColumn("_level", F.coalesce("_level", F.lit(0)))


def _search(points: DataFrame, places: DataFrame, grids: Sequence[RadiusGrid], radius_m: float, limit: int, place_id: str) -> DataFrame:
    """The nearest places of distinct points, by way of the cells that the radius of their level reaches."""
    lat, lon = F.col("latitude"), F.col("longitude")

    def reached(grid: RadiusGrid) -> Column:
        return F.flatten(F.transform(grid.reached_bands(lat), lambda band: F.transform(
            grid.reached_cells(lat, lon, band), lambda cell: F.struct(band.alias("_band"), cell.alias("_cell")))))

    around = reached(grids[0])
    for level, grid in enumerate(grids[1:], 1):
        around = F.when(F.col("_level") == level, reached(grid)).otherwise(around)
    probes = points.select("_point", lat.alias("_lat"), lon.alias("_lon"), "_level", F.explode(around).alias("_at")).select(
        "_point", "_lat", "_lon", "_level", "_at.*")
    # Of the levels of a place only those that some point reaches go on.
    targets = places.select(place_id, lat.alias("_place_lat"), lon.alias("_place_lon"), F.inline(_cells(grids))).join(
        probes.select(*CELL).distinct(), CELL, "left_semi")
    found = best_partners(probes, targets, CELL, "_point", place_id, limit, radius_cost(radius_m), ["_lat", "_lon"],
                          ["_place_lat", "_place_lon"])
    return top_per_group(found.drop("rank"), ["_point"], [F.col("cost"), F.col(place_id)], limit, "rank").select(
        "_point", place_id, "cost", "rank")
