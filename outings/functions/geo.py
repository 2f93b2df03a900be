"""Great-circle distance and a grid in which a radius search touches few cells."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres, rounded to whole metres; null when a coordinate is missing."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lon = F.radians(lon2 - lon1) / 2
    chord = (F.sin(half_lat) * F.sin(half_lat)
             + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_lon) * F.sin(half_lon))
    chord = F.when(chord > 1.0, 1.0).otherwise(chord)
    return F.bround(2 * EARTH_RADIUS_M * F.atan2(F.sqrt(chord), F.sqrt(1 - chord)), 0)


class RadiusGrid:
    """Latitude bands as high as the radius; within a band, cells about as wide.

    A band is divided by the width the radius spans at the band's edge nearest a pole, so that cells hold a
    similar area at every latitude.
    """

    def __init__(self, radius_m: float):
        # Half a metre is the rounding of a distance; the small factor covers floating-point error.
        self.angle = math.degrees((radius_m + 0.5) / EARTH_RADIUS_M) * (1 + 1e-9)
        self.height = min(self.angle, 180.0)

    def band(self, lat: Column) -> Column:
        return F.floor((lat + 90.0) / self.height).cast("long")

    def cells_in_band(self, band: Column) -> Column:
        south = F.abs(band * self.height - 90.0)
        north = F.abs((band + 1) * self.height - 90.0)
        edge = F.least(F.greatest(south, north), F.lit(90.0))
        cells = F.floor(360.0 * F.cos(F.radians(edge)) / self.height)
        return F.greatest(cells, F.lit(1)).cast("long")

    def cell(self, lat: Column, lon: Column) -> Column:
        cells = self.cells_in_band(self.band(lat))
        return F.pmod(F.floor((lon + 180.0) / 360.0 * cells), cells).cast("long")

    def reached_bands(self, lat: Column) -> Column:
        return F.sequence(self.band(lat - self.angle), self.band(lat + self.angle))

    def reached_cells(self, lat: Column, lon: Column, band: Column) -> Column:
        """Cells of ``band`` in which a point within the radius of (lat, lon) can lie."""
        cells = self.cells_in_band(band)
        ratio = F.sin(F.radians(F.lit(self.angle))) / F.cos(F.radians(lat))
        reach = (F.when((self.angle >= 90.0) | (F.abs(lat) + self.angle >= 90.0), F.lit(180.0))
                 .otherwise(F.degrees(F.asin(F.least(ratio, F.lit(1.0)))) * (1 + 1e-9)))
        first = F.floor((lon - reach + 180.0) / 360.0 * cells)
        last = F.floor((lon + reach + 180.0) / 360.0 * cells)
        last = F.least(last, first + cells - 1)
        return F.array_distinct(F.transform(F.sequence(first, last), lambda c: F.pmod(c, cells).cast("long")))
