"""Raster and web-mercator geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import GridMeta

MERCATOR = 20037508.342789244


def row_col(lat: Column, lng: Column, m: GridMeta, clamp: bool = False) -> Column:
    """struct(row, col) of a point: null outside the raster, or its nearest border cell with `clamp`. The exact south and east borders belong to the last cell."""
    row = F.greatest(F.lit(0), F.least(((F.lit(m.north) - lat) / m.cell_h).cast("int"), F.lit(m.height - 1)))
    col = F.greatest(F.lit(0), F.least(((lng - F.lit(m.west)) / m.cell_w).cast("int"), F.lit(m.width - 1)))
    cell = F.struct(row.alias("row"), col.alias("col"))
    return cell if clamp else F.when(lat.between(m.south, m.north) & lng.between(m.west, m.east), cell)


def centre_lat(row: Column, m: GridMeta) -> Column:
    return F.lit(m.north) - (row + 0.5) * m.cell_h


def centre_lng(col: Column, m: GridMeta) -> Column:
    return F.lit(m.west) + (col + 0.5) * m.cell_w


def region_bucket(lat: Column, lng: Column) -> Column:
    """Number of the 30 degree box a point is in."""
    return ((F.floor(lat / 30) + 3) * 12 + F.floor(lng / 30) + 6).cast("int")


def tile_lat(y: Column, z: Column) -> Column:
    """Latitude of the upper border of tile row y at zoom z."""
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) - F.lit(2 * math.pi) * y / F.pow(F.lit(2.0), z))))


def tile_bounds(z: Column, x: Column, y: Column) -> Column:
    """struct(west, south, east, north) of a web-mercator tile in degrees."""
    n = F.pow(F.lit(2.0), z)
    return F.struct((x / n * 360.0 - 180.0).alias("west"), tile_lat(y + 1, z).alias("south"), ((x + 1) / n * 360.0 - 180.0).alias("east"), tile_lat(y, z).alias("north"))


def mercator_bounds(z: Column, x: Column, y: Column) -> Column:
    """struct(minx, miny, maxx, maxy) of a tile in web-mercator metres."""
    side = F.lit(2 * MERCATOR) / F.pow(F.lit(2.0), z)
    return F.struct((x * side - MERCATOR).alias("minx"), (F.lit(MERCATOR) - (y + 1) * side).alias("miny"), ((x + 1) * side - MERCATOR).alias("maxx"), (F.lit(MERCATOR) - y * side).alias("maxy"))


def from_mercator(mx: Column, my: Column) -> Column:
    """struct(lat, lng) of a point in metres."""
    return F.struct((F.atan(F.exp(my / MERCATOR * math.pi)) * 360 / math.pi - 90).alias("lat"), (mx / MERCATOR * 180).alias("lng"))


# The heat ramp's bands (first index, last index, RGBA at each end); lower indexes are transparent.
RAMP = (
    (141, 166, (200, 180, 50, 60), (240, 200, 30, 140)),
    (167, 204, (240, 200, 30, 140), (245, 120, 20, 210)),
    (205, 240, (245, 120, 20, 210), (220, 40, 20, 240)),
    (241, 255, (220, 40, 20, 240), (180, 15, 30, 255)),
)
# The three-step palette (threshold, RGB), drawn at alpha 200.
PALETTE = ((0.016, (134, 25, 143)), (0.015, (192, 38, 211)), (0.013, (232, 121, 249)))


def ramp_colour(index: Column) -> Column:
    """struct(r, g, b, a) of a ramp index 0..255, each channel interpolated in its band and truncated."""
    channels = []
    for k, name in enumerate("rgba"):
        value = F.lit(0)
        for first, last, low, high in RAMP:
            at = (index - first) / F.lit(float(last - first))
            value = F.when(index.between(first, last), (F.lit(float(low[k])) + F.lit(float(high[k] - low[k])) * at).cast("int")).otherwise(value)
        channels.append(value.alias(name))
    return F.struct(*channels)


def ramp_index(score: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), (score * 255).cast("int")))


def palette_colour(score: Column) -> Column:
    """struct(r, g, b, a) of the highest threshold reached; transparent black below all."""
    channels = []
    for k, name in enumerate("rgb"):
        value = F.lit(0)
        for least, colour in sorted(PALETTE):
            value = F.when(score >= least, F.lit(colour[k])).otherwise(value)
        channels.append(value.alias(name))
    return F.struct(*channels, F.when(score >= min(t for t, _ in PALETTE), 200).otherwise(0).alias("a"))
