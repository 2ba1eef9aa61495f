"""Geodesy as Column expressions (whole-stage codegen, no UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean Earth radius in metres used by every distance.
EARTH_RADIUS_M = 6_371_000.0
# Fixed value: a little less than the metres in one degree of latitude for that
# radius, so that margins computed from it are never too small.
METRES_PER_DEGREE = 111_194.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    h = F.pow(half_lat, 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(half_lon, 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def segment_fraction(
    lat: Column, lon: Column, a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column
) -> Column:
    """Where a point projects on a segment, as a share in [0, 1].

    The projection is planar in degrees; a zero-length segment gives 0.
    """
    dx, dy = b_lon - a_lon, b_lat - a_lat
    length_sq = dx * dx + dy * dy
    raw = ((lon - a_lon) * dx + (lat - a_lat) * dy) / length_sq
    return F.when(length_sq == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    )


def distance_at_fraction(
    lat: Column, lon: Column, a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column, t: Column
) -> Column:
    """Distance from a point to the place on the segment at share ``t``."""
    return haversine(lat, lon, a_lat + t * (b_lat - a_lat), a_lon + t * (b_lon - a_lon))


def segment_distance(
    lat: Column, lon: Column, a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column
) -> Column:
    """Distance in metres from a point to a segment."""
    t = segment_fraction(lat, lon, a_lat, a_lon, b_lat, b_lon)
    return distance_at_fraction(lat, lon, a_lat, a_lon, b_lat, b_lon, t)


# A cell id packs (row, column) of a regular degree grid in one long, which keeps
# shuffle keys narrow. 2^24 columns cover 360 degrees down to about 0.00003 degrees.
_CELL_STRIDE = 1 << 24
_CELL_OFFSET = 1 << 23


def grid_index(value: Column, size_deg: float) -> Column:
    return F.floor(value / F.lit(size_deg)).cast("long")


def pack_cell(row: Column, col: Column) -> Column:
    return row * F.lit(_CELL_STRIDE) + (col + F.lit(_CELL_OFFSET))


def cell_of(lat: Column, lon: Column, size_deg: float) -> Column:
    return pack_cell(grid_index(lat, size_deg), grid_index(lon, size_deg))


def cells_in_box(
    min_lat: Column, max_lat: Column, min_lon: Column, max_lon: Column, size_deg: float
) -> Column:
    """Array of every cell a box touches."""
    rows = F.sequence(grid_index(min_lat, size_deg), grid_index(max_lat, size_deg))
    cols = F.sequence(grid_index(min_lon, size_deg), grid_index(max_lon, size_deg))
    return F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: pack_cell(r, c))))


def lat_margin(metres: Column | float) -> Column:
    """Degrees of latitude that certainly span ``metres``."""
    metres = metres if isinstance(metres, Column) else F.lit(float(metres))
    return metres / F.lit(METRES_PER_DEGREE)


def lon_margin(metres: Column | float, max_abs_lat: Column) -> Column:
    """Degrees of longitude that certainly span ``metres`` up to that latitude."""
    m = lat_margin(metres)
    return m / F.cos(F.radians(max_abs_lat + m))
