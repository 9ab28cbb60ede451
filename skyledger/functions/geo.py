"""Ground distance and grid cells as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.frames import WGS84_A_KM, WGS84_F, d, derive

#: Half the sum of the extreme meridian radii bounds how far a degree can stretch; used to
#: turn a ground radius into degrees with room to spare.
KM_PER_DEGREE_MIN = 110.5
#: Cells of the ground grid: one degree of latitude by one of longitude.
CELL_DEG = 1.0
LON_CELLS = 360


def with_distance(df: DataFrame, latitude: str, longitude: str) -> DataFrame:
    """Add `distance_km` from a place to the row's point, over the ground.

    Lambert's closed form on the WGS84 ellipsoid, good to about 10 m per 1000 km. The place
    is given by two SQL expressions.
    """
    flat = d(1.0 - WGS84_F)
    return derive(
        df,
        {
            "_b1": f"atan({flat} * tan(radians({latitude})))",
            "_b2": f"atan({flat} * tan(radians(latitude_deg)))",
            "_hl": f"sin(radians(longitude_deg - ({longitude})) / 2D)",
            "_hb": "sin((_b2 - _b1) / 2D)",
            "_chord": "_hb * _hb + cos(_b1) * cos(_b2) * _hl * _hl",
            "_sigma": "2D * asin(least(1D, sqrt(_chord)))",
            "_ss": "sin(_sigma)",
            "_sp": "sin((_b1 + _b2) / 2D)",
            "_cp": "cos((_b1 + _b2) / 2D)",
            "_cq": "cos((_b2 - _b1) / 2D)",
            "_lx": "(_sigma - _ss) * _sp * _sp * _cq * _cq / greatest(1D - _chord, 1e-12D)",
            "_ly": "(_sigma + _ss) * _cp * _cp * _hb * _hb / greatest(_chord, 1e-18D)",
        },
        {"distance_km": f"{d(WGS84_A_KM)} * (_sigma - {d(WGS84_F / 2.0)} * (_lx + _ly))"},
    )


def lat_band(latitude: Column) -> Column:
    """Row of the ground grid, 0 at the south pole."""
    return F.least(F.floor((latitude + 90.0) / CELL_DEG), F.lit(179)).cast("int")


def lon_cell(longitude: Column) -> Column:
    """Column of the ground grid, 0 at 180 degrees west."""
    return F.pmod(F.floor((longitude + 180.0) / CELL_DEG).cast("int"), F.lit(LON_CELLS))


def geo_cell(latitude: Column, longitude: Column) -> Column:
    """Grid cell of a point, the stored stand-in for a spatial index."""
    return lat_band(latitude) * LON_CELLS + lon_cell(longitude)


#: Cells of the curve: so many bits of latitude and of longitude, about 5 by 10 km each.
CURVE_BITS = 12


def _spread(number: Column) -> Column:
    """Twelve bits with a gap after each."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        number = number.bitwiseOR(F.shiftleft(number, shift)).bitwiseAND(F.lit(mask))
    return number


def geo_curve(latitude: Column, longitude: Column) -> Column:
    """Place of a point along a space-filling curve: bits of latitude and longitude in turn.

    Points close on the curve are close on the ground, so a table sorted by it has narrow ranges of
    both coordinates in every row group.
    """
    cells = 1 << CURVE_BITS
    band = F.least(F.floor((latitude + 90.0) / 180.0 * cells), F.lit(cells - 1)).cast("int")
    column = F.pmod(F.floor((longitude + 180.0) / 360.0 * cells).cast("int"), F.lit(cells))
    return F.shiftleft(_spread(band), 1).bitwiseOR(_spread(column))


def curve_ranges(
    south: float, north: float, west: float, east: float, most: int = 32
) -> list[tuple[int, int]]:
    """Ranges of the curve that hold every point of a box in degrees; `west` to `east` may wrap.

    Squares of the curve's quadtree are cut while they straddle the box, largest first, until
    there are `most` of them; what still straddles is taken whole.
    """
    if east - west >= 360.0:
        west, east = -180.0, 180.0
    west, east = (west + 180.0) % 360.0 - 180.0, (west + 180.0) % 360.0 - 180.0 + (east - west)
    boxes = [(west, min(east, 180.0))] + ([(-180.0, east - 360.0)] if east > 180.0 else [])
    inside: list[tuple[int, int]] = []
    open_ = [(0, CURVE_BITS, -90.0, -180.0)]  # first place, level, south and west of a square
    while open_ and len(inside) + len(open_) < most:
        first, level, y, x = open_.pop(0)
        height, width, places = 180.0 / (1 << (CURVE_BITS - level)), 360.0 / (1 << (CURVE_BITS - level)), 1 << (2 * level)
        # A point on the upper edge of the map lies in the last band.
        over = [(a, b) for a, b in boxes if a <= x + width and x <= b and south <= y + height and y <= north]
        if not over:
            continue
        if level == 0 or any(a <= x and x + width <= b for a, b in over) and south <= y and y + height <= north:
            inside.append((first, first + places - 1))
            continue
        quarter = places // 4
        open_ += [(first + (2 * up + right) * quarter, level - 1, y + up * height / 2, x + right * width / 2)
                  for up in (0, 1) for right in (0, 1)]
    for first, level, y, x in open_:
        height, width = 180.0 / (1 << (CURVE_BITS - level)), 360.0 / (1 << (CURVE_BITS - level))
        if any(a <= x + width and x <= b for a, b in boxes) and south <= y + height and y <= north:
            inside.append((first, first + (1 << (2 * level)) - 1))
    merged: list[tuple[int, int]] = []
    for lo, hi in sorted(inside):
        if merged and lo <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
        else:
            merged.append((lo, hi))
    return merged


def geo_point(latitude: Column, longitude: Column) -> Column:
    """A point, longitude first."""
    return F.struct(longitude.alias("lon"), latitude.alias("lat"))
