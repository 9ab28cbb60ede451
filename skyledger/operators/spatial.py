"""Distance, radius and nearest-object queries."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.functions import geo


def distances_from(points: DataFrame, latitude: float, longitude: float) -> DataFrame:
    """Ground distance of every point from one place."""
    return geo.with_distance(points, geo.d(latitude), geo.d(longitude))


def within_radius(
    points: DataFrame, latitude: float, longitude: float, radius_km: float
) -> DataFrame:
    """Points whose ground distance from a place is at most `radius_km`.

    A box that certainly contains the circle comes first. On a stored snapshot it becomes ranges
    of the curve the snapshot is sorted by, which reach the Parquet scan and leave out the files
    and row groups elsewhere; only what is left pays for the exact distance.
    """
    south, north, west, east = _box(latitude, longitude, radius_km)
    near = points.where(F.col("latitude_deg").between(south, north))
    if "geo_curve" in points.columns:
        ranges = [F.col("geo_curve").between(a, b) for a, b in geo.curve_ranges(south, north, west, east)]
        near = near.where(reduce(Column.__or__, ranges))
    return distances_from(near, latitude, longitude).where(F.col("distance_km") <= radius_km)


def _box(latitude: float, longitude: float, radius_km: float) -> tuple[float, float, float, float]:
    """South, north, west and east of a box around a circle on the ground, in degrees.

    West and east may leave -180..180. The angle is widened by the difference between geodetic and
    geocentric latitude.
    """
    reach = min(radius_km / geo.KM_PER_DEGREE_MIN + 0.3, 180.0)
    south, north = max(latitude - reach, -90.0), min(latitude + reach, 90.0)
    if abs(latitude) + reach >= 89.9:
        return south, north, -180.0, 180.0
    half = math.degrees(math.asin(min(1.0, math.sin(math.radians(reach)) / math.cos(math.radians(latitude))))) + 0.3
    return south, north, longitude - half, longitude + half


def nearest(points: DataFrame, latitude: float, longitude: float, k: int, *,
            key: str = "norad_cat_id") -> DataFrame:
    """The k points nearest to a place; ties by key. Each task keeps k rows at most."""
    return distances_from(points, latitude, longitude).orderBy("distance_km", key).limit(k)


def _cells_in_reach(places: DataFrame, reach_km: str) -> DataFrame:
    """Explode each place into the grid cells its circle can touch.

    The circle of angular radius r around latitude f spans f-r..f+r, and in longitude
    asin(sin r / cos f) either side, or everything if it contains a pole. Both are widened
    by a hundredth of a degree plus the difference between geodetic and geocentric latitude.
    """
    lat, lon = F.col("observer_latitude_deg"), F.col("observer_longitude_deg")
    sized = places.withColumn(
        "_r", F.least(F.col(reach_km) / geo.KM_PER_DEGREE_MIN + 0.3, F.lit(180.0))
    ).withColumn(
        "_dl",
        F.when((F.abs(lat) + F.col("_r") >= 89.9) | (F.col("_r") >= 89.9), F.lit(180.0))
        .otherwise(
            F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians("_r")) / F.cos(F.radians(lat)))))
            + 0.3
        ),
    )
    low = F.floor((lon - F.col("_dl") + 180.0) / geo.CELL_DEG).cast("int")
    high = F.floor((lon + F.col("_dl") + 180.0) / geo.CELL_DEG).cast("int")
    all_around = (high - low) >= geo.LON_CELLS - 1
    columns = F.when(all_around, F.sequence(F.lit(0), F.lit(geo.LON_CELLS - 1))).otherwise(
        F.sequence(low, high)
    )
    bands = F.sequence(
        geo.lat_band(F.greatest(lat - F.col("_r"), F.lit(-90.0))),
        geo.lat_band(F.least(lat + F.col("_r"), F.lit(90.0))),
    )
    return (
        sized.withColumn("_band", F.explode(bands))
        .withColumn("_column", F.explode(columns))
        .withColumn(
            "geo_cell", F.col("_band") * geo.LON_CELLS + F.pmod("_column", F.lit(geo.LON_CELLS))
        )
        .drop("_r", "_dl", "_band", "_column")
    )


def _with_cell(points: DataFrame) -> DataFrame:
    """Points with their grid cell, to be used as a join key.

    The cell passes through a one-element generator: the optimizer traces join keys back
    through projections by substitution, which would unfold a computed position.
    """
    cell = geo.geo_cell(F.col("latitude_deg"), F.col("longitude_deg"))
    return points.withColumn("geo_cell", F.explode(F.array(cell)))


def _measured(pairs: DataFrame) -> DataFrame:
    return geo.with_distance(pairs, "observer_latitude_deg", "observer_longitude_deg")


def within_radius_of(points: DataFrame, places: DataFrame, radius_km: float) -> DataFrame:
    """Pairs of point and place at most `radius_km` apart, for many places.

    An equality join on the grid cell: each place is listed under every cell its circle
    touches, so only points in those cells are compared.
    """
    reach = _cells_in_reach(places.withColumn("_reach", F.lit(float(radius_km))), "_reach")
    pairs = _with_cell(points).join(reach.drop("_reach"), "geo_cell")
    return _measured(pairs).where(F.col("distance_km") <= radius_km).drop("geo_cell")


#: Levels of the counting grid: cells of a quarter degree, doubling eight times.
_FINEST_DEG, _LEVELS = 0.25, 9
_KM_PER_DEGREE_MAX, _EVERYWHERE_KM = 111.8, 20_100.0


def _grid(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Band and column of the finest level."""
    bands, columns = int(180 / _FINEST_DEG), int(360 / _FINEST_DEG)
    return (
        F.least(F.floor((lat + 90.0) / _FINEST_DEG), F.lit(bands - 1)).cast("int"),
        F.pmod(F.floor((lon + 180.0) / _FINEST_DEG), F.lit(columns)).cast("int"),
    )


def _level_cell(level: int, band: Column, column: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), (band * 10_000 + column).alias("cell"))


def _level_counts(points: DataFrame) -> DataFrame:
    """Points of every cell on every level, rolled up from the finest."""
    band, column = _grid(F.col("latitude_deg"), F.col("longitude_deg"))
    finest = points.select(band.alias("b"), column.alias("c")).groupBy("b", "c").agg(
        F.count(F.lit(1)).alias("n"))
    levels = F.array(*[
        _level_cell(i, F.shiftright("b", i), F.shiftright("c", i)) for i in range(_LEVELS)])
    return (
        finest.select("n", F.explode(levels).alias("l")).groupBy("l.level", "l.cell")
        .agg(F.sum("n").alias("n"))
    )


def _cells_around() -> Column:
    """A place's cell and those around it, on every level; bands end at the poles."""
    b, c = _grid(F.col("observer_latitude_deg"), F.col("observer_longitude_deg"))
    out = []
    for i in range(_LEVELS):
        columns = -(-int(360 / _FINEST_DEG) // (1 << i))
        for up in (-1, 0, 1):
            for right in (-1, 0, 1):
                out.append(_level_cell(
                    i, F.shiftright(b, i) + up, F.pmod(F.shiftright(c, i) + right, F.lit(columns))))
    return F.array(*out)


def nearest_to(points: DataFrame, places: DataFrame, k: int, *,
               key: str = "norad_cat_id") -> DataFrame:
    """The k nearest points of every place.

    Points are counted per grid cell on levels of doubling cell size. For each place, the finest
    level is taken on which its cell and the eight around it hold k points: they bound the
    distance of the k-th neighbour, so only cells within that reach are joined. The reach shrinks
    where points are dense. The answer is exact; the bound only decides which points are compared.
    The counts are bounded by the grid, and a place meets nine of them on each level.
    """
    counts = _level_counts(points)
    around = places.withColumn("_at", F.explode(_cells_around()))
    found = (
        around.select("observer_id", "_at.level", "_at.cell").join(counts, ["level", "cell"])
        .groupBy("observer_id", "level").agg(F.sum("n").alias("n")).where(F.col("n") >= k)
        .groupBy("observer_id").agg(F.min("level").alias("level"))
    )
    # Two cells to either side in latitude and longitude, and some room for the ellipsoid.
    side = F.lit(2.0 * _FINEST_DEG) * F.pow(F.lit(2.0), F.col("level"))
    bound = places.select("observer_id").join(found, "observer_id", "left").select(
        "observer_id",
        F.least(
            F.lit(_EVERYWHERE_KM),
            F.coalesce(F.lit(2.0**0.5) * side * F.lit(_KM_PER_DEGREE_MAX) + 5.0, F.lit(_EVERYWHERE_KM)),
        ).alias("_reach"),
    )
    reach = _cells_in_reach(places.join(bound, "observer_id"), "_reach").drop("_reach")
    pairs = _measured(_with_cell(points).join(reach, "geo_cell"))
    w = Window.partitionBy("observer_id").orderBy("distance_km", key)
    # row_number <= k is applied in every map task before the shuffle.
    return (
        pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        .drop("geo_cell")
    )
