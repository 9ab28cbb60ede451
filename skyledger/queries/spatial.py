"""Distance, radius and nearest-object queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger import fixtures as fx
from skyledger.functions import geo
from skyledger.functions.sql import register_functions
from skyledger.operators import spatial
from skyledger.queries import base
from skyledger.queries.base import distance_sql, query, r, rounded
from skyledger.session import scratch_path
from skyledger.sources import snapshot

LAT, LON, _ = fx.BERLIN


def _from_berlin(view: str) -> str:
    return distance_sql(
        f"SELECT *, {base.num(LAT)} AS observer_latitude_deg, "
        f"{base.num(LON)} AS observer_longitude_deg FROM {view}"
    )


_PAIRS = distance_sql(
    "SELECT p.*, o.observer_id, o.observer_latitude_deg, o.observer_longitude_deg "
    "FROM positions p CROSS JOIN observers o"
)


@query("make_point", "positions", f"""
SELECT norad_cat_id, {r('longitude_deg', 'lon')}, {r('latitude_deg', 'lat')},
  cast(least(floor(latitude_deg + 90), 179) AS INTEGER) * 360
    + cast(floor(longitude_deg + 180) AS INTEGER) % 360 AS geo_cell FROM positions""")
def make_point(spark, sf):
    lat, lon = F.col("latitude_deg"), F.col("longitude_deg")
    return rounded(
        base.positions(spark, sf).select(
            "norad_cat_id", geo.geo_point(lat, lon).alias("p"), geo.geo_cell(lat, lon).alias("geo_cell")
        ).select("norad_cat_id", "p.lon", "p.lat", "geo_cell")
    )


@query("distance_km", "geo_points", f"""
SELECT point_id, {r('distance_km', places=3)} FROM ({_from_berlin('geo_points')})""")
def distance_km(spark, sf):
    points = fx.geo_points(spark, sf)
    return rounded(spatial.distances_from(points, LAT, LON).select("point_id", "distance_km"), 3)


@query("within_radius", "geo_points", f"""
SELECT point_id, {r('distance_km', places=3)} FROM ({_from_berlin('geo_points')}) WHERE distance_km <= 6000""")
def within_radius(spark, sf):
    near = spatial.within_radius(fx.geo_points(spark, sf), LAT, LON, 6000.0)
    return rounded(near.select("point_id", "distance_km"), 3)


@query("within_radius_stored", "positions", f"""
SELECT norad_cat_id, {r('distance_km', places=3)} FROM ({_from_berlin('positions')}) WHERE distance_km <= 2500""")
def within_radius_stored(spark, sf):
    """Around a place in a stored snapshot: files and row groups elsewhere are not read."""
    root = scratch_path(spark, "radius-snapshot")
    snapshot.write_snapshot(base.positions(spark, sf), root)
    near = spatial.within_radius(snapshot.read_snapshot(spark, root), LAT, LON, 2500.0)
    return rounded(near.select("norad_cat_id", "distance_km"), 3)


@query("within_radius_many", "positions observers", f"""
SELECT observer_id, norad_cat_id, {r('distance_km', places=3)} FROM ({_PAIRS}) WHERE distance_km <= 3000""")
def within_radius_many(spark, sf):
    near = spatial.within_radius_of(base.positions(spark, sf), fx.observers(spark, sf), 3000.0)
    return rounded(near.select("observer_id", "norad_cat_id", "distance_km"), 3)


@query("knn_observer", "positions dim_object", f"""
SELECT norad_cat_id, object_name, orbit_regime, round(distance_km, 0) + 0e0 AS km_away, round(altitude_km, 0) + 0e0 AS alt_km
FROM ({_from_berlin('positions')}) JOIN dim_object USING (norad_cat_id)
ORDER BY distance_km, norad_cat_id LIMIT 10""")
def knn_observer(spark, sf):
    # The k nearest positions first, names for those k only.
    near = spatial.nearest(base.positions(spark, sf), LAT, LON, 10)
    named = near.join(base.dim(spark, sf).select("norad_cat_id", "object_name", "orbit_regime"),
                      "norad_cat_id")
    return rounded(
        named.orderBy("distance_km", "norad_cat_id").select(
            "norad_cat_id", "object_name", "orbit_regime",
            F.col("distance_km").alias("km_away"), F.col("altitude_km").alias("alt_km"),
        ), 0,
    )


@query("knn_observers_many", "positions observers", f"""
SELECT observer_id, norad_cat_id, {r('distance_km', places=3)}, rk AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY observer_id ORDER BY distance_km, norad_cat_id) AS rk
  FROM ({_PAIRS})) WHERE rk <= 5""")
def knn_observers_many(spark, sf):
    # The positions are read several times, so they are stored first, as a snapshot is.
    root = scratch_path(spark, "knn-snapshot")
    snapshot.write_snapshot(base.positions(spark, sf), root)
    stored = snapshot.read_snapshot(spark, root).drop("geo_point", "geo_curve")
    near = spatial.nearest_to(stored, fx.observers(spark, sf), 5)
    return rounded(near.select("observer_id", "norad_cat_id", "distance_km", "rank"), 3)


@query("sql_functions", "geo_points", f"""
SELECT point_id, {r('distance_km', places=3)}, {r('ex', 'x')}, {r('ey', 'y')}, {r('ez', 'z')}
FROM ({base.ecef_from_geodetic_sql(_from_berlin('geo_points'), 'latitude_deg', 'longitude_deg', 'altitude_km')})""")
def sql_functions(spark, sf):
    register_functions(spark)
    fx.geo_points(spark, sf).createOrReplaceTempView("skyledger_geo_points")
    rows = spark.sql(f"""
        SELECT point_id, ground_distance_km({LAT}D, {LON}D, latitude_deg, longitude_deg) AS km,
               geodetic_to_ecef(latitude_deg, longitude_deg, altitude_km) AS p
        FROM skyledger_geo_points""")
    return rows.select(
        "point_id", base.rnd("km", 3).alias("distance_km"),
        *[base.rnd(F.col(f"p.{axis}")).alias(axis) for axis in "xyz"],
    )


_TEME = "SELECT point_id, seen_at, ex AS position_x_km, ey AS position_y_km, ez AS position_z_km FROM ({})".format(
    base.ecef_from_geodetic_sql("geo_points", "latitude_deg", "longitude_deg", "altitude_km"))
_FIXED = base.ecef_from_teme_sql(_TEME, base.jd_sql("seen_at"))


@query("sql_frames", "geo_points", f"""
SELECT point_id, {r('latitude_deg')}, {r('altitude_km')}, {r('sin(radians(longitude_deg))', 'sin_lon')},
  {r('sin(radians(azimuth_deg))', 'sin_az')}, {r('elevation_deg')}, {r('range_km')}
FROM ({base.look_sql(f"""SELECT *, {base.num(LAT)} AS observer_latitude_deg, {base.num(LON)} AS observer_longitude_deg,
  0e0 AS observer_altitude_km FROM ({base.geodetic_sql(_FIXED)})""")})""")
def sql_frames(spark, sf):
    """Frame conversions and look angles, called from SQL. The points stand for inertial positions."""
    register_functions(spark)
    fx.geo_points(spark, sf).createOrReplaceTempView("skyledger_geo_points")
    rows = spark.sql(f"""
        SELECT point_id, ecef_to_geodetic(f.x, f.y, f.z) AS g,
               look_angles({LAT}D, {LON}D, 0D, f.x, f.y, f.z) AS a
        FROM (SELECT *, teme_to_ecef(p.x, p.y, p.z, jd) AS f FROM (
          SELECT point_id, geodetic_to_ecef(latitude_deg, longitude_deg, altitude_km) AS p,
                 {base.num(base.frames.UNIX_EPOCH_JD)[:-2]}D + unix_micros(seen_at) / 8.64e10D AS jd FROM skyledger_geo_points))""")
    return rounded(rows.select(
        "point_id", "g.latitude_deg", "g.altitude_km", F.sin(F.radians("g.longitude_deg")).alias("sin_lon"),
        F.sin(F.radians("a.azimuth_deg")).alias("sin_az"), "a.elevation_deg", "a.range_km"))
