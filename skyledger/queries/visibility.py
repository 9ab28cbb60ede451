"""Look angles, visibility and passes."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger import fixtures as fx
from skyledger.functions import frames
from skyledger.operators import enrich
from skyledger.operators import visibility as ops
from skyledger.queries import base
from skyledger.queries.base import (
    AT, AT_SQL, KERNEL, ecef_from_geodetic_sql, ecef_from_teme_sql, j2_sql, jd_sql, look_sql,
    query, r, rounded,
)

BERLIN = (-1, *fx.BERLIN)
BERLIN_SQL = (
    "(SELECT * FROM observers WHERE observer_id = -1)"
)
ANGLES = f"{r('azimuth_deg')}, {r('elevation_deg')}, {r('range_km')}"


def _looking(source: str) -> str:
    return look_sql(ecef_from_geodetic_sql(source, "latitude_deg", "longitude_deg", "altitude_km"))


@query("look_angles", "positions observers", f"""
SELECT norad_cat_id, {ANGLES} FROM ({_looking(f'SELECT * FROM positions CROSS JOIN {BERLIN_SQL}')})""")
def look_angles(spark, sf):
    seen = ops.look_angles(base.positions(spark, sf), [BERLIN])
    return rounded(seen.select("norad_cat_id", "azimuth_deg", "elevation_deg", "range_km"))


@query("observer_cross", "geo_points observers", f"""
SELECT point_id, observer_id, {ANGLES}
FROM ({_looking('SELECT p.*, o.* FROM geo_points p CROSS JOIN observers o')})""")
def observer_cross(spark, sf):
    seen = ops.look_angles(fx.geo_points(spark, sf), fx.observers(spark, sf))
    return rounded(
        seen.select("point_id", "observer_id", "azimuth_deg", "elevation_deg", "range_km")
    )


_NOW = _looking(f"SELECT * FROM sky CROSS JOIN {BERLIN_SQL}")


@query("filter_visible", "positions observers", f"""
SELECT norad_cat_id, {ANGLES}
FROM ({_looking(f'SELECT * FROM positions CROSS JOIN {BERLIN_SQL}')}) WHERE elevation_deg >= 10""")
def filter_visible(spark, sf):
    seen = ops.filter_visible(ops.look_angles(base.positions(spark, sf), [BERLIN]), 10.0)
    return rounded(seen.select("norad_cat_id", "azimuth_deg", "elevation_deg", "range_km"))


@query("visible_now", "sky observers", f"""
SELECT norad_cat_id, object_name, orbit_regime, is_stale, {r('speed_km_s')}, {ANGLES}
FROM ({_NOW}) WHERE elevation_deg >= 0 AND orbit_regime IN ('MEO', 'GEO/HEO') AND altitude_km BETWEEN 300 AND 40000""")
def visible_now(spark, sf):
    shown = enrich.dashboard_filter(regimes=["MEO", "GEO/HEO"], altitude_range=(300.0, 40000.0))
    seen = ops.visible_now(base.sky(spark, sf), [BERLIN], shown=shown)
    return rounded(
        seen.select(
            "norad_cat_id", "object_name", "orbit_regime", "is_stale", "speed_km_s",
            "azimuth_deg", "elevation_deg", "range_km",
        )
    )


_ALL_PAIRS = _looking("SELECT p.*, o.* FROM positions p CROSS JOIN observers o")


@query("visible_pairs", "positions observers", f"""
SELECT norad_cat_id, observer_id, {ANGLES} FROM ({_ALL_PAIRS}) WHERE elevation_deg >= 5""")
def visible_pairs(spark, sf):
    located = frames.with_ecef_from_geodetic(base.positions(spark, sf))
    seen = ops.visible_pairs(located, fx.observers(spark, sf), 5.0)
    return rounded(
        seen.select("norad_cat_id", "observer_id", "azimuth_deg", "elevation_deg", "range_km")
    )


@query("visible_counts", "positions observers", f"""
SELECT observer_id, count(*) FILTER (WHERE elevation_deg >= 0) AS above_0,
  count(*) FILTER (WHERE elevation_deg >= 10) AS above_10,
  count(*) FILTER (WHERE elevation_deg >= 30) AS above_30
FROM ({_ALL_PAIRS}) GROUP BY observer_id""")
def visible_counts(spark, sf):
    return ops.visible_counts(base.positions(spark, sf), fx.observers(spark, sf))


def _series_sql(observers: str, samples: int, step: int) -> str:
    states = j2_sql(
        f"(SELECT * FROM fact CROSS JOIN (SELECT unnest(range(0, {samples})) AS sample_idx))",
        f"{base.DT} + sample_idx * {step}e0",
    )
    timed = f"SELECT *, {AT_SQL} + to_seconds(sample_idx * {step}) AS ts FROM ({states})"
    ecef = ecef_from_teme_sql(timed, jd_sql("ts"))
    return look_sql(
        "SELECT norad_cat_id, object_name, sample_idx, ts, ex, ey, ez, o.* "
        f"FROM ({ecef}) CROSS JOIN {observers} o"
    )


def _passes_sql(source: str, keys: str, limit: float, samples: int) -> str:
    up = f"SELECT * FROM ({source}) WHERE elevation_deg >= {limit}"
    runs = f"SELECT *, sample_idx - row_number() OVER (PARTITION BY {keys} ORDER BY sample_idx) AS run FROM ({up})"
    return f"""SELECT {keys}, min(ts) AS start_utc, {r('min_by(azimuth_deg, sample_idx)', 'start_azimuth_deg')},
  arg_max(ts, (elevation_deg, -sample_idx)) AS peak_utc,
  {r('arg_max(azimuth_deg, (elevation_deg, -sample_idx))', 'peak_azimuth_deg')},
  {r('max(elevation_deg)', 'peak_elevation_deg')}, max(ts) AS end_utc,
  {r('max_by(azimuth_deg, sample_idx)', 'end_azimuth_deg')},
  {r('(epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7', 'duration_minutes')},
  min(sample_idx) = 0 OR max(sample_idx) = {samples - 1} AS truncated, 'j2' AS kernel_used
FROM ({runs}) GROUP BY {keys}, run HAVING count(*) >= 2"""


@query("look_angle_series", "fact observers", f"""
SELECT norad_cat_id, cast(sample_idx AS INTEGER) AS sample_idx, ts, {ANGLES}
FROM ({_series_sql(BERLIN_SQL, 8640, 30)})""")
def look_angle_series(spark, sf):
    series = ops.look_angle_series(base.fact(spark, sf), [BERLIN], AT, kernel=KERNEL)
    return rounded(
        series.select(
            "norad_cat_id", "sample_idx", "ts", "azimuth_deg", "elevation_deg", "range_km"
        )
    )


KEYS = "norad_cat_id, object_name, observer_id"


@query("find_passes", "fact observers", _passes_sql(_series_sql(BERLIN_SQL, 8640, 30), KEYS, 10.0, 8640))
def find_passes(spark, sf):
    return rounded(
        ops.find_passes(
            base.fact(spark, sf), [BERLIN], AT, kernel=KERNEL
        )
    )


@query("find_passes_many", "fact observers", _passes_sql(_series_sql("observers", 8640, 30), KEYS, 10.0, 8640))
def find_passes_many(spark, sf):
    return rounded(
        ops.find_passes(
            base.fact(spark, sf), fx.observers(spark, sf), AT, kernel=KERNEL
        )
    )


@query("passes_in_time_order", "fact observers", f"""
SELECT norad_cat_id, start_utc, duration_minutes FROM
({_passes_sql(_series_sql(BERLIN_SQL, 8640, 30), KEYS, 30.0, 8640)}) ORDER BY start_utc, norad_cat_id""")
def passes_in_time_order(spark, sf):
    found = ops.find_passes(
        base.fact(spark, sf), [BERLIN], AT, minimum_elevation=30.0, kernel=KERNEL,
    )
    return rounded(
        found.orderBy("start_utc", "norad_cat_id").select(
            "norad_cat_id", "start_utc", "duration_minutes"
        )
    )


@query("find_passes_sgp4")
def find_passes_sgp4(spark, sf):
    return rounded(
        ops.find_passes(base.fact(spark, sf), [BERLIN], AT, kernel="sgp4")
    )


_ISLANDS = """
SELECT norad_cat_id, observer_id, min(ts) AS start_utc, min_by(azimuth_deg, sample_idx) AS start_azimuth_deg,
  arg_max(ts, (elevation_deg, -sample_idx)) AS peak_utc,
  arg_max(azimuth_deg, (elevation_deg, -sample_idx)) AS peak_azimuth_deg,
  max(elevation_deg) AS peak_elevation_deg, max(ts) AS end_utc,
  max_by(azimuth_deg, sample_idx) AS end_azimuth_deg,
  round((epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7, 4) + 0e0 AS duration_minutes,
  min(pos) = 1 OR max(pos) = max(n) AS truncated
FROM (SELECT *, pos - row_number() OVER (PARTITION BY norad_cat_id, observer_id ORDER BY pos) AS run
  FROM (SELECT *, row_number() OVER (PARTITION BY norad_cat_id, observer_id ORDER BY sample_idx) AS pos,
          count(*) OVER (PARTITION BY norad_cat_id, observer_id) AS n FROM elevation_series)
  WHERE elevation_deg >= 10)
GROUP BY norad_cat_id, observer_id, run HAVING count(*) >= 2"""


@query("pass_islands", "elevation_series", _ISLANDS)
def pass_islands(spark, sf):
    return rounded(ops.pass_islands(fx.elevation_series(spark, sf), minimum_elevation=10.0))


def _part(name: str, *columns: str) -> None:
    chosen = ("norad_cat_id", "observer_id", "start_utc", *columns)

    @query(name, "elevation_series", f"SELECT {', '.join(chosen)} FROM ({_ISLANDS})")
    def run(spark, sf):
        found = ops.pass_islands(fx.elevation_series(spark, sf), minimum_elevation=10.0)
        return rounded(found.select(*chosen))


_part("pass_peak", "peak_utc", "peak_azimuth_deg", "peak_elevation_deg")
_part("pass_truncated", "truncated")
_part("pass_edges", "start_azimuth_deg", "end_utc", "end_azimuth_deg", "duration_minutes")


@query("grid_cross", "fact", """
SELECT norad_cat_id, count(*) AS n_samples, min(ts) AS first_ts, max(ts) AS last_ts FROM (
  SELECT norad_cat_id, TIMESTAMP '2001-09-01 00:00:00' + to_seconds(i * 30) AS ts
  FROM fact CROSS JOIN (SELECT unnest(range(0, 120)) AS i)) GROUP BY norad_cat_id""")
def grid_cross(spark, sf):
    grid = base.fact(spark, sf).select(
        "norad_cat_id", F.explode(F.sequence(F.lit(0), F.lit(119))).alias("i")
    )
    ts = F.timestamp_micros(F.unix_micros(fx.snapshot_ts()) + F.col("i") * F.lit(30_000_000).cast("long"))
    return grid.withColumn("ts", ts).groupBy("norad_cat_id").agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )
