"""Orbit tracks and paths across the antimeridian."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger import fixtures as fx
from skyledger.operators import tracks as ops
from skyledger.queries import base
from skyledger.queries.base import AT, AT_SQL, KERNEL, geodetic_sql, gmst_sql, j2_sql, jd_sql, query, r, rounded

SAMPLES = 90


def _track_sql(ground: bool) -> str:
    steps = SAMPLES if ground else SAMPLES - 1
    source = (
        "(SELECT *, 1440e0 / cast(mean_motion AS DOUBLE) AS period_minutes FROM fact CROSS JOIN "
        f"(SELECT unnest(range(0, {SAMPLES})) AS sample_idx) WHERE mean_motion > 0)"
    )
    states = j2_sql(
        source, f"{base.DT} + sample_idx * (period_minutes * 60e0 / {steps})"
    )
    jd = jd_sql(AT_SQL) + (f" + sample_idx * (period_minutes / {1440.0 * steps}e0)" if ground else "")
    turned = f"""SELECT *, position_x_km * cos(th) + position_y_km * sin(th) AS ex,
  position_y_km * cos(th) - position_x_km * sin(th) AS ey, position_z_km AS ez
  FROM (SELECT *, {gmst_sql(jd)} AS th FROM ({states}))"""
    return geodetic_sql(turned)


def _register(name: str, ground: bool) -> None:
    @query(name, "fact", f"""
SELECT norad_cat_id, cast(sample_idx AS INTEGER) AS sample_idx, {r('period_minutes')},
  {r('latitude_deg')}, {r('longitude_deg')}, {r('altitude_km')} FROM ({_track_sql(ground)})""")
    def run(spark, sf):
        rows = ops.orbit_tracks(
            base.fact(spark, sf), AT, samples=SAMPLES, ground_track=ground, kernel=KERNEL
        )
        return rounded(
            rows.select(
                "norad_cat_id", "sample_idx", "period_minutes",
                "latitude_deg", "longitude_deg", "altitude_km",
            )
        )


_register("ground_track", True)
_register("orbit_path", False)


@query("tracks_batch", "fact", f"""
SELECT norad_cat_id, count(*) AS n_points, {r('min(altitude_km)', 'min_alt')}, {r('max(altitude_km)', 'max_alt')}
FROM ({_track_sql(True)}) GROUP BY norad_cat_id HAVING count(*) >= 2""")
def tracks_batch(spark, sf):
    rows = ops.orbit_tracks(base.fact(spark, sf), AT, samples=SAMPLES, kernel=KERNEL)
    return rounded(
        rows.groupBy("norad_cat_id").agg(
            F.count(F.lit(1)).alias("n_points"),
            F.min("altitude_km").alias("min_alt"), F.max("altitude_km").alias("max_alt"),
        )
    )


@query("track_closure", "fact", f"""
SELECT norad_cat_id, round(g - 360e0 * floor(g / 360e0) - 180e0, 4) + 0e0 AS lon_gap_deg, {r('lat_gap_deg')}
FROM (SELECT norad_cat_id, max_by(longitude_deg, sample_idx) - min_by(longitude_deg, sample_idx) + 180e0 AS g,
  max_by(latitude_deg, sample_idx) - min_by(latitude_deg, sample_idx) AS lat_gap_deg
  FROM ({_track_sql(False)}) GROUP BY norad_cat_id)""")
def track_closure(spark, sf):
    rows = ops.orbit_tracks(
        base.fact(spark, sf), AT, samples=SAMPLES, ground_track=False, kernel=KERNEL
    )
    return rounded(ops.track_closure(rows))


_STEP = """lag(longitude_deg) OVER w AS lon0, lead(longitude_deg) OVER w AS lon1"""
_SPLIT = """SELECT *, sum(CASE WHEN abs(longitude_deg - lon0) > 180 THEN 1 ELSE 0 END) OVER w AS segment
  FROM (SELECT *, {step} FROM ({source}) WINDOW w AS (PARTITION BY norad_cat_id ORDER BY sample_idx))
  WINDOW w AS (PARTITION BY norad_cat_id ORDER BY sample_idx ROWS UNBOUNDED PRECEDING)"""
_SPLIT_KEPT = """SELECT * FROM ({split}) WHERE NOT (
    (lon0 IS NULL OR abs(longitude_deg - lon0) > 180) AND (lon1 IS NULL OR abs(lon1 - longitude_deg) > 180))
  OR (lon0 IS NULL AND lon1 IS NULL)"""
_UNWRAP = """SELECT *, longitude_deg + sum(CASE WHEN longitude_deg - lon0 > 180 THEN -360e0
    WHEN longitude_deg - lon0 < -180 THEN 360e0 ELSE 0e0 END) OVER w AS unwrapped_lon_deg
  FROM (SELECT *, {step} FROM ({source}) WINDOW w AS (PARTITION BY norad_cat_id ORDER BY sample_idx))
  WINDOW w AS (PARTITION BY norad_cat_id ORDER BY sample_idx ROWS UNBOUNDED PRECEDING)"""


def _split(source: str) -> str:
    return _SPLIT_KEPT.format(split=_SPLIT.format(step=_STEP, source=source))


def _unwrap(source: str) -> str:
    return _UNWRAP.format(step=_STEP, source=source)


@query("split_antimeridian", "track_points", f"""
SELECT norad_cat_id, sample_idx, cast(segment AS INTEGER) AS segment, longitude_deg
FROM ({_split('SELECT * FROM track_points')})""")
def split_antimeridian(spark, sf):
    return ops.split_antimeridian(fx.track_points(spark, sf)).select(
        "norad_cat_id", "sample_idx", "segment", "longitude_deg"
    )


@query("unwrap_longitude", "track_points", f"""
SELECT norad_cat_id, sample_idx, unwrapped_lon_deg FROM ({_unwrap('SELECT * FROM track_points')})""")
def unwrap_longitude(spark, sf):
    return ops.unwrap_longitude(fx.track_points(spark, sf)).select(
        "norad_cat_id", "sample_idx", "unwrapped_lon_deg"
    )


def _milli(c: str) -> str:
    return f"cast(cast(round({c} * 1000) AS BIGINT) AS VARCHAR)"


def _paths(name: str, globe: bool) -> None:
    if globe:
        source = f"SELECT *, 0 AS seg FROM ({_unwrap(_track_sql(False))})"
        point = f"{_milli('unwrapped_lon_deg')} || ' ' || {_milli('latitude_deg')} || ' ' || {_milli('altitude_km * 2e0')}"
    else:
        source = f"SELECT *, segment AS seg FROM ({_split(_track_sql(True))})"
        point = f"{_milli('longitude_deg')} || ' ' || {_milli('latitude_deg')}"

    @query(name, "fact", f"""
SELECT norad_cat_id, object_name, cast(seg AS INTEGER) AS segment, count(*) AS n_points,
  round_even(period_minutes, 1) + 0e0 AS period_minutes, string_agg({point}, ';' ORDER BY sample_idx) AS path
FROM ({source}) GROUP BY norad_cat_id, object_name, seg, period_minutes""")
    def run(spark, sf):
        tracks = ops.orbit_tracks(
            base.fact(spark, sf), AT, samples=SAMPLES, ground_track=not globe, kernel=KERNEL
        )
        paths = ops.tracks_to_paths(tracks, globe=globe, exaggeration=2.0)
        scale = (1000, 1000, 1)  # degrees to thousandths; heights already are in metres
        text = F.array_join(
            F.transform(
                "path",
                lambda p: F.concat_ws(" ", *[
                    F.round(p[i] * scale[i]).cast("long").cast("string")
                    for i in range(3 if globe else 2)
                ]),
            ), ";",
        )
        return paths.select(
            "norad_cat_id", "object_name", "segment", F.size("path").cast("long").alias("n_points"),
            base.rnd("period_minutes", 1).alias("period_minutes"), text.alias("path"),
        )


_paths("tracks_to_paths", False)
_paths("tracks_to_paths_globe", True)
