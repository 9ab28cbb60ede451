"""Frames, propagation, enriched positions and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyledger import fixtures as fx
from skyledger.functions import frames, orbit
from skyledger.operators import enrich, gold, silver, summaries
from skyledger.operators.propagate import propagate, propagate_all, propagate_grid
from skyledger.plans import warehouse
from skyledger.queries import base
from skyledger.queries.base import (
    AT, AT_SQL, KERNEL, ecef_from_geodetic_sql, ecef_from_teme_sql, geodetic_sql,
    gmst_sql, j2_sql, jd_sql, query, r, rnd, rounded,
)
from skyledger.schemas import POSITION_COLUMNS
from skyledger.session import scratch_path

POSITION_DOUBLES = POSITION_COLUMNS[3:]
POSITIONS_SQL = "SELECT norad_cat_id, snapshot_ts, epoch, " + ", ".join(
    r(c) for c in POSITION_DOUBLES
) + " FROM positions"


@query("gmst", "geo_points", f"SELECT point_id, round({gmst_sql(jd_sql('seen_at'))}, 8) + 0e0 AS gmst_rad FROM geo_points")
def gmst(spark, sf):
    angle = frames.gmst_radians(frames.julian_date(F.col("seen_at")))
    return fx.geo_points(spark, sf).select("point_id", rnd(angle, 8).alias("gmst_rad"))


@query("julian_split", "geo_points", """
SELECT point_id, 2440587.5e0 + (epoch_us(ts) - epoch_us(ts) % 86400000000) / 8.64e10 AS jd_day,
  round((epoch_us(ts) % 86400000000) / 8.64e10, 8) AS jd_fraction FROM
  (SELECT point_id, seen_at + to_seconds(point_id * 7919 % 86400) AS ts FROM geo_points)""")
def julian_split(spark, sf):
    at = F.timestamp_micros(
        F.unix_micros("seen_at") + F.col("point_id") * 7919 % 86400 * 1_000_000
    )
    day, fraction = frames.julian_day_and_fraction(at)
    return fx.geo_points(spark, sf).select(
        "point_id", day.alias("jd_day"), rnd(fraction, 8).alias("jd_fraction")
    )


ECEF = ("ecef_x_km", "ecef_y_km", "ecef_z_km")


@query("geodetic_to_ecef", "geo_points", f"""
SELECT point_id, {r('ex', 'ecef_x_km')}, {r('ey', 'ecef_y_km')}, {r('ez', 'ecef_z_km')}
FROM ({ecef_from_geodetic_sql('SELECT * FROM geo_points', 'latitude_deg', 'longitude_deg', 'altitude_km')})""")
def geodetic_to_ecef(spark, sf):
    return rounded(
        frames.with_ecef_from_geodetic(fx.geo_points(spark, sf)).select("point_id", *ECEF)
    )


_ECEF_ONLY = ecef_from_geodetic_sql(
    "SELECT * FROM geo_points", "latitude_deg", "longitude_deg", "altitude_km"
)
_BACK = geodetic_sql(f"SELECT point_id, ex, ey, ez FROM ({_ECEF_ONLY})")


@query("geodetic_roundtrip", "geo_points", f"""
SELECT point_id, {r('latitude_deg')}, {r('longitude_deg')}, {r('altitude_km')} FROM ({_BACK})""")
def geodetic_roundtrip(spark, sf):
    ecef = frames.with_ecef_from_geodetic(fx.geo_points(spark, sf)).select("point_id", *ECEF)
    return rounded(frames.with_geodetic_from_ecef(ecef).drop(*ECEF))


@query("teme_to_ecef", "states", f"""
SELECT norad_cat_id, {r('ex', 'ecef_x_km')}, {r('ey', 'ecef_y_km')}, {r('ez', 'ecef_z_km')}
FROM ({ecef_from_teme_sql('SELECT * FROM states', jd_sql(AT_SQL))})""")
def teme_to_ecef(spark, sf):
    at = frames.julian_date(fx.snapshot_ts())
    return rounded(
        frames.with_ecef_from_teme(base.positions(spark, sf), at).select("norad_cat_id", *ECEF)
    )


@query("teme_to_geodetic", "positions", f"""
SELECT norad_cat_id, {r('latitude_deg')}, {r('longitude_deg')}, {r('altitude_km')} FROM positions""")
def teme_to_geodetic(spark, sf):
    states = base.positions(spark, sf).drop("latitude_deg", "longitude_deg", "altitude_km")
    at = frames.julian_date(fx.snapshot_ts())
    return rounded(
        frames.with_geodetic_from_teme(states, at).select(
            "norad_cat_id", "latitude_deg", "longitude_deg", "altitude_km"
        )
    )


@query("period_minutes", "fact", """
SELECT norad_cat_id, round(1440e0 / cast(mean_motion AS DOUBLE), 6) AS period_minutes FROM fact""")
def period_minutes(spark, sf):
    period = orbit.period_minutes(F.col("mean_motion"))
    return base.fact(spark, sf).select("norad_cat_id", rnd(period, 6).alias("period_minutes"))


@query("propagate_catalogue", "positions", POSITIONS_SQL)
def propagate_catalogue(spark, sf):
    return rounded(base.positions(spark, sf))


@query("propagate_catalogue_sgp4")
def propagate_catalogue_sgp4(spark, sf):
    return rounded(propagate(base.fact(spark, sf), AT, kernel="sgp4"))


_GRID_DT = f"(epoch_us({AT_SQL}) - epoch_us(epoch)) / 1e6 + sample_idx * 600e0"
_GRID = j2_sql("(SELECT * FROM fact CROSS JOIN (SELECT unnest(range(0, 12)) AS sample_idx))", _GRID_DT)
_GRID_TS = f"({AT_SQL} + to_seconds(sample_idx * 600))"


@query("propagate_grid", "fact", f"""
SELECT norad_cat_id, cast(sample_idx AS INTEGER) AS sample_idx, {_GRID_TS} AS snapshot_ts,
  {r('latitude_deg')}, {r('longitude_deg')}, {r('altitude_km')}
FROM ({geodetic_sql(ecef_from_teme_sql(_GRID, jd_sql(_GRID_TS)))})""")
def grid(spark, sf):
    rows = propagate_grid(base.fact(spark, sf), AT, samples=12, step_seconds=600, kernel=KERNEL)
    return rounded(
        rows.select(
            "norad_cat_id", "sample_idx", "snapshot_ts",
            "latitude_deg", "longitude_deg", "altitude_km",
        )
    )


@query("decline_count", "fact", f"""
SELECT error_code, count(*) AS n FROM (
  SELECT CASE WHEN mm <= 0 THEN 2 WHEN e < 0 OR e >= 1 THEN 1
    WHEN pow({base.num(orbit.MU_KM3_S2)} / pow(mm * {base.num(2 * 3.141592653589793 / 86400)}, 2), {base.num(1 / 3)})
         * (1e0 - e) < {base.num(orbit.EARTH_RADIUS_KM)} THEN 6 ELSE 0 END AS error_code
  FROM (SELECT cast(mean_motion AS DOUBLE) AS mm, cast(eccentricity AS DOUBLE) AS e FROM fact))
GROUP BY error_code""")
def decline_count(spark, sf):
    return summaries.decline_counts(propagate_all(base.fact(spark, sf), AT, kernel=KERNEL))


@query("declined_instants", "fact", f"""
SELECT norad_cat_id, CASE WHEN
    pow({base.num(orbit.MU_KM3_S2)} / pow(cast(mean_motion AS DOUBLE) * {base.num(2 * 3.141592653589793 / 86400)}, 2), {base.num(1 / 3)})
         * (1e0 - cast(eccentricity AS DOUBLE)) < {base.num(orbit.EARTH_RADIUS_KM)} THEN 12 ELSE 0 END AS n_declined
FROM fact""")
def declined_instants(spark, sf):
    rows = propagate_all(base.fact(spark, sf), AT, samples=12, step_seconds=600, kernel=KERNEL)
    return summaries.declined_instants(rows, ["norad_cat_id"], F.lit(12))


@query("epoch_age_hours", "fact", f"""
SELECT norad_cat_id, round((epoch_us({AT_SQL}) - epoch_us(epoch)) / 3.6e9, 6) AS epoch_age_hours FROM fact""")
def epoch_age_hours(spark, sf):
    age = orbit.age_hours(fx.snapshot_ts(), F.col("epoch"))
    return base.fact(spark, sf).select("norad_cat_id", rnd(age, 6).alias("epoch_age_hours"))


@query("speed", "sky", f"SELECT norad_cat_id, {r('speed_km_s')} FROM sky")
def speed(spark, sf):
    return rounded(
        base.positions(spark, sf).select("norad_cat_id", enrich.speed().alias("speed_km_s"))
    )


@query("attach_dimension", "elset dim_object", """
SELECT e.norad_cat_id, e.epoch, cast(e.inclination AS DOUBLE) AS inclination, d.object_name, object_type, orbit_regime, owner,
  cast(launch_date AS VARCHAR) AS launch_date, launch_site
FROM elset e LEFT JOIN dim_object d USING (norad_cat_id)""")
def attach_dimension(spark, sf):
    # Some element sets are of objects that the catalogue does not list: they must stay.
    rows = base.elset(spark, sf).select("norad_cat_id", "epoch", "inclination")
    return base.plain(enrich.attach_dimension(rows, base.dim(spark, sf)))


@query("snapshot_names", "positions dim_object", f"""
SELECT norad_cat_id, object_name, orbit_regime, {r('altitude_km')}
FROM positions JOIN dim_object USING (norad_cat_id)""")
def snapshot_names(spark, sf):
    named = base.positions(spark, sf).join(base.dim(spark, sf), "norad_cat_id")
    return rounded(named.select("norad_cat_id", "object_name", "orbit_regime", "altitude_km"))


@query("sky_stored", "sky", f"""
SELECT norad_cat_id, object_name, orbit_regime, owner, is_stale, {r('altitude_km')}, {r('speed_km_s')} FROM sky
WHERE orbit_regime = 'MEO' AND altitude_km BETWEEN 300 AND 40000""")
def sky_stored(spark, sf):
    """Two questions about one instant: the second reads what the first has stored."""
    root, shown = scratch_path(spark, "sky"), enrich.dashboard_filter(regimes=["MEO"], altitude_range=(300.0, 40000.0))
    fact, dim = base.fact(spark, sf), base.dim(spark, sf)
    warehouse.stored_sky(fact, dim, AT, root)
    sky = warehouse.stored_sky(fact, dim, AT, root).where(shown)
    return rounded(sky.select("norad_cat_id", "object_name", "orbit_regime", "owner", "is_stale", "altitude_km", "speed_km_s"))


@query("sky_refreshed", "sky", f"""
SELECT norad_cat_id, object_name, orbit_regime, {r('latitude_deg')}, {r('altitude_km')} FROM sky""")
def sky_refreshed(spark, sf):
    """The sky of an older catalogue, in which every fiftieth object had other elements, brought up
    to date: changed objects alone are propagated."""
    root, dim = scratch_path(spark, "sky"), base.dim(spark, sf)
    first = base.staged_gp(spark, sf).withColumn(
        "mean_motion", F.when(F.col("norad_cat_id") % 50 == 0, F.col("mean_motion") + 1)
        .otherwise(F.col("mean_motion")).cast("decimal(12,8)"))
    before = gold.fact_propagatable(silver.elset(first), dim)
    warehouse.stored_sky(before, dim, AT, root)
    sky = warehouse.refresh_sky(before, base.fact(spark, sf), dim, AT, root)
    return rounded(sky.select("norad_cat_id", "object_name", "orbit_regime", "latitude_deg", "altitude_km"))


# Every element set of the tables is weeks old at the snapshot. Seen from 800 hours earlier
# some are fresh and some lie in the future.
_EARLIER = f"""SELECT norad_cat_id, orbit_regime, {r('age', 'epoch_age_hours')},
  age > CASE orbit_regime WHEN 'LEO' THEN 48 WHEN 'GEO/HEO' THEN 96 WHEN 'MEO' THEN 168 ELSE 48 END AS is_stale
FROM (SELECT *, epoch_age_hours - 800 AS age FROM sky)"""


def _earlier(spark, sf):
    age = F.col("epoch_age_hours") - 800
    seen = base.sky(spark, sf).select("norad_cat_id", "orbit_regime", age.alias("epoch_age_hours"))
    return seen.withColumn(
        "is_stale", enrich.is_stale(F.col("epoch_age_hours"), F.col("orbit_regime"))
    )


@query("staleness", "sky", _EARLIER)
def staleness(spark, sf):
    return rounded(_earlier(spark, sf))


@query("filter_fresh", "sky", f"SELECT * FROM ({_EARLIER}) WHERE NOT is_stale")
def filter_fresh(spark, sf):
    return rounded(enrich.filter_positions(_earlier(spark, sf), hide_stale=True))


SKY_OUT = ("norad_cat_id", "object_name", "object_type", "orbit_regime", "owner",
           "launch_site_name", "is_stale", "altitude_km", "speed_km_s", "epoch_age_hours")
SKY_SQL = ", ".join(r(c) if c in ("altitude_km", "speed_km_s", "epoch_age_hours") else c
                    for c in SKY_OUT)


@query("sky_now", "sky", f"SELECT {SKY_SQL} FROM sky")
def sky_now(spark, sf):
    root = scratch_path(spark, "sky")
    for _ in range(2):  # the second time it is there already
        sky = warehouse.stored_sky(base.fact(spark, sf), base.dim(spark, sf), AT, root, kernel=KERNEL)
    return rounded(sky.select(*SKY_OUT))


def _filtered(name: str, where: str, **filters) -> None:
    @query(name, "sky", f"SELECT {SKY_SQL} FROM sky WHERE {where}")
    def run(spark, sf):
        return rounded(enrich.filter_positions(base.sky(spark, sf), **filters).select(*SKY_OUT))


_filtered("filter_membership", "orbit_regime IN ('LEO', 'MEO') AND object_type IN ('PAY', 'DEB')",
          regimes=["LEO", "MEO"], object_types=["PAY", "DEB"])
_filtered("filter_membership_empty", "false", regimes=[])
_filtered("filter_range", "altitude_km BETWEEN 500 AND 20000", altitude_range=(500.0, 20000.0))
_filtered("filter_name", "contains(lower(object_name), 'sat 1')", name_query="SAT 1")
_filtered("filter_name_regex", "regexp_matches(lower(object_name), 'sat (1|2)[0-9]$')",
          name_query="sat (1|2)[0-9]$", regex=True)
_filtered(
    "filter_combined",
    "orbit_regime IN ('MEO', 'GEO/HEO', 'unknown') AND object_type IN ('PAY', 'R/B') "
    "AND altitude_km BETWEEN 1000 AND 40000 AND contains(lower(object_name), 'sat')",
    regimes=["MEO", "GEO/HEO", "unknown"], object_types=["PAY", "R/B"],
    altitude_range=(1000.0, 40000.0), name_query="Sat",
)


@query("filter_ids", "positions", f"""
SELECT norad_cat_id, {r('altitude_km')} FROM positions
WHERE norad_cat_id IN (SELECT cast(user_id AS INTEGER) FROM events)""")
def filter_ids(spark, sf):
    ids = fx.table(spark, sf, "events").select(F.col("user_id").cast("int").alias("norad_cat_id"))
    chosen = base.positions(spark, sf).select("norad_cat_id", "altitude_km")
    return rounded(enrich.filter_ids(chosen, ids))


@query("altitude_extent", "positions", """
SELECT count(*) AS n_rows, cast(round(cast(min(altitude_km) AS DECIMAL(20,6)), 1) AS DOUBLE) AS min_alt,
  cast(round(cast(max(altitude_km) AS DECIMAL(20,6)), 1) AS DOUBLE) AS max_alt FROM positions""")
def altitude_extent(spark, sf):
    return base.plain(summaries.altitude_extent(base.positions(spark, sf)))


@query("max_altitude", "positions", f"SELECT {r('max(altitude_km)', 'max_altitude_km')} FROM positions")
def max_altitude(spark, sf):
    return rounded(summaries.max_altitude(base.positions(spark, sf)))


@query("dashboard_metrics", "sky", """
SELECT count(*) FILTER (WHERE orbit_regime IN ('LEO', 'MEO')) AS n_shown, count(*) AS n_total,
  count(*) FILTER (WHERE orbit_regime IN ('LEO', 'MEO') AND is_stale) AS n_stale FROM sky""")
def dashboard_metrics(spark, sf):
    shown = enrich.dashboard_filter(regimes=["LEO", "MEO"])
    return summaries.dashboard_metrics(base.sky(spark, sf), shown)


@query("distinct_options", "sky", """
SELECT DISTINCT 'orbit_regime' AS name, orbit_regime AS option FROM sky WHERE orbit_regime IS NOT NULL
UNION SELECT DISTINCT 'object_type', object_type FROM sky WHERE object_type IS NOT NULL""")
def distinct_options(spark, sf):
    return summaries.distinct_options(base.sky(spark, sf), ["orbit_regime", "object_type"])


@query("regime_age_table", "sky", """
SELECT orbit_regime, count(*) AS n_objects, round(avg(epoch_age_hours), 4) + 0e0 AS avg_age_h,
  count(*) FILTER (WHERE epoch_age_hours > 48) AS n_old,
  round(count(*) FILTER (WHERE epoch_age_hours > 48) * 100e0 / count(*), 4) + 0e0 AS pct_old
FROM sky GROUP BY orbit_regime""")
def regime_age_table(spark, sf):
    return rounded(summaries.regime_age_table(base.sky(spark, sf)))
