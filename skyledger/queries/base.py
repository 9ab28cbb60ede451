"""Shared pieces of the registered queries: layers in Spark, the same layers as SQL text.

The two sides share constants but no code: Spark plans come from the operators, the oracle
text is written out here. Degrees and kilometres are compared at four decimals.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyledger import fixtures as fx
from skyledger.functions import frames, orbit
from skyledger.operators import gold, silver
from skyledger.operators.enrich import with_display_attributes
from skyledger.operators.propagate import propagate
from skyledger.schemas import POSITION_COLUMNS

AT = fx.SNAPSHOT
AT_SQL = "TIMESTAMP '2001-09-01 00:00:00'"
KERNEL = "j2"
PLACES = 4
Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None = None


REGISTRY: dict[str, Query] = {}


def query(name: str, reads: str = "", sql: str | None = None):
    """Register a query; `reads` names the oracle views its SQL uses."""

    def register(run: Run) -> Run:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(run, compose(sql, reads.split()) if sql else None)
        return run

    return register


# ---- Spark layers ------------------------------------------------------------------------

def staged_gp(spark: SparkSession, sf: str) -> DataFrame:
    return silver.stage_gp(fx.raw_gp(spark, sf))


def staged_satcat(spark: SparkSession, sf: str) -> DataFrame:
    return silver.stage_satcat(fx.raw_satcat(spark, sf))


def elset(spark: SparkSession, sf: str) -> DataFrame:
    return silver.elset(staged_gp(spark, sf))


def space_object(spark: SparkSession, sf: str) -> DataFrame:
    return silver.space_object(staged_satcat(spark, sf))


def dim(spark: SparkSession, sf: str) -> DataFrame:
    return gold.dim_object(space_object(spark, sf))


def fact(spark: SparkSession, sf: str) -> DataFrame:
    return gold.fact_propagatable(elset(spark, sf), dim(spark, sf))


def positions(spark: SparkSession, sf: str) -> DataFrame:
    return propagate(fact(spark, sf), AT, kernel=KERNEL).select(*POSITION_COLUMNS)


def sky(spark: SparkSession, sf: str) -> DataFrame:
    return with_display_attributes(positions(spark, sf), dim(spark, sf))


#: Integer columns that hold NULLs; client libraries disagree on their type.
NULLABLE_INTEGERS = ("apogee_km", "perigee_km")


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and dates as text, so that engines agree on the value."""
    out = []
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        c = F.col(field.name)
        if kind.startswith("decimal") or field.name in NULLABLE_INTEGERS:
            c = c.cast("double")
        elif kind == "date":
            c = c.cast("string")
        out.append(c.alias(field.name))
    return df.select(*out)


def rounded(df: DataFrame, places: int = PLACES) -> DataFrame:
    """Round every double column (and never return a negative zero)."""
    out = [
        (F.round(F.col(f.name), places) + F.lit(0.0)).alias(f.name)
        if f.dataType.simpleString() == "double" else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*out)


def rnd(column: Column | str, places: int = PLACES) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, places) + F.lit(0.0)


# ---- The same layers as SQL --------------------------------------------------------------

def num(x: float) -> str:
    """A DOUBLE literal."""
    text = repr(float(x))
    return text if "e" in text else text + "e0"


def r(expression: str, name: str | None = None, places: int = PLACES) -> str:
    return f"round({expression}, {places}) + 0e0 AS {name or expression}"


GP_CASTS = ", ".join(
    f"cast({c} AS {t}) AS {c}" for c, t in {
        "norad_cat_id": "INTEGER", "epoch": "TIMESTAMP", "object_name": "VARCHAR",
        "object_id": "VARCHAR", "classification_type": "VARCHAR",
        "mean_motion": "DECIMAL(12,8)", "eccentricity": "DECIMAL(12,10)",
        "inclination": "DECIMAL(12,8)", "ra_of_asc_node": "DECIMAL(12,8)",
        "arg_of_pericenter": "DECIMAL(12,8)", "mean_anomaly": "DECIMAL(12,8)",
        "mean_motion_dot": "DECIMAL(15,12)", "mean_motion_ddot": "DECIMAL(15,12)",
        "bstar": "DECIMAL(15,12)", "ephemeris_type": "INTEGER",
        "element_set_no": "INTEGER", "rev_at_epoch": "INTEGER",
    }.items()
)
SATCAT_CASTS = ", ".join(
    f"cast({s} AS {t}) AS {c}" for c, s, t in (
        ("norad_cat_id", "norad_cat_id", "INTEGER"), ("object_name", "object_name", "VARCHAR"),
        ("object_id", "object_id", "VARCHAR"), ("object_type", "object_type", "VARCHAR"),
        ("ops_status_code", "ops_status_code", "VARCHAR"), ("owner", "owner", "VARCHAR"),
        ("launch_date", "launch_date", "DATE"), ("launch_site", "launch_site", "VARCHAR"),
        ("decay_date", "decay_date", "DATE"), ("period_minutes", "period", "DECIMAL(10,2)"),
        ("inclination", "inclination", "DECIMAL(6,2)"), ("apogee_km", "apogee", "INTEGER"),
        ("perigee_km", "perigee", "INTEGER"), ("rcs_m2", "rcs", "DECIMAL(8,4)"),
        ("data_status_code", "data_status_code", "VARCHAR"),
        ("orbit_center", "orbit_center", "VARCHAR"), ("orbit_type", "orbit_type", "VARCHAR"),
    )
)
LINEAGE = "ingest_ts, ingestion_id, source, source_file, target"

GP_DOUBLES = ("mean_motion", "eccentricity", "inclination", "ra_of_asc_node",
              "arg_of_pericenter", "mean_anomaly", "mean_motion_dot", "mean_motion_ddot", "bstar")


def gp_plain() -> str:
    """REPLACE list turning the element-set decimals into doubles."""
    return ", ".join(f"cast({c} AS DOUBLE) AS {c}" for c in GP_DOUBLES)


SATCAT_PLAIN = (
    "cast(launch_date AS VARCHAR) AS launch_date, cast(decay_date AS VARCHAR) AS decay_date, "
    "cast(period_minutes AS DOUBLE) AS period_minutes, cast(inclination AS DOUBLE) AS inclination, "
    "cast(rcs_m2 AS DOUBLE) AS rcs_m2, cast(apogee_km AS DOUBLE) AS apogee_km, "
    "cast(perigee_km AS DOUBLE) AS perigee_km"
)


def j2_sql(source: str, dt: str) -> str:
    """State vectors of the J2 kernel; `dt` is the elapsed time in seconds."""
    turn = num(2.0 * math.pi / 86400.0)
    mu, re, j2 = num(orbit.MU_KM3_S2), num(orbit.EARTH_RADIUS_KM), num(1.5 * orbit.J2)
    text = f"""SELECT *, cast(mean_motion AS DOUBLE) AS mm, cast(eccentricity AS DOUBLE) AS e,
  radians(cast(inclination AS DOUBLE)) AS inc, radians(cast(ra_of_asc_node AS DOUBLE)) AS node0,
  radians(cast(arg_of_pericenter AS DOUBLE)) AS argp0, radians(cast(mean_anomaly AS DOUBLE)) AS m0,
  {dt} AS dt FROM {source}"""
    text = f"SELECT *, mm * {turn} AS n, cos(inc) AS ci, sin(inc) AS si, sqrt(1e0 - e * e) AS w FROM ({text}) WHERE mm > 0 AND e >= 0 AND e < 1"
    text = f"SELECT *, pow({mu} / (n * n), {num(1.0 / 3.0)}) AS a FROM ({text})"
    text = f"SELECT *, {j2} * ({re} / (a * (1e0 - e * e))) * ({re} / (a * (1e0 - e * e))) * n AS k FROM ({text}) WHERE a * (1e0 - e) >= {re}"
    text = f"SELECT *, m0 + n * dt AS m, node0 - k * ci * dt AS om, argp0 + k * (2e0 - 2.5e0 * si * si) * dt AS aw FROM ({text})"
    text = f"SELECT *, m + e * sin(m) AS ea FROM ({text})"
    for _ in range(orbit.NEWTON_STEPS):
        text = f"SELECT * REPLACE (ea - (ea - e * sin(ea) - m) / (1e0 - e * cos(ea)) AS ea) FROM ({text})"
    text = f"""SELECT *, cos(om) * cos(aw) - sin(om) * sin(aw) * ci AS p_x, sin(om) * cos(aw) + cos(om) * sin(aw) * ci AS p_y,
  sin(aw) * si AS p_z, -cos(om) * sin(aw) - sin(om) * cos(aw) * ci AS q_x,
  -sin(om) * sin(aw) + cos(om) * cos(aw) * ci AS q_y, cos(aw) * si AS q_z,
  a * (cos(ea) - e) AS u, a * w * sin(ea) AS v,
  sqrt({mu} * a) / (a * (1e0 - e * cos(ea))) AS s FROM ({text})"""
    axes = ", ".join(
        f"u * p_{x} + v * q_{x} AS position_{x}_km, "
        f"-s * sin(ea) * p_{x} + s * w * cos(ea) * q_{x} AS velocity_{x}_km_s" for x in "xyz"
    )
    return f"SELECT *, {axes} FROM ({text})"


def gmst_sql(jd: str) -> str:
    t = f"(({jd}) - {num(frames.J2000_JD)}) / 36525e0"
    seconds = (
        f"(67310.54841e0 + {num(86400.0 * 36525.0 + 8640184.812866)} * ({t}) + 0.093104e0 * ({t}) * ({t})"
        f" - 6.2e-6 * ({t}) * ({t}) * ({t}))"
    )
    return f"({seconds} - 86400e0 * floor({seconds} / 86400e0)) * {num(2.0 * math.pi / 86400.0)}"


def jd_sql(ts: str) -> str:
    return f"({num(frames.UNIX_EPOCH_JD)} + epoch_us({ts}) / 8.64e10)"


def ecef_from_teme_sql(source: str, jd: str) -> str:
    text = f"SELECT *, {gmst_sql(jd)} AS th FROM ({source})"
    return f"""SELECT *, position_x_km * cos(th) + position_y_km * sin(th) AS ex,
  position_y_km * cos(th) - position_x_km * sin(th) AS ey, position_z_km AS ez FROM ({text})"""


def geodetic_sql(source: str) -> str:
    """Geodetic coordinates of (ex, ey, ez)."""
    a, b = num(frames.WGS84_A_KM), num(frames.WGS84_B_KM)
    e2, ep2b, e2a = (
        num(frames.WGS84_E2), num(frames.WGS84_EP2 * frames.WGS84_B_KM),
        num(frames.WGS84_E2 * frames.WGS84_A_KM),
    )
    text = f"SELECT *, sqrt(ex * ex + ey * ey) AS rho FROM ({source})"
    text = f"SELECT *, atan2(ez * {a}, rho * {b}) AS red FROM ({text})"
    text = f"SELECT *, atan2(ez + {ep2b} * pow(sin(red), 3), rho - {e2a} * pow(cos(red), 3)) AS phi FROM ({text})"
    text = f"SELECT *, {a} / sqrt(1e0 - {e2} * sin(phi) * sin(phi)) AS nn FROM ({text})"
    return f"""SELECT *, degrees(phi) AS latitude_deg, degrees(atan2(ey, ex)) AS longitude_deg,
  CASE WHEN abs(cos(phi)) > abs(sin(phi)) THEN rho / cos(phi) - nn
       ELSE ez / sin(phi) - nn * {num(1.0 - frames.WGS84_E2)} END AS altitude_km FROM ({text})"""


def ecef_from_geodetic_sql(source: str, lat: str, lon: str, alt: str, out: str = "ex ey ez") -> str:
    a, e2, rest = num(frames.WGS84_A_KM), num(frames.WGS84_E2), num(1.0 - frames.WGS84_E2)
    n = f"({a} / sqrt(1e0 - {e2} * sin(radians({lat})) * sin(radians({lat}))))"
    x, y, z = out.split()
    return f"""SELECT *, ({n} + {alt}) * cos(radians({lat})) * cos(radians({lon})) AS {x},
  ({n} + {alt}) * cos(radians({lat})) * sin(radians({lon})) AS {y},
  ({n} * {rest} + {alt}) * sin(radians({lat})) AS {z} FROM ({source})"""


def look_sql(source: str) -> str:
    """Look angles of (ex, ey, ez) from the row's observer columns."""
    text = ecef_from_geodetic_sql(
        source, "observer_latitude_deg", "observer_longitude_deg", "observer_altitude_km",
        "ox oy oz",
    )
    text = f"""SELECT *, ex - ox AS dx, ey - oy AS dy, ez - oz AS dz,
  radians(observer_latitude_deg) AS la, radians(observer_longitude_deg) AS lo FROM ({text})"""
    text = f"""SELECT *, cos(lo) * dy - sin(lo) * dx AS east,
  cos(la) * dz - sin(la) * (cos(lo) * dx + sin(lo) * dy) AS north,
  cos(la) * (cos(lo) * dx + sin(lo) * dy) + sin(la) * dz AS up,
  sqrt(dx * dx + dy * dy + dz * dz) AS range_km FROM ({text})"""
    bearing = "degrees(atan2(east, north))"
    return f"""SELECT *, {bearing} - 360e0 * floor({bearing} / 360e0) AS azimuth_deg,
  degrees(asin(up / range_km)) AS elevation_deg FROM ({text})"""


def distance_sql(source: str) -> str:
    """Lambert distance between the row's point and its observer."""
    flat, a, half_f = num(1.0 - frames.WGS84_F), num(frames.WGS84_A_KM), num(frames.WGS84_F / 2.0)
    text = f"""SELECT *, atan({flat} * tan(radians(observer_latitude_deg))) AS b1,
  atan({flat} * tan(radians(latitude_deg))) AS b2,
  sin(radians(longitude_deg - observer_longitude_deg) / 2e0) AS hl FROM ({source})"""
    text = f"SELECT *, pow(sin((b2 - b1) / 2e0), 2) AS hb2 FROM ({text})"
    text = f"SELECT *, hb2 + cos(b1) * cos(b2) * hl * hl AS ch FROM ({text})"
    text = f"SELECT *, 2e0 * asin(least(1e0, sqrt(ch))) AS sg FROM ({text})"
    return f"""SELECT *, {a} * (sg - {half_f} * (
    (sg - sin(sg)) * pow(sin((b1 + b2) / 2e0), 2) * pow(cos((b2 - b1) / 2e0), 2) / greatest(1e0 - ch, 1e-12)
  + (sg + sin(sg)) * pow(cos((b1 + b2) / 2e0), 2) * hb2 / greatest(ch, 1e-18))) AS distance_km FROM ({text})"""


DT = f"(epoch_us({AT_SQL}) - epoch_us(epoch)) / 1e6"
STATE = ", ".join(f"position_{x}_km" for x in "xyz") + ", " + ", ".join(
    f"velocity_{x}_km_s" for x in "xyz"
)

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    **fx.VIEWS,
    "stg_gp": (("raw_gp",), f"SELECT {GP_CASTS}, {LINEAGE} FROM raw_gp"),
    "stg_satcat": (("raw_satcat",), f"SELECT {SATCAT_CASTS}, {LINEAGE} FROM raw_satcat"),
    "elset_first": (("stg_gp",), """
SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (
    PARTITION BY norad_cat_id, epoch ORDER BY ingest_ts, source_file, ingestion_id) AS rk
  FROM stg_gp) WHERE rk = 1"""),
    "elset": (("elset_first",), """
SELECT *, valid_to IS NULL AS is_current FROM (
  SELECT * EXCLUDE (target), epoch AS valid_from,
         lead(epoch) OVER (PARTITION BY norad_cat_id ORDER BY epoch) AS valid_to
  FROM elset_first)"""),
    "space_object": (("stg_satcat",), """
SELECT * EXCLUDE (rk, target) FROM (SELECT *, row_number() OVER (
    PARTITION BY norad_cat_id ORDER BY ingest_ts DESC, source_file DESC, ingestion_id DESC) AS rk
  FROM stg_satcat) WHERE rk = 1"""),
    "dim_object": (("space_object",), """
SELECT * EXCLUDE (data_status_code, ingestion_id, source),
  decay_date IS NOT NULL AS is_decayed,
  (orbit_center = 'EA' OR regexp_matches(orbit_center, '^[0-9]+$')) AS is_earth_orbiting,
  CASE WHEN apogee_km IS NULL THEN 'unknown' WHEN apogee_km < 2000 THEN 'LEO'
       WHEN apogee_km < 35000 THEN 'MEO' ELSE 'GEO/HEO' END AS orbit_regime
FROM space_object"""),
    "fact": (("elset", "dim_object"), """
SELECT e.* EXCLUDE (valid_from, valid_to, is_current, ingestion_id, source)
FROM elset e JOIN dim_object d USING (norad_cat_id)
WHERE e.is_current AND NOT d.is_decayed AND d.is_earth_orbiting"""),
    "states": (("fact",), j2_sql("fact", DT)),
    "positions": (("states",), f"""
SELECT norad_cat_id, {AT_SQL} AS snapshot_ts, epoch, (epoch_us({AT_SQL}) - epoch_us(epoch)) / 3.6e9 AS epoch_age_hours,
  latitude_deg, longitude_deg, altitude_km, {STATE}
FROM ({geodetic_sql(ecef_from_teme_sql('SELECT * FROM states', jd_sql(AT_SQL)))})"""),
    "sky": (("positions", "dim_object"), """
SELECT p.*, d.object_name, d.object_type, d.orbit_regime, d.owner, d.launch_date, d.launch_site,
  sqrt(velocity_x_km_s * velocity_x_km_s + velocity_y_km_s * velocity_y_km_s
       + velocity_z_km_s * velocity_z_km_s) AS speed_km_s,
  CASE d.launch_site WHEN 'AFETR' THEN 'Cape Canaveral' WHEN 'TYMSC' THEN 'Baikonur'
    WHEN 'FRGUI' THEN 'Kourou' WHEN 'JSC' THEN 'Jiuquan' WHEN 'SRILR' THEN 'Satish Dhawan'
    WHEN 'PLMSC' THEN 'Plesetsk' ELSE d.launch_site END AS launch_site_name,
  epoch_age_hours > CASE d.orbit_regime WHEN 'LEO' THEN 48 WHEN 'GEO/HEO' THEN 96
    WHEN 'MEO' THEN 168 ELSE 48 END AS is_stale
FROM positions p LEFT JOIN dim_object d USING (norad_cat_id)"""),
}


def compose(sql: str, reads: list[str]) -> str:
    """Prefix a statement with the views it reads, dependencies first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in VIEWS[name][0]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in reads:
        visit(name)
    if not ordered:
        return sql.strip()
    views = ",\n".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in ordered)
    return f"WITH {views}\n{sql.strip()}"
