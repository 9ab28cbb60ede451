"""The scalar functions under names of their own for SQL users."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession

from skyledger.functions.frames import (
    J2000_JD, WGS84_A_KM, WGS84_B_KM, WGS84_E2, WGS84_EP2, WGS84_F, d,
)
from skyledger.functions.orbit import MINUTES_PER_DAY

_T = f"((jd - {d(J2000_JD)}) / 36525D)"
_SIDEREAL = (
    f"67310.54841D + {d(86400.0 * 36525.0 + 8640184.812866)} * {_T} + 0.093104D * {_T} * {_T}"
    f" - 6.2e-6D * {_T} * {_T} * {_T}"
)
_NORMAL = f"({d(WGS84_A_KM)} / sqrt(1D - {d(WGS84_E2)} * pow(sin(radians(lat)), 2)))"
_BETA = [f"atan({d(1.0 - WGS84_F)} * tan(radians(lat{i})))" for i in (1, 2)]
_CHORD = (
    f"(pow(sin(({_BETA[1]} - {_BETA[0]}) / 2D), 2) + cos({_BETA[0]}) * cos({_BETA[1]})"
    " * pow(sin(radians(lon2 - lon1) / 2D), 2))"
)
_SIGMA = f"(2D * asin(least(1D, sqrt({_CHORD}))))"

_POINT = "STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE>"
_GMST = f"(pmod({_SIDEREAL}, 86400D) * {d(2.0 * math.pi / 86400.0)})"
_RING = "sqrt(x * x + y * y)"
_REDUCED = f"atan2(z * {d(WGS84_A_KM)}, {_RING} * {d(WGS84_B_KM)})"
# Bowring's closed form.
_PHI = (
    f"atan2(z + {d(WGS84_EP2 * WGS84_B_KM)} * pow(sin({_REDUCED}), 3),"
    f" {_RING} - {d(WGS84_E2 * WGS84_A_KM)} * pow(cos({_REDUCED}), 3))"
)
_CURVATURE = f"{d(WGS84_A_KM)} / sqrt(1D - {d(WGS84_E2)} * pow(sin({_PHI}), 2))"
_HEIGHT = (
    f"CASE WHEN abs(cos({_PHI})) > abs(sin({_PHI})) THEN {_RING} / cos({_PHI}) - {_CURVATURE}"
    f" ELSE z / sin({_PHI}) - {_CURVATURE} * {d(1.0 - WGS84_E2)} END"
)
# From an observer to a point, and that vector turned east, north and up.
_DX = f"(x - ({_NORMAL} + alt_km) * cos(radians(lat)) * cos(radians(lon)))"
_DY = f"(y - ({_NORMAL} + alt_km) * cos(radians(lat)) * sin(radians(lon)))"
_DZ = f"(z - ({_NORMAL} * {d(1.0 - WGS84_E2)} + alt_km) * sin(radians(lat)))"
_OUTWARD = f"(cos(radians(lon)) * {_DX} + sin(radians(lon)) * {_DY})"
_EAST = f"(cos(radians(lon)) * {_DY} - sin(radians(lon)) * {_DX})"
_NORTH = f"(cos(radians(lat)) * {_DZ} - sin(radians(lat)) * {_OUTWARD})"
_UP = f"(cos(radians(lat)) * {_OUTWARD} + sin(radians(lat)) * {_DZ})"
_RANGE = f"sqrt({_DX} * {_DX} + {_DY} * {_DY} + {_DZ} * {_DZ})"

#: Signature and body of every function.
FUNCTIONS = {
    "gmst_radians(jd DOUBLE) RETURNS DOUBLE":
        f"pmod({_SIDEREAL}, 86400D) * {d(2.0 * math.pi / 86400.0)}",
    "orbit_period_minutes(mean_motion DOUBLE) RETURNS DOUBLE":
        f"CASE WHEN mean_motion > 0 THEN {d(MINUTES_PER_DAY)} / mean_motion END",
    "orbit_regime(apogee_km INT) RETURNS STRING":
        "CASE WHEN apogee_km IS NULL THEN 'unknown' WHEN apogee_km < 2000 THEN 'LEO'"
        " WHEN apogee_km < 35000 THEN 'MEO' ELSE 'GEO/HEO' END",
    "is_earth_orbiting(orbit_center STRING) RETURNS BOOLEAN":
        "orbit_center = 'EA' OR orbit_center RLIKE '^[0-9]+$'",
    "geodetic_to_ecef(lat DOUBLE, lon DOUBLE, alt_km DOUBLE)"
    " RETURNS STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE>":
        f"named_struct('x', ({_NORMAL} + alt_km) * cos(radians(lat)) * cos(radians(lon)),"
        f" 'y', ({_NORMAL} + alt_km) * cos(radians(lat)) * sin(radians(lon)),"
        f" 'z', ({_NORMAL} * {d(1.0 - WGS84_E2)} + alt_km) * sin(radians(lat)))",
    f"teme_to_ecef(x DOUBLE, y DOUBLE, z DOUBLE, jd DOUBLE) RETURNS {_POINT}":
        f"named_struct('x', x * cos({_GMST}) + y * sin({_GMST}),"
        f" 'y', y * cos({_GMST}) - x * sin({_GMST}), 'z', z)",
    "ecef_to_geodetic(x DOUBLE, y DOUBLE, z DOUBLE)"
    " RETURNS STRUCT<latitude_deg: DOUBLE, longitude_deg: DOUBLE, altitude_km: DOUBLE>":
        f"named_struct('latitude_deg', degrees({_PHI}), 'longitude_deg', degrees(atan2(y, x)),"
        f" 'altitude_km', {_HEIGHT})",
    "look_angles(lat DOUBLE, lon DOUBLE, alt_km DOUBLE, x DOUBLE, y DOUBLE, z DOUBLE)"
    " RETURNS STRUCT<azimuth_deg: DOUBLE, elevation_deg: DOUBLE, range_km: DOUBLE>":
        f"named_struct('azimuth_deg', pmod(degrees(atan2({_EAST}, {_NORTH})), 360D),"
        f" 'elevation_deg', degrees(asin({_UP} / {_RANGE})), 'range_km', {_RANGE})",
    "ground_distance_km(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE) RETURNS DOUBLE":
        f"{d(WGS84_A_KM)} * ({_SIGMA} - {d(WGS84_F / 2.0)} * ("
        f"({_SIGMA} - sin({_SIGMA})) * pow(sin(({_BETA[0]} + {_BETA[1]}) / 2D), 2)"
        f" * pow(cos(({_BETA[1]} - {_BETA[0]}) / 2D), 2) / greatest(1D - {_CHORD}, 1e-12D)"
        f" + ({_SIGMA} + sin({_SIGMA})) * pow(cos(({_BETA[0]} + {_BETA[1]}) / 2D), 2)"
        f" * pow(sin(({_BETA[1]} - {_BETA[0]}) / 2D), 2) / greatest({_CHORD}, 1e-18D)))",
}


def register_functions(spark: SparkSession) -> None:
    """Make the functions callable from SQL in this session."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
