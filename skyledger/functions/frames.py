"""Reference-frame conversions as Column expressions.

Nothing here leaves the JVM. Scalars that are used more than once are staged with
`withColumns`, because the optimizer keeps a costly expression in its own projection when
several later expressions refer to it; the plan therefore grows linearly.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# WGS84 ellipsoid. The orbit theory uses the WGS72 gravity constants instead (see
# functions/orbit.py); the two sets are different things and are never mixed.
WGS84_A_KM = 6378.137
WGS84_F = 1.0 / 298.257223563
WGS84_B_KM = WGS84_A_KM * (1.0 - WGS84_F)
WGS84_E2 = WGS84_F * (2.0 - WGS84_F)
WGS84_EP2 = WGS84_E2 / (1.0 - WGS84_E2)

UNIX_EPOCH_JD = 2440587.5
J2000_JD = 2451545.0
MICROS_PER_DAY = 86_400_000_000


def julian_date(ts: Column) -> Column:
    """Julian date of an instant as one double (about 0.05 ms of resolution)."""
    return F.lit(UNIX_EPOCH_JD) + F.unix_micros(ts) / F.lit(8.64e10)


def julian_day_and_fraction(ts: Column) -> tuple[Column, Column]:
    """Julian date as (midnight, fraction of day), exact to the microsecond."""
    micros = F.unix_micros(ts)
    within = F.pmod(micros, F.lit(MICROS_PER_DAY))
    midnight = F.lit(UNIX_EPOCH_JD) + ((micros - within) / F.lit(8.64e10))
    return midnight, within / F.lit(8.64e10)


def gmst_radians(jd: Column) -> Column:
    """Greenwich mean sidereal time (IAU 1982) in [0, 2*pi)."""
    t = (jd - F.lit(J2000_JD)) / F.lit(36525.0)
    seconds = (
        F.lit(67310.54841)
        + F.lit(86400.0 * 36525.0 + 8640184.812866) * t
        + F.lit(0.093104) * t * t
        - F.lit(6.2e-6) * t * t * t
    )
    return F.pmod(seconds, F.lit(86400.0)) * F.lit(2.0 * math.pi / 86400.0)


def gmst_of(jd: np.ndarray) -> np.ndarray:
    """`gmst_radians` for arrays."""
    t = (jd - J2000_JD) / 36525.0
    seconds = 67310.54841 + (86400.0 * 36525.0 + 8640184.812866) * t + 0.093104 * t * t - 6.2e-6 * t * t * t
    return np.mod(seconds, 86400.0) * (2.0 * math.pi / 86400.0)


def d(x: float) -> str:
    """A DOUBLE literal in SQL."""
    return f"{float(x)!r}D"


def derive(df: DataFrame, steps: dict[str, str], keep: dict[str, str]) -> DataFrame:
    """Add the `keep` columns, computed by way of the `steps`.

    Both are SQL expressions that may refer to columns and to earlier steps. Spark resolves
    such references into a chain of projections, so a value that is used several times is
    computed once. Kept columns are fenced: a filter on one of them would otherwise be moved
    below the chain by copying every step into its condition, which grows exponentially. An
    expression that depends on the task is never inlined, and adding zero times the
    partition number makes it one at no cost.
    """
    fence = "cast(spark_partition_id() * 0 AS double)"
    kept = [f"({e}) + {fence} AS `{n}`" for n, e in keep.items()]
    others = [c for c in df.columns if c not in keep]
    return df.selectExpr(
        *[f"`{c}`" for c in others], *[f"{e} AS `{n}`" for n, e in steps.items()], *kept
    ).select(*others, *keep)


def parted(df: DataFrame) -> DataFrame:
    """The same rows, with generated code cut in two: Java compiles no method of more than 8000
    bytes, and a long chain of derivations would be interpreted. Counting the rows cuts it and
    keeps their partitioning."""
    return df.observe(f"rows-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("n"))


def with_ecef_from_teme(
    df: DataFrame,
    jd: Column,
    position: tuple[str, str, str] = ("position_x_km", "position_y_km", "position_z_km"),
    out: tuple[str, str, str] = ("ecef_x_km", "ecef_y_km", "ecef_z_km"),
) -> DataFrame:
    """Add Earth-fixed coordinates for TEME coordinates at Julian date `jd`."""
    x, y, z = position
    return derive(
        df.withColumn("_gmst", gmst_radians(jd)),
        {"_gs": "sin(_gmst)", "_gc": "cos(_gmst)"},
        {out[0]: f"{x} * _gc + {y} * _gs", out[1]: f"{y} * _gc - {x} * _gs", out[2]: z},
    ).drop("_gmst")


def geodetic_to_ecef(
    latitude: Column, longitude: Column, altitude_km: Column
) -> tuple[Column, Column, Column]:
    """Earth-fixed coordinates of a geodetic point (degrees, km), WGS84."""
    phi, lam = F.radians(latitude), F.radians(longitude)
    n = F.lit(WGS84_A_KM) / F.sqrt(F.lit(1.0) - F.lit(WGS84_E2) * F.sin(phi) * F.sin(phi))
    ring = (n + altitude_km) * F.cos(phi)
    return (
        ring * F.cos(lam),
        ring * F.sin(lam),
        (n * F.lit(1.0 - WGS84_E2) + altitude_km) * F.sin(phi),
    )


def with_ecef_from_geodetic(
    df: DataFrame,
    geodetic: tuple[str, str, str] = ("latitude_deg", "longitude_deg", "altitude_km"),
    out: tuple[str, str, str] = ("ecef_x_km", "ecef_y_km", "ecef_z_km"),
) -> DataFrame:
    """Add Earth-fixed coordinates for geodetic ones."""
    lat, lon, alt = (F.col(c) for c in geodetic)
    return df.withColumns(dict(zip(out, geodetic_to_ecef(lat, lon, alt), strict=True)))


def with_geodetic_from_ecef(
    df: DataFrame,
    ecef: tuple[str, str, str] = ("ecef_x_km", "ecef_y_km", "ecef_z_km"),
    out: tuple[str, str, str] = ("latitude_deg", "longitude_deg", "altitude_km"),
) -> DataFrame:
    """Add geodetic latitude, longitude (degrees) and altitude (km), WGS84.

    Bowring's closed form. Altitude uses the equatorial expression up to 45 degrees and the
    polar one beyond, so neither divisor approaches zero.
    """
    x, y, z = ecef
    return derive(
        df,
        {
            "_p": f"sqrt({x} * {x} + {y} * {y})",
            "_u": f"atan2({z} * {d(WGS84_A_KM)}, _p * {d(WGS84_B_KM)})",
            "_su": "sin(_u)",
            "_cu": "cos(_u)",
            "_phi": f"atan2({z} + {d(WGS84_EP2 * WGS84_B_KM)} * _su * _su * _su,"
            f" _p - {d(WGS84_E2 * WGS84_A_KM)} * _cu * _cu * _cu)",
            "_sphi": "sin(_phi)",
            "_cphi": "cos(_phi)",
            "_normal": f"{d(WGS84_A_KM)} / sqrt(1D - {d(WGS84_E2)} * _sphi * _sphi)",
        },
        {
            out[0]: "degrees(_phi)",
            out[1]: f"degrees(atan2({y}, {x}))",
            out[2]: "CASE WHEN abs(_cphi) > abs(_sphi) THEN _p / _cphi - _normal"
            f" ELSE {z} / _sphi - _normal * {d(1.0 - WGS84_E2)} END",
        },
    )


def with_geodetic_from_teme(
    df: DataFrame,
    jd: Column,
    position: tuple[str, str, str] = ("position_x_km", "position_y_km", "position_z_km"),
    out: tuple[str, str, str] = ("latitude_deg", "longitude_deg", "altitude_km"),
) -> DataFrame:
    """Add geodetic coordinates for TEME ones at Julian date `jd`."""
    ecef = ("_ex", "_ey", "_ez")
    return with_geodetic_from_ecef(
        with_ecef_from_teme(df, jd, position, ecef), ecef, out
    ).drop(*ecef)


OBSERVER_FIELDS = (
    "observer_x_km", "observer_y_km", "observer_z_km",
    "observer_sin_lat", "observer_cos_lat", "observer_sin_lon", "observer_cos_lon",
)


def with_observer_frame(
    df: DataFrame,
    latitude: str = "observer_latitude_deg",
    longitude: str = "observer_longitude_deg",
    altitude: str = "observer_altitude_km",
) -> DataFrame:
    """Precompute what look angles need of an observer, once per observer row."""
    ecef = geodetic_to_ecef(F.col(latitude), F.col(longitude), F.col(altitude))
    phi, lam = F.radians(latitude), F.radians(longitude)
    trig = (F.sin(phi), F.cos(phi), F.sin(lam), F.cos(lam))
    return df.withColumns(dict(zip(OBSERVER_FIELDS, ecef + trig, strict=True)))


def with_look_angles(
    df: DataFrame, satellite: tuple[str, str, str] = ("ecef_x_km", "ecef_y_km", "ecef_z_km")
) -> DataFrame:
    """Add azimuth in [0, 360), elevation and slant range.

    The rows carry the satellite in Earth-fixed coordinates and the columns of
    `with_observer_frame`. It is the difference vector that is turned into east, north and
    up, never the satellite's own position.
    """
    ox, oy, oz, s_lat, c_lat, s_lon, c_lon = OBSERVER_FIELDS
    x, y, z = satellite
    return derive(
        df,
        {
            "_dx": f"{x} - {ox}",
            "_dy": f"{y} - {oy}",
            "_dz": f"{z} - {oz}",
            "_outward": f"{c_lon} * _dx + {s_lon} * _dy",
            "_east": f"{c_lon} * _dy - {s_lon} * _dx",
            "_north": f"{c_lat} * _dz - {s_lat} * _outward",
            "_up": f"{c_lat} * _outward + {s_lat} * _dz",
            "_range": "sqrt(_dx * _dx + _dy * _dy + _dz * _dz)",
        },
        {
            "azimuth_deg": "pmod(degrees(atan2(_east, _north)), 360D)",
            "elevation_deg": "degrees(asin(_up / _range))",
            "range_km": "_range",
        },
    )
