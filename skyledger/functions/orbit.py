"""Orbit theory as Column expressions: period, age, and the J2-secular kernel.

The J2 kernel moves node, perigee and mean anomaly at their secular rates and solves
Kepler's equation with a fixed number of Newton steps. It is deterministic arithmetic, runs
inside whole-stage codegen and needs no Python worker. It carries no drag, no periodic and
no lunisolar terms; rows say so in `kernel_used`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions.frames import d, derive

# WGS72 gravity model.
MU_KM3_S2 = 398600.8
EARTH_RADIUS_KM = 6378.135
J2 = 0.001082616

NEWTON_STEPS = 8
MINUTES_PER_DAY = 1440.0

#: Decline codes: an element set outside the theory, or one that has come down.
BAD_ECCENTRICITY = 1
BAD_MEAN_MOTION = 2
BELOW_GROUND = 6

STATE_COLUMNS = (
    "position_x_km", "position_y_km", "position_z_km",
    "velocity_x_km_s", "velocity_y_km_s", "velocity_z_km_s",
)


def period_minutes(mean_motion: Column) -> Column:
    """Minutes per revolution; NULL where the mean motion is not positive."""
    n = mean_motion.cast("double")
    return F.when(n > 0, F.lit(MINUTES_PER_DAY) / n)


def age_hours(at: Column, epoch: Column) -> Column:
    """Signed hours from `epoch` to `at`; an epoch in the future gives a negative age."""
    return (F.unix_micros(at) - F.unix_micros(epoch)) / F.lit(3.6e9)


def with_orbit_constants(df: DataFrame) -> DataFrame:
    """Per-object constants of the J2 kernel, computed once before any time grid.

    Adds `error_code` and the `_k_*` columns. Rows with a non-zero code carry NULLs in those
    the state depends on.
    """
    ok = "error_code = 0"
    steps = {
        "_k_e": "cast(eccentricity AS double)",
        "_mm": "cast(mean_motion AS double)",
        "_n": f"CASE WHEN _mm > 0 THEN _mm * {d(2.0 * math.pi / 86400.0)} END",
        "_a": f"pow({d(MU_KM3_S2)} / (_n * _n), {d(1.0 / 3.0)})",
        "error_code": f"CASE WHEN _n IS NULL THEN {BAD_MEAN_MOTION}"
        f" WHEN NOT coalesce(_k_e >= 0 AND _k_e < 1, false) THEN {BAD_ECCENTRICITY}"
        f" WHEN _a * (1D - _k_e) < {d(EARTH_RADIUS_KM)} THEN {BELOW_GROUND} ELSE 0 END",
        "_k_n": f"CASE WHEN {ok} THEN _n END",
        "_k_a": f"CASE WHEN {ok} THEN _a END",
        "_k_root": f"CASE WHEN {ok} THEN sqrt(1D - _k_e * _k_e) END",
        "_k_ci": "cos(radians(cast(inclination AS double)))",
        "_k_si": "sin(radians(cast(inclination AS double)))",
        "_k_node": "radians(cast(ra_of_asc_node AS double))",
        "_k_argp": "radians(cast(arg_of_pericenter AS double))",
        "_k_m": "radians(cast(mean_anomaly AS double))",
        "_re_p": f"{d(EARTH_RADIUS_KM)} / (_k_a * _k_root * _k_root)",
        "_rate": f"{d(1.5 * J2)} * _re_p * _re_p * _k_n",
        "_k_node_rate": "-_rate * _k_ci",
        "_k_argp_rate": "_rate * (2D - 2.5D * _k_si * _k_si)",
    }
    columns = df.columns
    return df.selectExpr(
        *[f"`{c}`" for c in columns], *[f"{e} AS `{n}`" for n, e in steps.items()]
    ).select(*columns, "error_code", *CONSTANT_COLUMNS)


CONSTANT_COLUMNS = (
    "_k_e", "_k_n", "_k_ci", "_k_si", "_k_root", "_k_node", "_k_argp", "_k_m", "_k_a",
    "_k_node_rate", "_k_argp_rate",
)


def with_j2_state(df: DataFrame, elapsed_seconds: Column, velocity: bool = True) -> DataFrame:
    """Add the TEME state vector `elapsed_seconds` after epoch.

    Input carries the columns of `with_orbit_constants`; they are dropped again.
    """
    steps = {
        "_m": "_k_m + _k_n * _dt",
        "_node": "_k_node + _k_node_rate * _dt",
        "_argp": "_k_argp + _k_argp_rate * _dt",
        "_ea0": "_m + _k_e * sin(_m)",
    }
    for i in range(NEWTON_STEPS):
        e = f"_ea{i}"
        steps[f"_ea{i + 1}"] = (
            # Null is null by the first term; a quotient that can't be null keeps code short.
            f"{e} - coalesce(({e} - _k_e * sin({e}) - _m) / (1D - _k_e * cos({e})), 0D)"
        )
    steps |= {
        "_se": f"sin(_ea{NEWTON_STEPS})", "_ce": f"cos(_ea{NEWTON_STEPS})",
        "_so": "sin(_node)", "_co": "cos(_node)", "_sw": "sin(_argp)", "_cw": "cos(_argp)",
        "_px": "_co * _cw - _so * _sw * _k_ci",
        "_py": "_so * _cw + _co * _sw * _k_ci",
        "_pz": "_sw * _k_si",
        "_qx": "-_co * _sw - _so * _cw * _k_ci",
        "_qy": "-_so * _sw + _co * _cw * _k_ci",
        "_qz": "_cw * _k_si",
        "_along": "_k_a * (_ce - _k_e)",
        "_across": "_k_a * _k_root * _se",
    }
    state = {f"position_{x}_km": f"_along * _p{x} + _across * _q{x}" for x in "xyz"}
    if velocity:
        steps |= {
            "_pace": f"sqrt({d(MU_KM3_S2)} * _k_a) / (_k_a * (1D - _k_e * _ce))",
            "_du": "-_pace * _se",
            "_dv": "_pace * _k_root * _ce",
        }
        state |= {f"velocity_{x}_km_s": f"_du * _p{x} + _dv * _q{x}" for x in "xyz"}
    return derive(df.withColumn("_dt", elapsed_seconds), steps, state).drop(
        "_dt", *CONSTANT_COLUMNS
    )
