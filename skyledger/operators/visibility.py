"""Look angles, horizon filters and passes for any number of observers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import datetime

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyledger.functions import frames, orbit, sgp4, sight
from skyledger.operators.enrich import above
from skyledger.operators.ordered import OrderedGroups
from skyledger.operators.propagate import KERNELS, instant, is_deep, sample_states, seconds_since_epoch, spread

DEFAULT_WINDOW_HOURS = 72
DEFAULT_STEP_SECONDS = 30
DEFAULT_MINIMUM_ELEVATION = 10.0

Observer = tuple[int, float, float, float]
_OBSERVER_COLUMNS = (
    "observer_id", "observer_latitude_deg", "observer_longitude_deg", "observer_altitude_km",
)
_SCRATCH = frames.OBSERVER_FIELDS + _OBSERVER_COLUMNS[1:]


def with_literal_observers(df: DataFrame, observers: Sequence[Observer]) -> DataFrame:
    """Every row once per listed observer, by a generator over a short literal list."""
    if not observers:
        raise ValueError("give one observer at least")
    here = [
        F.struct(
            F.lit(int(i)).alias(_OBSERVER_COLUMNS[0]),
            *[F.lit(float(v)).alias(c) for c, v in zip(_OBSERVER_COLUMNS[1:], rest, strict=True)],
        )
        for i, *rest in observers
    ]
    if len(here) == 1:
        return df.withColumns({c: here[0][c] for c in _OBSERVER_COLUMNS})
    return df.withColumn("_o", F.explode(F.array(*here))).select(
        *df.columns, *[F.col(f"_o.{c}").alias(c) for c in _OBSERVER_COLUMNS]
    )


def look_angles(positions: DataFrame, observers: Sequence[Observer] | DataFrame) -> DataFrame:
    """Azimuth, elevation and range of geodetic positions, for each observer of a list or table.

    The result has a row for every position and observer, above the horizon or not. For those
    above it use `visible_pairs`, which compares only what can see each other.
    """
    if isinstance(observers, DataFrame):
        paired = positions.crossJoin(observers.select(*_OBSERVER_COLUMNS))
    else:
        paired = with_literal_observers(positions, observers)
    seen = frames.with_observer_frame(paired)
    ecef = ("ecef_x_km", "ecef_y_km", "ecef_z_km")
    return frames.with_look_angles(frames.with_ecef_from_geodetic(seen)).drop(*_SCRATCH, *ecef)


def observer_table(spark: SparkSession, observers: Sequence[Observer] | DataFrame) -> DataFrame:
    """Observers as a table. A list is in the driver's memory already and is broadcast."""
    if isinstance(observers, DataFrame):
        return observers
    if not observers:
        raise ValueError("give one observer at least")
    rows = [(int(i), *map(float, rest)) for i, *rest in observers]
    schema = ", ".join(f"{c} {k}" for c, k in zip(_OBSERVER_COLUMNS, ("int", *["double"] * 3), strict=True))
    return F.broadcast(spark.createDataFrame(rows, schema))


def filter_visible(frame: DataFrame, minimum_elevation: float) -> DataFrame:
    return frame.where(above(minimum_elevation))


# Levels of the visibility grid: cell size in degrees. A satellite is listed on the finest
# level whose cells are no smaller than its footprint radius, so it touches about nine.
_LEVELS = (5.625, 11.25, 22.5, 45.0, 90.0)
# Geodetic and geocentric verticals differ by less than this, degrees.
_VERTICAL_SLACK = 0.2
# No observer stands closer to the Earth's centre, km.
_LOWEST_OBSERVER_KM = 6350.0


def _cell_id(level: Column, band: Column, column: Column) -> Column:
    return (level * 10_000 + band * 100 + column).cast("int")


def observer_cells(observers: DataFrame) -> DataFrame:
    """Observers with their local frame, listed once per level of the visibility grid."""
    framed = frames.with_observer_frame(observers)
    x, y, z = (F.col(c) for c in frames.OBSERVER_FIELDS[:3])
    centred = framed.withColumns(
        {
            "_lat": F.degrees(F.atan2(z, F.sqrt(x * x + y * y))),
            "_lon": F.degrees(F.atan2(y, x)),
        }
    )
    entries = []
    for level, size in enumerate(_LEVELS):
        bands, columns = int(180 / size), int(360 / size)
        entries.append(
            _cell_id(
                F.lit(level),
                F.least(F.floor((F.col("_lat") + 90.0) / size), F.lit(bands - 1)),
                F.pmod(F.floor((F.col("_lon") + 180.0) / size), F.lit(columns)),
            )
        )
    return centred.withColumn("_cell", F.explode(F.array(*entries))).drop("_lat", "_lon")


def footprint_degrees(distance_km: Column, minimum_elevation: float) -> Column:
    """Central angle within which an object at a distance from the centre can be seen.

    At elevation e an object at distance r is seen at most acos(R cos e / r) - e away, for an
    observer at distance R. The lowest possible R and an elevation lowered by the slack make
    that a safe bound on the ellipsoid.
    """
    floor = minimum_elevation - _VERTICAL_SLACK
    ratio = F.lit(_LOWEST_OBSERVER_KM) * F.cos(F.radians(F.lit(floor))) / distance_km
    return F.degrees(F.acos(F.least(F.lit(1.0), ratio))) - F.lit(floor) + 0.01


def with_footprint_cells(samples: DataFrame, foot: Column) -> DataFrame:
    """List satellites under every cell that has a point within `foot` degrees of them."""
    c = F.col
    x, y, z = c("ecef_x_km"), c("ecef_y_km"), c("ecef_z_km")
    sized = (
        samples.withColumn("_rho", F.sqrt(x * x + y * y))
        .withColumns(
            {
                "_lat": F.degrees(F.atan2(z, c("_rho"))),
                "_lon": F.degrees(F.atan2(y, x)),
                "_foot": foot,
            }
        )
    )
    # Cells double from level to level.
    doubled = F.ceil(F.log2(F.greatest(c("_foot"), F.lit(_LEVELS[0])) / _LEVELS[0]))
    sized = sized.withColumn("_level", F.least(doubled, F.lit(len(_LEVELS) - 1)).cast("int"))
    sized = sized.withColumn("_size", F.pow(F.lit(2.0), c("_level")) * _LEVELS[0])
    half = F.when(
        F.abs("_lat") + c("_foot") >= 89.9, F.lit(180.0)
    ).otherwise(
        F.degrees(
            F.asin(F.least(F.lit(1.0), F.sin(F.radians("_foot")) / F.cos(F.radians("_lat"))))
        ) + 0.01
    )
    n_columns = (F.lit(360.0) / c("_size")).cast("int")
    sized = sized.withColumn("_half", half).withColumns(
        {
            "_west": F.floor((c("_lon") - c("_half") + 180.0) / c("_size")).cast("int"),
            "_east": F.floor((c("_lon") + c("_half") + 180.0) / c("_size")).cast("int"),
            "_south": F.greatest(
                F.floor((c("_lat") - c("_foot") + 90.0) / c("_size")).cast("int"), F.lit(0)
            ),
            "_north": F.least(
                F.floor((c("_lat") + c("_foot") + 90.0) / c("_size")).cast("int"),
                (F.lit(180.0) / c("_size")).cast("int") - 1,
            ),
        }
    )
    around = F.when(
        c("_east") - c("_west") >= n_columns - 1, F.sequence(F.lit(0), n_columns - 1)
    ).otherwise(F.sequence(c("_west"), c("_east")))
    return (
        sized.withColumn("_band", F.explode(F.sequence("_south", "_north")))
        .withColumn("_column", F.explode(around))
        .withColumn(
            "_cell", _cell_id(c("_level"), c("_band"), F.pmod(c("_column"), n_columns))
        )
        .drop("_rho", "_lat", "_lon", "_foot", "_level", "_size", "_half", "_west", "_east",
              "_south", "_north", "_band", "_column")
    )


def visible_pairs(
    satellites: DataFrame, observers: DataFrame, minimum_elevation: float
) -> DataFrame:
    """Satellite and observer pairs with the satellite at or above the elevation.

    `satellites` carries Earth-fixed coordinates. An equality join on the grid cell brings
    together only pairs that can see each other; the exact elevation decides.
    """
    x, y, z = F.col("ecef_x_km"), F.col("ecef_y_km"), F.col("ecef_z_km")
    foot = footprint_degrees(F.sqrt(x * x + y * y + z * z), minimum_elevation)
    listed = with_footprint_cells(satellites, foot)
    pairs = listed.join(observer_cells(observers), "_cell")
    return frames.with_look_angles(pairs).where(above(minimum_elevation)).drop("_cell", *_SCRATCH)


def visible_now(
    frame: DataFrame,
    observers: Sequence[Observer] | DataFrame,
    *,
    minimum_elevation: float = 0.0,
    shown: Column | None = None,
) -> DataFrame:
    """Enriched positions that pass a filter and stand above the horizon."""
    chosen = frame if shown is None else frame.where(shown)
    table = observer_table(frame.sparkSession, observers)
    located = frames.with_ecef_from_geodetic(chosen)
    return visible_pairs(located, table, minimum_elevation).drop(
        "ecef_x_km", "ecef_y_km", "ecef_z_km"
    )


def visible_counts(
    positions: DataFrame, observers: DataFrame, thresholds: Sequence[float] = (0.0, 10.0, 30.0)
) -> DataFrame:
    """Per observer, how many objects stand above each elevation."""
    pairs = visible_now(positions, observers, minimum_elevation=min(thresholds))
    counted = pairs.groupBy("observer_id").agg(
        *[F.count_if(above(t)).alias(f"above_{t:g}") for t in thresholds]
    )
    return observers.select("observer_id").join(counted, "observer_id", "left").na.fill(0)


def _samples(window_hours: float, step_seconds: int) -> int:
    if window_hours <= 0 or step_seconds <= 0:
        raise ValueError("window and step must be positive")
    samples = int(window_hours * 3600 / step_seconds)
    if samples < 1:
        raise ValueError("the window holds no sample")
    return samples


def _sample_ts(at: Column, step_seconds: int, index: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(at) + (index * F.lit(int(step_seconds * 1_000_000)).cast("long")).cast("long"))


def _series(elsets, start, window_hours, step_seconds, kernel, keep=None) -> DataFrame:
    """Earth-fixed positions of every object over the window, one row per surviving sample."""
    samples, at = _samples(window_hours, step_seconds), instant(start)
    # Only element sets are exchanged here. Samples are generated behind the exchange and
    # keep its partitioning, so the windows of the pass search need no other one.
    moved = sample_states(
        spread(elsets, samples),
        lambda i: seconds_since_epoch(at) + i * F.lit(float(step_seconds)),
        samples=samples, kernel=kernel, velocity=False, carry=("norad_cat_id", "object_name"), keep=keep,
    ).where("error_code = 0")
    timed = moved.withColumn("ts", _sample_ts(at, step_seconds, F.col("sample_idx")))
    return frames.with_ecef_from_teme(timed, frames.julian_date(F.col("ts"))).drop(
        "position_x_km", "position_y_km", "position_z_km", "error_code"
    )


def look_angle_series(
    elsets: DataFrame,
    observers: Sequence[Observer],
    start: str | datetime | Column,
    *,
    window_hours: float = DEFAULT_WINDOW_HOURS,
    step_seconds: int = DEFAULT_STEP_SECONDS,
    kernel: str = "j2",
) -> DataFrame:
    """Look angles of every object at every step of a window, one row per sample."""
    series = _series(elsets, start, window_hours, step_seconds, kernel)
    seen = frames.with_observer_frame(with_literal_observers(series, observers))
    return frames.with_look_angles(seen).select(
        "norad_cat_id", "object_name", "observer_id", "sample_idx", "sample_rank", "n_survived",
        "ts", "azimuth_deg", "elevation_deg", "range_km", "kernel_used",
    )


#: Samples in an interval of each level of the search for passes, coarse to fine.
INTERVALS = (32, 8)
#: Rotation of the Earth, and a margin on angular speeds.
_EARTH_RATE, _RATE_MARGIN = 7.2921159e-5, 1.001
#: Beyond this eccentricity the kernel's fixed number of Newton steps bounds no speed.
_BOUNDED_ECCENTRICITY = 0.9


def _reaching(elsets: DataFrame, at: Column, minimum_elevation: float) -> DataFrame:
    """Objects with what the search needs: orbit constants, footprint at apogee in degrees, and
    bounds on how they move over the turning Earth: degrees a second, and in kilometres and seconds
    acceleration, its change, and what `_motion` leaves out of it."""
    objects = orbit.with_orbit_constants(elsets).where("error_code = 0")
    e = F.col("_k_e")
    sweep = F.col("_k_n") * (1 + e) * (1 + e) / F.pow(1 - e * e, F.lit(1.5))
    turn = F.abs("_k_node_rate") + F.abs("_k_argp_rate") + _EARTH_RATE
    perigee, apogee = F.col("_k_a") * (1 - e), F.col("_k_a") * (1 + e)
    fastest = F.sqrt(orbit.MU_KM3_S2 * (1 + e) / perigee)
    pull = orbit.MU_KM3_S2 / (perigee * perigee)
    # Derivatives of a Kepler orbit, seen from a frame that turns at no more than `turn`.
    acceleration = pull + 2 * turn * fastest + turn * turn * apogee
    jerk = 2 * pull * fastest / perigee + 3 * turn * pull + 3 * turn * turn * fastest + turn * turn * turn * apogee
    left_out = 2 * F.abs("_k_argp_rate") * (fastest + turn * apogee)
    unbounded = e > _BOUNDED_ECCENTRICITY
    numbers = {
        "_since": seconds_since_epoch(at),
        "_apogee_foot": footprint_degrees(apogee * _RATE_MARGIN, minimum_elevation),
        "_rate": F.when(unbounded, F.lit(360.0)).otherwise(F.degrees((sweep + turn) * _RATE_MARGIN)),
        "_turns_at": F.degrees(F.asin(F.least(F.lit(1.0), F.abs("_k_si")))),
        "_acceleration": F.when(unbounded, F.lit(1e9)).otherwise(acceleration * _RATE_MARGIN),
        "_jerk": F.when(unbounded, F.lit(1e9)).otherwise(jerk * _RATE_MARGIN),
        "_left_out": left_out * _RATE_MARGIN,
    }
    # Without an element there is no place. Columns that can't be null keep the kernel's code short.
    known = F.lit(True)
    for name in ("_since", *orbit.CONSTANT_COLUMNS):
        known = known & F.col(name).isNotNull()
    never_null = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return frames.parted(objects.withColumns(numbers)).where(known).select(
        "norad_cat_id", *[never_null(c) for c in numbers],
        F.struct("object_name", *[never_null(c) for c in orbit.CONSTANT_COLUMNS]).alias("_orbit"),
    )


def _opened(rows: DataFrame, index: Column) -> DataFrame:
    return rows.withColumns({c: F.col(f"_orbit.{c}") for c in orbit.CONSTANT_COLUMNS} | {"_index": index})


def _located(rows: DataFrame, at: Column, step_seconds: int, index: Column) -> DataFrame:
    """Earth-fixed positions of rows of `_reaching` at a sample, whole or between two."""
    opened = _opened(rows, index)
    moved = orbit.with_j2_state(opened, F.col("_since") + F.col("_index") * F.lit(float(step_seconds)), False)
    ts = _sample_ts(at, step_seconds, F.col("_index"))
    return frames.with_ecef_from_teme(moved.withColumn("ts", ts), frames.julian_date(F.col("ts"))).drop(
        *orbit.STATE_COLUMNS[:3], "_index")


#: Earth-fixed velocity and acceleration of `_motion`.
_VELOCITY, _ACCELERATION = ("_vel_x", "_vel_y", "_vel_z"), ("_acc_x", "_acc_y", "_acc_z")


def _motion(rows: DataFrame, at: Column, step_seconds: int, index: Column) -> DataFrame:
    """Earth-fixed positions as `_located`, with velocity and acceleration over the turning Earth.

    The velocity is whole. The acceleration leaves out that the perigee moves, `_left_out` at most.
    """
    moved = orbit.with_j2_state(
        _opened(rows, index), F.col("_since") + F.col("_index") * F.lit(float(step_seconds)), True)
    jd = frames.julian_date(_sample_ts(at, step_seconds, F.col("_index")))
    steps = {
        "_gs": "sin(_gmst)", "_gc": "cos(_gmst)",
        "_x": "position_x_km * _gc + position_y_km * _gs",
        "_y": "position_y_km * _gc - position_x_km * _gs",
        "_z": "position_z_km",
        "_vx": "velocity_x_km_s * _gc + velocity_y_km_s * _gs",
        "_vy": "velocity_y_km_s * _gc - velocity_x_km_s * _gs",
        "_vz": "velocity_z_km_s",
        "_r2": "_x * _x + _y * _y + _z * _z",
        "_w": f"_orbit._k_node_rate - {frames.d(_EARTH_RATE)}",
        # Perigee turns the orbit in its plane.
        "_c": "_orbit._k_argp_rate / (_orbit._k_n * _orbit._k_a * _orbit._k_a * _orbit._k_root)",
        "_on": "1D + _c * _r2",
        "_in": "_c * (_x * _vx + _y * _vy + _z * _vz)",
        "_pull": f"{frames.d(orbit.MU_KM3_S2)} / (_r2 * sqrt(_r2))",
    }
    keep = {
        "ecef_x_km": "_x", "ecef_y_km": "_y", "ecef_z_km": "_z",
        "_vel_x": "_vx * _on - _in * _x - _w * _y",
        "_vel_y": "_vy * _on - _in * _y + _w * _x",
        "_vel_z": "_vz * _on - _in * _z",
        "_acc_x": "-(_pull + _w * _w) * _x - 2D * _w * _vy",
        "_acc_y": "-(_pull + _w * _w) * _y + 2D * _w * _vx",
        "_acc_z": "-_pull * _z",
    }
    moved = frames.parted(moved.withColumn("_gmst", frames.gmst_radians(jd)))
    return frames.derive(moved, steps, keep).drop(
        "_gmst", "_index", *orbit.STATE_COLUMNS)


def _within(reach: Column) -> Column:
    """Is the observer's geocentric direction within so many degrees of the object's?"""
    ecef = [F.col(f"ecef_{c}_km") for c in "xyz"]
    site = [F.col(c) for c in frames.OBSERVER_FIELDS[:3]]
    dot = sum((a * b for a, b in zip(ecef[1:], site[1:], strict=True)), ecef[0] * site[0])
    length = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    return dot >= length(ecef) * length(site) * (F.cos(F.radians(F.least(reach, F.lit(180.0)))) - 1e-9)


_UP = "(observer_cos_lat * observer_cos_lon * {x} + observer_cos_lat * observer_sin_lon * {y} + observer_sin_lat * {z})"


def _judged(pairs: DataFrame, half: float, step: float, least: float) -> DataFrame:
    """Drop intervals in which the sine of the elevation stays below `least`; add `_closed`: it stays
    above, and rises or falls throughout, from the sample before the interval to the one after.

    The sine s is the vertical part of the unit vector to the object. With a bound on the object's
    acceleration, from its range and speed in the middle, |s''| is bounded, so s and s' there say
    enough. `half` is half the interval in seconds.
    """
    wide = half + step
    steps = {
        "_dx": "ecef_x_km - observer_x_km", "_dy": "ecef_y_km - observer_y_km", "_dz": "ecef_z_km - observer_z_km",
        "_range": "sqrt(_dx * _dx + _dy * _dy + _dz * _dz)",
        "_s": _UP.format(x="_dx", y="_dy", z="_dz") + " / _range",
        "_away": "(_dx * _vel_x + _dy * _vel_y + _dz * _vel_z) / _range",
        "_ds": "abs(" + _UP.format(x="_vel_x", y="_vel_y", z="_vel_z") + " - _s * _away) / _range",
        "_speed": f"sqrt(_vel_x * _vel_x + _vel_y * _vel_y + _vel_z * _vel_z) + _acceleration * {wide!r}D",
        "_nearest": f"_range - _speed * {wide!r}D",
        "_bend": "_acceleration / _nearest + 1.62D * (_speed / _nearest) * (_speed / _nearest)",
    }
    least_, half_, wide_ = (frames.d(v) for v in (least, half, wide))
    keep = {
        "_below": f"CASE WHEN _nearest > 0D AND _s + _ds * {half_} + 0.5D * _bend * {half_ } * {half_} + 1e-9D < {least_}"
        " THEN 1D ELSE 0D END",
        "_above": f"CASE WHEN _nearest > 0D AND _s - _ds * {wide_} - 0.5D * _bend * {wide_} * {wide_} - 1e-9D >= {least_}"
        f" AND _ds > _bend * {wide_} + 1e-9D AND _s < 2D THEN 1D ELSE 0D END",
    }
    return frames.derive(pairs, steps, keep).where("_below = 0").withColumn("_closed", F.col("_above") > 0).drop("_below", "_above")


def _needed(each: DataFrame, middle: Column, step: float, samples: int, least: float) -> DataFrame:
    """Drop samples that surely lie below the sine `least` of the elevation; add `_exact`: may this
    sample be the first, the last or the highest of a pass, or not be part of it at all?

    Positions follow from the middle of the interval by velocity and acceleration, with a bound on
    what that leaves out. A sample needs no exact place if it is up, both neighbours are, and one
    of them is higher.
    """
    steps = {"_t0": "_offset", "_tb": f"_offset - {step!r}D", "_ta": f"_offset + {step!r}D"}
    for n in ("0", "b", "a"):
        for c in "xyz":
            steps[f"_p{c}{n}"] = f"ecef_{c}_km - observer_{c}_km + _t{n} * (_vel_{c} + 0.5D * _t{n} * _acc_{c})"
        steps |= {
            f"_l{n}": f"sqrt(_px{n} * _px{n} + _py{n} * _py{n} + _pz{n} * _pz{n})",
            f"_m{n}": f"2D * ((_jerk * abs(_t{n}) / 6D + 0.5D * _left_out) * _t{n} * _t{n} + 0.01D) / _l{n} + 1e-9D",
            f"_s{n}": _UP.format(x=f"_px{n}", y=f"_py{n}", z=f"_pz{n}") + f" / _l{n}",
        }
    sure = " AND ".join(f"_m{n} < 1D AND _s{n} - _m{n} >= {frames.d(least)}" for n in ("0", "b", "a"))
    keep = {
        "_seen": f"CASE WHEN _s0 + _m0 < {frames.d(least)} THEN 0D ELSE 1D END",
        "_inside": f"CASE WHEN sample_idx > 0 AND sample_idx < {samples - 1} AND {sure}"
        " AND (_sb - _mb > _s0 + _m0 OR _sa - _ma > _s0 + _m0) THEN 1D ELSE 0D END",
    }
    timed = each.withColumn("_offset", (F.col("sample_idx") - middle) * F.lit(step))
    return frames.derive(timed, steps, keep).where("_closed OR _seen > 0").withColumn(
        "_exact", ~F.col("_closed") & (F.col("_inside") == 0)).drop("_seen", "_inside", "_offset")


def risen(
    elsets: DataFrame,
    observers: Sequence[Observer] | DataFrame,
    start: str | datetime | Column,
    window_hours: float,
    step_seconds: int,
    minimum_elevation: float,
) -> DataFrame:
    """Samples of the J2 kernel at which an object stands above an observer, by interval pruning.

    An interval of samples is kept for a pair only if the object, from where it is at the middle,
    can come within its footprint of the observer before the interval ends: its angular speed over
    the ground has a bound. Coarse intervals are cut into finer ones. Objects whose inclination
    keeps them below the latitude of every observer are left out before. Inside the finest
    intervals bounds on the elevation leave those samples to compute that may begin, end or top a
    pass. A row stands for `n_up` samples from `sample_idx` on, all up; angles and time are null
    where the sample lies inside a pass and is not its highest.
    """
    samples, at = _samples(window_hours, step_seconds), instant(start)
    listed = not isinstance(observers, DataFrame)
    sites = frames.with_observer_frame(observer_table(elsets.sparkSession, observers))
    x, y, z = (F.col(c) for c in frames.OBSERVER_FIELDS[:3])
    nearest = sites.agg(F.min(F.abs(F.degrees(F.atan2(z, F.sqrt(x * x + y * y)))))).first()[0]
    objects = _reaching(spread(elsets, samples), at, minimum_elevation).where(
        F.col("_turns_at") + F.col("_apogee_foot") >= (180.0 if nearest is None else nearest))

    def reach(span: int) -> Column:
        return F.col("_apogee_foot") + F.col("_rate") * ((span - 1) / 2 * step_seconds)

    # A table of observers meets the finest intervals, so that an object is moved once for all of them.
    spans = INTERVALS if listed else INTERVALS[-1:]
    ecef = ("ecef_x_km", "ecef_y_km", "ecef_z_km")
    for level, span in enumerate(spans):
        if level == 0:
            cut = F.sequence(F.lit(0), F.lit((samples - 1) // span))
        else:
            ratio = spans[level - 1] // span
            first = F.col("_interval") * ratio
            cut = F.sequence(first, F.least(first + ratio - 1, F.lit((samples - 1) // span)))
        objects = objects.withColumn("_interval", F.explode(cut))
        finest = level == len(spans) - 1
        middle = F.col("_interval") * span + (span - 1) / 2
        placed = frames.parted(_motion(objects, at, step_seconds, middle)) if finest else _located(objects, at, step_seconds, middle)
        if level == 0 and listed:
            placed = frames.with_observer_frame(with_literal_observers(placed, observers))
        elif level == 0:
            placed = with_footprint_cells(placed, reach(span)).join(observer_cells(observers), "_cell").drop("_cell")
        placed = placed.where(_within(reach(span)))
        objects = placed if finest else frames.parted(placed.drop(*ecef, "ts"))
    span, step = INTERVALS[-1], float(step_seconds)
    least = float(np.sin(np.radians(minimum_elevation)))
    judged = _judged(objects, (span - 1) / 2 * step, step, least)
    first = F.col("_interval") * span
    closed = F.col("_closed") & (first > 0) & (first + span < samples)
    each = frames.parted(judged.withColumn("_closed", closed)).withColumn("sample_idx", F.explode(F.when(F.col("_closed"), F.array(first)).otherwise(
        F.sequence(first, F.least(first + span - 1, F.lit(samples - 1))))))
    needed = frames.parted(_needed(each, first + (span - 1) / 2, step, samples, least).drop(
        *ecef, *_VELOCITY, *_ACCELERATION, "_interval", "_apogee_foot", "_rate", "_turns_at", "_acceleration", "_jerk", "_left_out"))
    placed = _located(needed, at, step_seconds, F.when(F.col("_exact"), F.col("sample_idx")))
    seen = frames.with_look_angles(placed).where(~F.col("_exact") | above(minimum_elevation))
    return seen.select(
        "norad_cat_id", "_orbit.object_name", "observer_id", "sample_idx", F.col("sample_idx").alias("sample_rank"),
        F.when(F.col("_closed"), span).otherwise(1).alias("n_up"),
        F.lit(samples).alias("n_survived"), "ts", "azimuth_deg", "elevation_deg", "range_km",
        F.lit("j2").alias("kernel_used"),
    )


def _foot(distance: np.ndarray, minimum_elevation: float) -> np.ndarray:
    """`footprint_degrees` for arrays, in radians."""
    floor = np.radians(minimum_elevation - _VERTICAL_SLACK)
    with np.errstate(all="ignore"):  # declined samples hold no numbers
        return np.arccos(np.minimum(1.0, _LOWEST_OBSERVER_KM * np.cos(floor) / distance)) - floor + np.radians(0.01)


def _in_sight(sites: np.ndarray, start_jd: float, samples: int, step_seconds: int, minimum_elevation: float):
    """For TEME positions (objects, samples, 3) of a window: may one of the sites (Earth-fixed, km)
    see the object? Bounds are those of `footprint_degrees`."""
    turn = frames.gmst_of(start_jd + np.arange(samples) * (step_seconds / 86400.0))
    x, y = sites[:, :1] * np.cos(turn) - sites[:, 1:2] * np.sin(turn), sites[:, :1] * np.sin(turn) + sites[:, 1:2] * np.cos(turn)
    length = np.sqrt((sites * sites).sum(axis=1))

    def keep(position: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):  # declined samples hold no numbers
            distance = np.sqrt((position * position).sum(axis=-1))
            reach = _foot(distance, minimum_elevation)
            least = distance * (np.cos(np.minimum(reach, np.pi)) - 1e-9)
            seen = np.zeros(distance.shape, bool)
            for i in range(len(sites)):
                dot = position[..., 0] * x[i] + position[..., 1] * y[i] + position[..., 2] * sites[i, 2]
                seen |= dot >= length[i] * least
        return seen

    return keep


def _sgp4_risen(
    elsets: DataFrame, observers: Sequence[Observer], start: str | datetime, window_hours: float,
    step_seconds: int, minimum_elevation: float,
) -> DataFrame:
    """Samples at which an object stands above one of the listed observers, by SGP4; J2 for deep space.

    By SGP4 every sample is computed, since those that the theory declines change the ranks of others,
    but only those that an observer may see leave the kernel. Rows of J2 inside a pass have no angles.
    """
    spark, samples = elsets.sparkSession, _samples(window_hours, step_seconds)
    table = frames.with_observer_frame(observer_table(spark, observers)).select(*frames.OBSERVER_FIELDS[:3])
    sites = np.array([tuple(r) for r in table.collect()], dtype=float)
    start_jd = spark.range(1).select(frames.julian_date(instant(start))).first()[0]
    keep = _in_sight(sites, start_jd, samples, step_seconds, minimum_elevation)
    near = _series(elsets.where(~is_deep()), start, window_hours, step_seconds, "sgp4", keep)
    seen = frames.with_look_angles(frames.with_observer_frame(with_literal_observers(near, observers)))
    deep = risen(elsets.where(is_deep()), observers, start, window_hours, step_seconds, minimum_elevation)
    each = F.explode(F.sequence("sample_idx", F.col("sample_idx") + F.col("n_up") - 1))
    deep = deep.withColumn("sample_idx", each).withColumn("sample_rank", F.col("sample_idx")).drop("n_up")
    return seen.where((F.col("kernel_used") == "sgp4") & above(minimum_elevation)).select(*deep.columns).unionByName(deep)


def _summarise(runs: DataFrame, keys: Sequence[str], rank: str, truncated: Column) -> DataFrame:
    """One row per run of samples above the threshold; a run needs two samples."""
    peak = F.max_by(
        F.struct("ts", "azimuth_deg", "elevation_deg"),
        F.struct("elevation_deg", -F.col(rank)),
    )
    passes = runs.groupBy(*keys, "_run").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("ts").alias("start_utc"),
        F.max("ts").alias("end_utc"),
        F.min_by("azimuth_deg", rank).alias("start_azimuth_deg"),
        F.max_by("azimuth_deg", rank).alias("end_azimuth_deg"),
        peak.alias("_peak"),
        truncated.alias("truncated"),
        *[F.max("kernel_used").alias("kernel_used")] * ("kernel_used" in runs.columns),
    ).where("_n >= 2 and end_utc > start_utc")
    minutes = (F.unix_micros("end_utc") - F.unix_micros("start_utc")) / F.lit(6e7)
    return passes.select(
        *keys, "start_utc", "start_azimuth_deg",
        F.col("_peak.ts").alias("peak_utc"),
        F.col("_peak.azimuth_deg").alias("peak_azimuth_deg"),
        F.col("_peak.elevation_deg").alias("peak_elevation_deg"),
        "end_utc", "end_azimuth_deg",
        minutes.alias("duration_minutes"),
        "truncated", *["kernel_used"] * ("kernel_used" in passes.columns),
    )


def pass_islands(
    series: DataFrame,
    *,
    minimum_elevation: float = DEFAULT_MINIMUM_ELEVATION,
    keys: Sequence[str] = ("norad_cat_id", "observer_id"),
    order: str = "sample_idx",
) -> DataFrame:
    """Passes in a given look-angle series of any length: runs at or above the elevation."""
    up = above(minimum_elevation)
    groups = OrderedGroups(
        series.withColumn("_up", F.when(up, 1).otherwise(0)), keys, [order], measured=series
    ).neighbours(previous={"_was_up": "_up"}, following={"_will_be": "_up"})
    starts = (F.col("_up") == 1) & (F.coalesce("_was_up", F.lit(0)) == 0)
    groups.running_sums({"_run": F.when(starts, 1).otherwise(0)})
    runs = groups.result().where("_up = 1").withColumn(
        "_edge", F.col("_was_up").isNull() | F.col("_will_be").isNull()
    )
    return _summarise(runs, keys, order, F.bool_or("_edge"))


def passes_of_series(
    visible: DataFrame,
    *,
    keys: Sequence[str] = ("norad_cat_id", "object_name", "observer_id"),
    break_on_gap: bool = False,
) -> DataFrame:
    """Passes out of a generated series that holds only samples above the threshold.

    Adjacent samples of a run have adjacent ranks, so rank minus the number of samples before
    is constant along it. Ranks count surviving samples, hence a declined instant does not end
    a run; with `break_on_gap` it does. A row may stand for `n_up` samples.
    """
    rank = "sample_idx" if break_on_gap else "sample_rank"
    w = Window.partitionBy(*keys).orderBy("sample_rank")
    before = F.row_number().over(w)
    if "n_up" in visible.columns:
        before = F.sum("n_up").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_up")
    runs = visible.withColumn("_run", F.col(rank) - before)
    if "n_up" in visible.columns:
        # The first, last and highest sample of a run have a time and angles.
        runs = runs.where("ts is not null")
    touches = (F.min("sample_rank") == 0) | (F.max("sample_rank") == F.max("n_survived") - 1)
    return _summarise(runs, keys, "sample_rank", touches)


#: Observers whose passes of an object are found in one call, about; samples that SGP4 takes at once.
_OBSERVERS_IN_BLOCK, _SGP4_SAMPLES = 64, 16_384
#: Rows that a batch of passes holds, about.
_BATCH_PASSES = 20_000


def _blocks(sites: DataFrame, count: int) -> DataFrame:
    """Observers with their frame in lists of some dozens."""
    block = F.pmod(F.xxhash64("observer_id"), F.lit(max(1, -(-count // _OBSERVERS_IN_BLOCK))))
    rows = sites.select(block.alias("_block"), F.struct("observer_id", *frames.OBSERVER_FIELDS).alias("_site"))
    return rows.groupBy("_block").agg(F.collect_list("_site").alias("_sites")).select("_sites")


def _found_in_batches(
    elsets: DataFrame, sites: DataFrame, count: int, at: Column, samples: int, step_seconds: int,
    minimum_elevation: float, break_on_gap: bool, kernel: str,
) -> DataFrame:
    """Passes of every element set over every observer; each observer has an id of its own.

    Nearly every object passes over nearly every observer it can reach, so an element set meets
    lists of observers, by a join without a key. One call holds the samples of an element set and
    puts out finished passes: no sample is exchanged, sorted or kept. Observers share an object's
    positions.
    """
    carry = ("norad_cat_id", "object_name")
    lists = _blocks(sites, count)
    objects = orbit.with_orbit_constants(spread(elsets, samples)).withColumns(
        {"_since": seconds_since_epoch(at), "_start_us": F.unix_micros(at), "_j2": F.lit(True) if kernel == "j2" else is_deep()})
    by_j2 = F.col("error_code") == 0
    for name in orbit.CONSTANT_COLUMNS:
        by_j2 = by_j2 & F.col(name).isNotNull()
    number = lambda c, name: F.coalesce(c.cast("double"), F.lit(float("nan"))).alias(name)
    rows = objects.where(F.col("_since").isNotNull() & (~F.col("_j2") | by_j2)).select(
        *carry, "_since", "_start_us", "_j2", *[number(F.col(c), c) for c in orbit.CONSTANT_COLUMNS],
        *[number(F.col(c) if kernel == "sgp4" else F.lit(None), f"_el_{c}") for c in sgp4.ELEMENT_COLUMNS],
    ).crossJoin(F.broadcast(lists))
    ends = [f"{end}_{what}" for end in sight.ENDS for what in ("at", "azimuth", "elevation")]
    fields = [rows.schema[c] for c in carry] + [T.StructField("observer_id", sites.schema["observer_id"].dataType)]
    fields += [T.StructField("_start_us", T.LongType()), T.StructField("_j2", T.BooleanType())]
    fields += [T.StructField(c, T.LongType() if c.endswith("_at") else T.DoubleType()) for c in ends]
    fields += [T.StructField("truncated", T.BooleanType())]

    def tracks(column, low: int, high: int, gc, gs) -> Iterator[tuple[int, np.ndarray, sight.Places, np.ndarray]]:
        """Rows with positions of samples, and the numbers of those samples."""
        near = low + np.flatnonzero(~column["_j2"][low:high])
        if near.size:
            # As in the samples of SGP4.
            since = column["_since"][near]
            start, step = since / 60.0, ((since + float(step_seconds)) - since) / 60.0
            error, position, _ = sgp4.states(
                {c: column[f"_el_{c}"][near] for c in sgp4.ELEMENT_COLUMNS}, start[:, None] + step[:, None] * np.arange(samples))
        for row in range(low, high):
            if column["_j2"][row]:
                k = {c: column[c][row] for c in orbit.CONSTANT_COLUMNS}
                places = sight.j2_places(k, column["_since"][row], step_seconds, gc, gs)
                yield row, sight.j2_track(k, column["_since"][row], step_seconds, gc, gs, places), places, np.arange(samples)
            else:
                i = int(np.searchsorted(near, row))
                kept = np.flatnonzero(error[i] == 0)
                track = sight.earth_fixed(*position[i][kept].T, gc[kept], gs[kept])
                yield row, track, lambda index, track=track: track[:, index], kept

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            column = {
                n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names if n.startswith("_") and n != "_sites"
            }
            observers, *frame = batch.column("_sites").flatten().flatten()
            frame = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in frame])
            until = np.cumsum(pc.list_value_length(batch.column("_sites")).to_numpy(zero_copy_only=False))
            per, low = max(1, _SGP4_SAMPLES // samples), 0
            found: list[dict[str, np.ndarray]] = []

            def put_out() -> pa.RecordBatch:
                one = {c: np.concatenate([f[c] for f in found]) for c in found[0]}  # noqa: B023
                found.clear()  # noqa: B023
                row, observer = pa.array(one.pop("row")), pa.array(one.pop("observer"))
                taken = [batch.column(c).take(row) for c in carry] + [observers.take(observer)]  # noqa: B023
                taken += [batch.column(c).take(row) for c in ("_start_us", "_j2")]  # noqa: B023
                return pa.RecordBatch.from_arrays([*taken, *[pa.array(one[f.name]) for f in fields[5:]]], names=[f.name for f in fields])

            while low < batch.num_rows:
                start = int(column["_start_us"][low])
                high = low + 1
                while high < min(low + per, batch.num_rows) and column["_start_us"][high] == start:
                    high += 1
                if start not in turns:
                    turns = {start: sight.turn(start, samples, step_seconds)}
                for row, track, places, index in tracks(column, low, high, *turns[start]):
                    first = until[row - 1] if row else 0
                    if not index.size:
                        continue
                    fresh = np.flatnonzero(np.diff(index) > 1) + 1 if break_on_gap else None
                    distance = np.sqrt((track * track).sum(axis=0))
                    run = sight.runs(
                        track, places, frame[:, first:until[row]], minimum_elevation, _foot(distance, minimum_elevation), fresh=fresh)
                    for end in sight.ENDS:
                        run[f"{end}_at"] = index[run[f"{end}_at"]]
                    found.append({
                        "row": np.full(len(run["site"]), row), "observer": first + run["site"], **{c: run[c] for c in ends},
                        "truncated": (run["start_at"] == index[0]) | (run["end_at"] == index[-1]),
                    })
                    if sum(len(f["row"]) for f in found) >= _BATCH_PASSES:
                        yield put_out()
                low = high
            if found:
                yield put_out()

    found = rows.mapInArrow(passes, T.StructType(fields))
    step_us = int(step_seconds * 1_000_000)
    micros = lambda end: F.col("_start_us") + F.col(f"{end}_at") * F.lit(step_us).cast("long")
    return found.select(
        *carry, "observer_id",
        F.timestamp_micros(micros("start")).alias("start_utc"), F.col("start_azimuth").alias("start_azimuth_deg"),
        F.timestamp_micros(micros("peak")).alias("peak_utc"), F.col("peak_azimuth").alias("peak_azimuth_deg"),
        F.col("peak_elevation").alias("peak_elevation_deg"),
        F.timestamp_micros(micros("end")).alias("end_utc"), F.col("end_azimuth").alias("end_azimuth_deg"),
        ((micros("end") - micros("start")) / F.lit(6e7)).alias("duration_minutes"),
        "truncated", F.when(F.col("_j2"), "j2").otherwise("sgp4").alias("kernel_used"),
    )


def find_passes(
    elsets: DataFrame,
    observers: Sequence[Observer] | DataFrame,
    start: str | datetime | Column,
    *,
    window_hours: float = DEFAULT_WINDOW_HOURS,
    step_seconds: int = DEFAULT_STEP_SECONDS,
    minimum_elevation: float = DEFAULT_MINIMUM_ELEVATION,
    break_on_gap: bool = False,
    kernel: str = "j2",
) -> DataFrame:
    """Passes of every object over every observer within a window.

    Observers of one id share a series, so their samples have to be put in order together.
    """
    if kernel not in KERNELS:
        raise ValueError(f"unknown kernel {kernel!r}, expected one of {KERNELS}")
    samples, listed = _samples(window_hours, step_seconds), not isinstance(observers, DataFrame)
    if kernel == "sgp4" or not listed:
        table = observer_table(elsets.sparkSession, observers)
        count, ids = table.agg(F.count(F.lit(1)), F.count_distinct(F.struct("observer_id"))).first()
        if count == ids:
            return _found_in_batches(
                elsets, frames.with_observer_frame(table), count, instant(start), samples, step_seconds,
                minimum_elevation, break_on_gap, kernel,
            )
    if kernel == "j2":
        visible = risen(elsets, observers, start, window_hours, step_seconds, minimum_elevation)
    elif listed and not isinstance(start, Column):
        visible = _sgp4_risen(elsets, observers, start, window_hours, step_seconds, minimum_elevation)
    else:
        series = _series(elsets, start, window_hours, step_seconds, kernel)
        visible = visible_pairs(series, table, minimum_elevation)
    return passes_of_series(visible, break_on_gap=break_on_gap)
