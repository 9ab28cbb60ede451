"""Attributes, flags and filters on position rows."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.schemas import (
    DEFAULT_STALENESS_HOURS,
    DIMENSION_COLUMNS,
    LAUNCH_SITE_NAMES,
    STALENESS_HOURS,
)


def lookup(table: dict, key: Column, default: Column) -> Column:
    """A fixed table as a map literal; keys outside it give the default."""
    literal = F.create_map(*[F.lit(part) for item in table.items() for part in item])
    return F.coalesce(F.when(key.isNotNull(), F.try_element_at(literal, key)), default)


def speed(
    vx: str = "velocity_x_km_s", vy: str = "velocity_y_km_s", vz: str = "velocity_z_km_s"
) -> Column:
    """Length of the inertial velocity, km/s."""
    x, y, z = F.col(vx), F.col(vy), F.col(vz)
    return F.sqrt(x * x + y * y + z * z)


def launch_site_name(code: Column) -> Column:
    """Place name of a launch-site code; an unlisted code stays as it is."""
    return lookup(LAUNCH_SITE_NAMES, code, code)


def is_stale(age_hours: Column, regime: Column) -> Column:
    """Is the element set too old for its regime? Unknown ages are not stale."""
    limit = lookup(STALENESS_HOURS, regime, F.lit(DEFAULT_STALENESS_HOURS))
    return F.coalesce(~F.isnan(age_hours) & (age_hours > limit), F.lit(False))


def object_label(name: Column, norad_cat_id: Column) -> Column:
    """`NAME · ID`, or the id alone; ids identify, names repeat."""
    return F.concat_ws(" · ", name, norad_cat_id.cast("string"))


def attach_dimension(positions: DataFrame, dim: DataFrame) -> DataFrame:
    """Object attributes on positions. Positions without an object keep NULLs.

    No broadcast hint: the dimension grows with the catalogue, so Spark decides by its
    measured size, and a skewed object is split by the adaptive sort-merge join.
    """
    return positions.join(dim.select(*DIMENSION_COLUMNS), "norad_cat_id", "left")


def with_display_attributes(positions: DataFrame, dim: DataFrame) -> DataFrame:
    """Positions with attributes, speed, launch site name and staleness."""
    return attach_dimension(positions, dim).withColumns(
        {
            "speed_km_s": speed(),
            "launch_site_name": launch_site_name(F.col("launch_site")),
            "is_stale": is_stale(F.col("epoch_age_hours"), F.col("orbit_regime")),
        }
    )


def in_set(column: Column, values: Iterable) -> Column:
    """Membership; an empty set keeps nothing, NULL is never a member."""
    chosen = list(values)
    return F.coalesce(column.isin(chosen), F.lit(False)) if chosen else F.lit(False)


def name_matches(name: Column, query: str, *, regex: bool = False) -> Column:
    """Case-insensitive match anywhere in the name; an empty query matches everything."""
    if not query:
        return F.lit(True)
    hit = name.rlike(f"(?i){query}") if regex else F.lower(name).contains(query.lower())
    return F.coalesce(hit, F.lit(False))


def dashboard_filter(
    *,
    regimes: Iterable[str] | None = None,
    object_types: Iterable[str] | None = None,
    altitude_range: tuple[float, float] | None = None,
    name_query: str = "",
    hide_stale: bool = False,
    regex: bool = False,
) -> Column:
    """One predicate out of the map's filters; None leaves a filter out."""
    parts = [F.lit(True)]
    if regimes is not None:
        parts.append(in_set(F.col("orbit_regime"), regimes))
    if object_types is not None:
        parts.append(in_set(F.col("object_type"), object_types))
    if altitude_range is not None:
        parts.append(F.col("altitude_km").between(*altitude_range))
    if name_query:
        parts.append(name_matches(F.col("object_name"), name_query, regex=regex))
    if hide_stale:
        parts.append(~F.col("is_stale"))
    return reduce(lambda a, b: a & b, parts)


def filter_positions(frame: DataFrame, **filters) -> DataFrame:
    """Positions that satisfy `dashboard_filter`."""
    return frame.where(dashboard_filter(**filters))


def filter_ids(frame: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose object id is among the chosen ones."""
    return frame.join(ids.select("norad_cat_id").distinct(), "norad_cat_id", "left_semi")


def above(minimum_elevation: float) -> Column:
    return F.col("elevation_deg") >= minimum_elevation
