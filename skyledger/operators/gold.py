"""Interpretation of the catalogue, and the gate in front of propagation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM_COLUMNS = (
    "norad_cat_id", "object_name", "object_id", "object_type", "ops_status_code", "owner",
    "launch_date", "launch_site", "decay_date", "period_minutes", "inclination",
    "apogee_km", "perigee_km", "rcs_m2", "orbit_center", "orbit_type",
)
FACT_COLUMNS = (
    "norad_cat_id", "epoch", "object_name", "object_id", "classification_type",
    "mean_motion", "eccentricity", "inclination", "ra_of_asc_node", "arg_of_pericenter",
    "mean_anomaly", "mean_motion_dot", "mean_motion_ddot", "bstar", "ephemeris_type",
    "element_set_no", "rev_at_epoch", "ingest_ts", "source_file",
)


def is_decayed(decay_date: Column) -> Column:
    return decay_date.isNotNull()


def is_earth_orbiting(orbit_center: Column) -> Column:
    """Earth itself, or docked to a host given by number; NULL stays NULL."""
    return (orbit_center == "EA") | orbit_center.rlike("^[0-9]+$")


def orbit_regime(apogee_km: Column) -> Column:
    return (
        F.when(apogee_km.isNull(), "unknown")
        .when(apogee_km < 2000, "LEO")
        .when(apogee_km < 35000, "MEO")
        .otherwise("GEO/HEO")
    )


def dim_object(space_object: DataFrame) -> DataFrame:
    """The catalogue dimension with its three derived flags. Decayed objects stay in."""
    return space_object.select(
        *DIM_COLUMNS,
        is_decayed(F.col("decay_date")).alias("is_decayed"),
        is_earth_orbiting(F.col("orbit_center")).alias("is_earth_orbiting"),
        orbit_regime(F.col("apogee_km")).alias("orbit_regime"),
        "ingest_ts",
        "source_file",
    )


def current_only(elsets: DataFrame) -> DataFrame:
    return elsets.where("is_current")


def propagatable_objects(dim: DataFrame) -> DataFrame:
    """Objects still in Earth orbit. An unknown centre does not pass."""
    return dim.where(~F.col("is_decayed") & F.col("is_earth_orbiting"))


def fact_propagatable(elsets: DataFrame, dim: DataFrame) -> DataFrame:
    """Current element sets of objects that can be propagated, one row per object.

    Both sides hold one row per object, so the join cannot be skewed; which side is
    broadcast, if any, is left to the sizes Spark measures.
    """
    gate = propagatable_objects(dim).select("norad_cat_id")
    return current_only(elsets).select(*FACT_COLUMNS).join(gate, "norad_cat_id", "left_semi")


def ordered_by_id(fact: DataFrame, limit: int | None = None) -> DataFrame:
    """The gated fact by object id; a limit of 0 or None means all of it."""
    ordered = fact.orderBy("norad_cat_id")
    return ordered.limit(limit) if limit else ordered


def orphan_keys(fact: DataFrame, dim: DataFrame) -> DataFrame:
    """Object ids of the fact that the dimension does not know."""
    return fact.select("norad_cat_id").distinct().join(
        dim.select("norad_cat_id"), "norad_cat_id", "left_anti"
    )


def coverage_by_type(dim: DataFrame, fact: DataFrame) -> DataFrame:
    """Per object type: objects in orbit, and how many of them have element sets."""
    known = fact.select("norad_cat_id").distinct().withColumn("has_elset", F.lit(1))
    return (
        dim.where(~F.col("is_decayed"))
        .select("norad_cat_id", "object_type")
        .join(known, "norad_cat_id", "left")
        .groupBy("object_type")
        .agg(
            F.count(F.lit(1)).alias("in_orbit"),
            F.count("has_elset").alias("with_elset"),
        )
    )
