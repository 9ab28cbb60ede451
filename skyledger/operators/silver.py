"""Typed staging, deduplication and validity intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyledger.operators.ordered import OrderedGroups
from skyledger.schemas import LINEAGE_COLUMNS

# Target type of each staged column; (source column, type) where renamed.
GP_TYPES = {
    "norad_cat_id": "int",
    "epoch": "timestamp",
    "object_name": "string",
    "object_id": "string",
    "classification_type": "string",
    "mean_motion": "decimal(12,8)",
    "eccentricity": "decimal(12,10)",
    "inclination": "decimal(12,8)",
    "ra_of_asc_node": "decimal(12,8)",
    "arg_of_pericenter": "decimal(12,8)",
    "mean_anomaly": "decimal(12,8)",
    "mean_motion_dot": "decimal(15,12)",
    "mean_motion_ddot": "decimal(15,12)",
    "bstar": "decimal(15,12)",
    "ephemeris_type": "int",
    "element_set_no": "int",
    "rev_at_epoch": "int",
}
SATCAT_TYPES = {
    "norad_cat_id": "int",
    "object_name": "string",
    "object_id": "string",
    "object_type": "string",
    "ops_status_code": "string",
    "owner": "string",
    "launch_date": "date",
    "launch_site": "string",
    "decay_date": "date",
    "period_minutes": ("period", "decimal(10,2)"),
    "inclination": "decimal(6,2)",
    "apogee_km": ("apogee", "int"),
    "perigee_km": ("perigee", "int"),
    "rcs_m2": ("rcs", "decimal(8,4)"),
    "data_status_code": "string",
    "orbit_center": "string",
    "orbit_type": "string",
}


def _staged(raw: DataFrame, types: dict) -> DataFrame:
    casts = []
    for name, spec in types.items():
        source, kind = spec if isinstance(spec, tuple) else (name, spec)
        casts.append(F.col(source).cast(kind).alias(name))
    return raw.select(*casts, *LINEAGE_COLUMNS)


def stage_gp(raw: DataFrame) -> DataFrame:
    """Element sets with real types. A value that does not parse fails the job (ANSI)."""
    return _staged(raw, GP_TYPES)


def stage_satcat(raw: DataFrame) -> DataFrame:
    """Catalogue rows with real types and units in the column names."""
    return _staged(raw, SATCAT_TYPES)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key under a total order.

    Spark keeps one candidate per key in every map task before the shuffle, so a key with
    very many copies costs no more than any other.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def dedup_earliest(staged: DataFrame) -> DataFrame:
    """One row per (object, epoch): the one seen first."""
    return first_per_key(
        staged,
        ["norad_cat_id", "epoch"],
        [F.col(c).asc_nulls_last() for c in ("ingest_ts", "source_file", "ingestion_id")],
    )


def dedup_latest(staged: DataFrame) -> DataFrame:
    """One row per object: the one landed last, ties to the greater file name."""
    return first_per_key(
        staged,
        ["norad_cat_id"],
        [F.col(c).desc_nulls_first() for c in ("ingest_ts", "source_file", "ingestion_id")],
    )


def with_validity(elsets: DataFrame, measured: DataFrame | None = None) -> DataFrame:
    """Validity interval of each element set: from its epoch to the object's next one.

    `measured` are rows to count objects in, if `elsets` is dear to compute.
    """
    groups = OrderedGroups(elsets, ["norad_cat_id"], ["epoch"], measured=measured).neighbours(
        following={"valid_to": "epoch"}
    )
    return groups.result().withColumns(
        {"valid_from": F.col("epoch"), "is_current": F.col("valid_to").isNull()}
    )


def elset(staged: DataFrame, measured: DataFrame | None = None) -> DataFrame:
    """Deduplicated element-set history with validity intervals.

    Copies are removed on (object, epoch), with one survivor per map task, before the intervals
    are computed; objects are counted in the staged rows, or in `measured`.
    """
    columns = [c for c in GP_TYPES] + ["valid_from", "valid_to"]
    columns += [c for c in LINEAGE_COLUMNS if c != "target"] + ["is_current"]
    return with_validity(dedup_earliest(staged), staged if measured is None else measured).select(*columns)


def space_object(staged: DataFrame) -> DataFrame:
    """Current catalogue state, one row per object."""
    columns = list(SATCAT_TYPES) + [c for c in LINEAGE_COLUMNS if c != "target"]
    return dedup_latest(staged).select(*columns)


def asof_elset(
    probes: DataFrame,
    elsets: DataFrame,
    *,
    at: str = "at",
    columns: tuple[str, ...] = ("epoch", "valid_to"),
    measured: DataFrame | None = None,
) -> DataFrame:
    """The element set in force at each probe's instant; NULLs before the first one.

    Probes and element sets are merged in time order per object and the latest element set
    is carried forward: linear in the rows, where a range join would compare every probe of
    an object with every one of its intervals. `measured` (norad_cat_id, epoch) are rows to
    count objects in instead of `elsets`, if these are dear to compute.
    """
    marker = F.struct(*columns)
    left = probes.select(
        F.col("norad_cat_id"), F.col(at).alias("_t"), F.lit(1).alias("_kind"),
        F.struct(*probes.columns).alias("_probe"),
        F.lit(None).cast(elsets.select(marker.alias("s")).schema["s"].dataType).alias("_elset"),
    )
    right = elsets.select(
        F.col("norad_cat_id"), F.col("epoch").alias("_t"), F.lit(0).alias("_kind"),
        F.lit(None).cast(left.schema["_probe"].dataType).alias("_probe"),
        marker.alias("_elset"),
    )
    counted = (elsets if measured is None else measured).select("norad_cat_id", F.col("epoch").alias("_t"))
    merged = OrderedGroups(
        left.unionByName(right), ["norad_cat_id"], ["_t", "_kind"],
        measured=left.select("norad_cat_id", "_t").union(counted),
    ).fill_forward("_found", "_elset").result()
    return merged.where("_kind = 1").select("_probe.*", *[f"_found.{c}" for c in columns])
