"""Orbit tracks, and paths across the antimeridian."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.functions import frames, orbit
from skyledger.operators.ordered import OrderedGroups
from skyledger.operators.propagate import instant, sample_states, seconds_since_epoch, spread

DEFAULT_SAMPLES = 90


def orbit_tracks(
    elsets: DataFrame,
    start: str | datetime | Column,
    *,
    samples: int = DEFAULT_SAMPLES,
    ground_track: bool = True,
    kernel: str = "j2",
) -> DataFrame:
    """One revolution of every object, one row per surviving sample.

    A ground track turns the Earth under each sample and leaves the end point out; an orbit
    path holds the Earth still at `start` and includes it, so the curve closes. Objects
    without a usable period, and tracks left with fewer than two points, are dropped.
    """
    if samples < 2:
        raise ValueError("a track needs at least two samples")
    at = instant(start)
    steps = samples if ground_track else samples - 1
    timed = elsets.withColumn("period_minutes", orbit.period_minutes(F.col("mean_motion"))).where(
        F.col("period_minutes").isNotNull()
    )
    # One exchange of the element sets; everything after it, windows over a track included,
    # stays in the task that generates the samples.
    timed = spread(timed, samples, counted=True)
    moved = sample_states(
        timed,
        lambda i: seconds_since_epoch(at) + i * (F.col("period_minutes") * 60.0 / steps),
        samples=samples, kernel=kernel, velocity=False,
        carry=("norad_cat_id", "object_name", "period_minutes"),
    ).where((F.col("error_code") == 0) & (F.col("n_survived") >= 2))
    jd = frames.julian_date(at)
    if ground_track:
        jd = jd + F.col("sample_idx") * (F.col("period_minutes") / F.lit(1440.0 * steps))
    located = frames.with_geodetic_from_teme(moved, jd)
    return located.select(
        "norad_cat_id", "object_name", "period_minutes", "sample_idx",
        "latitude_deg", "longitude_deg", "altitude_km", "kernel_used",
    )


def track_closure(tracks: DataFrame) -> DataFrame:
    """First and last point of each track, and the longitude between them."""
    ends = tracks.groupBy("norad_cat_id").agg(
        F.min_by("longitude_deg", "sample_idx").alias("first_lon"),
        F.max_by("longitude_deg", "sample_idx").alias("last_lon"),
        F.min_by("latitude_deg", "sample_idx").alias("first_lat"),
        F.max_by("latitude_deg", "sample_idx").alias("last_lat"),
    )
    turn = F.pmod(F.col("last_lon") - F.col("first_lon") + 180.0, F.lit(360.0)) - 180.0
    return ends.select(
        "norad_cat_id",
        turn.alias("lon_gap_deg"),
        (F.col("last_lat") - F.col("first_lat")).alias("lat_gap_deg"),
    )


def _jump(name: str) -> Column:
    return F.col("longitude_deg") - F.col(name)


def split_antimeridian(
    points: DataFrame,
    *,
    keys: Sequence[str] = ("norad_cat_id",),
    order: Sequence[str] = ("sample_idx",),
    bounded: bool = False,
) -> DataFrame:
    """Number the segments of each path, cut where longitude jumps by more than 180 degrees.

    Segments of a single point are dropped, unless that point is the whole path.
    `bounded` states that a path holds at most the samples of one track.
    """
    groups = OrderedGroups(
        points, keys, order, bounded=bounded
    ).neighbours(previous={"_before": "longitude_deg"}, following={"_after": "longitude_deg"})
    cut = F.coalesce(F.abs(_jump("_before")) > 180.0, F.lit(False))
    groups.running_sums({"segment": F.when(cut, 1).otherwise(0)})
    opens = F.col("_before").isNull() | (F.abs(_jump("_before")) > 180.0)
    closes = F.col("_after").isNull() | (F.abs(_jump("_after")) > 180.0)
    whole = F.col("_before").isNull() & F.col("_after").isNull()
    return (
        groups.result()
        .where(~(opens & closes) | whole)
        .withColumn("segment", F.col("segment").cast("int"))
        .drop("_before", "_after")
    )


def unwrap_longitude(
    points: DataFrame,
    *,
    keys: Sequence[str] = ("norad_cat_id",),
    order: Sequence[str] = ("sample_idx",),
    bounded: bool = False,
) -> DataFrame:
    """Make longitudes continuous along each path with a running multiple of 360 degrees.

    `bounded` states that a path holds at most the samples of one track.
    """
    groups = OrderedGroups(
        points, keys, order, bounded=bounded
    ).neighbours(previous={"_before": "longitude_deg"})
    turn = (
        F.when(_jump("_before") > 180.0, F.lit(-360.0))
        .when(_jump("_before") < -180.0, F.lit(360.0))
        .otherwise(F.lit(0.0))
    )
    groups.running_sums({"_turned": turn})
    return (
        groups.result()
        .withColumn("unwrapped_lon_deg", F.col("longitude_deg") + F.col("_turned"))
        .drop("_before", "_turned")
    )


def tracks_to_paths(
    tracks: DataFrame, *, globe: bool, exaggeration: float = 1.0
) -> DataFrame:
    """One drawable path per row, as nested coordinate arrays.

    A flat map gets segments of [lon, lat]; a globe gets one unwrapped path of
    [lon, lat, height in metres]. A path holds at most the samples of one track.
    """
    if globe:
        rows = unwrap_longitude(tracks, bounded=True).withColumn("segment", F.lit(0))
        point = F.array(
            "unwrapped_lon_deg", "latitude_deg",
            F.col("altitude_km") * F.lit(1000.0 * exaggeration),
        )
    else:
        rows = split_antimeridian(tracks, bounded=True)
        point = F.array("longitude_deg", "latitude_deg")
    grouped = rows.groupBy("norad_cat_id", "object_name", "period_minutes", "segment", "kernel_used").agg(
        F.sort_array(F.collect_list(F.struct("sample_idx", point.alias("p")))).alias("points")
    )
    return grouped.select(
        F.transform("points", lambda x: x["p"]).alias("path"),
        "norad_cat_id", "object_name",
        F.bround("period_minutes", 1).alias("period_minutes"),
        "segment", "kernel_used",
    )
